"""Read the driver's Parquet tables and bind them to the corpus schema.

The binding only *shapes* rows into the corpus schema; it does none of the
work of the jobs that consume them.  Every job must be right on any rows of
that schema.

Binding (one library per ``documents.source``):

* ``libraries``  distinct ``source`` as ``library_id``, ``{'name': source}``
* ``documents``  ``doc_id`` as ``document_id``, ordered by ``doc_id``,
  ``{'lang': lang}``
* ``chunks``     one per ``embeddings`` row: ``vec_id`` is the chunk id, its
  document is ``vec_id div 4`` and its position ``vec_id % 4``.  The text of
  the four chunks of a document is the document text cut into four
  consecutive pieces of equal length, so the chunks of a document together
  hold its whole text.  ``{'label': label, 'lang': lang}``
* ``queries``    every ``embeddings`` row is also a query in the library of
  its document, filtered by its own label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

CHUNKS_PER_DOCUMENT = 4


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Parquet gives column pruning and filter pushdown."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass
class Corpus:
    libraries: DataFrame
    documents: DataFrame
    chunks: DataFrame


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return (docs.select(F.col("source").alias("library_id")).distinct()
            .select("library_id", F.create_map(F.lit("name"), F.col("library_id")).alias("metadata")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("library_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("doc_id").cast("long").alias("doc_pos"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    n = CHUNKS_PER_DOCUMENT
    e = emb.select("vec_id", "embedding", "label",
                   F.floor(F.col("vec_id") / n).alias("doc_id"),
                   F.pmod(F.col("vec_id"), F.lit(n)).alias("part"))
    j = e.join(docs, "doc_id")
    return j.select(
        F.col("source").alias("library_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.col("part").cast("long").alias("chunk_pos"),
        F.expr(f"substring(text, cast(part * ceil(char_length(text) / {n}) + 1 as int), "
               f"cast(ceil(char_length(text) / {n}) as int))").alias("text"),
        F.col("embedding"),
        F.create_map(F.lit("label"), F.col("label").cast("string"),
                     F.lit("lang"), F.col("lang")).alias("metadata"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(libraries(spark, sf_dir), documents(spark, sf_dir), chunks(spark, sf_dir))


def queries(spark: SparkSession, sf_dir: str, k: int | None = 10,
            filter_keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """Every chunk's vector as a query in its own library.  ``filters`` asks
    for the query's own values of ``filter_keys``; ``k=None`` takes
    ``label + 1`` as a per-query k (1..10)."""
    c = chunks(spark, sf_dir)
    kcol = (F.element_at("metadata", "label").cast("int") + 1) if k is None else F.lit(k)
    if filter_keys:
        parts = []
        for key in filter_keys:
            parts += [F.lit(key), F.element_at("metadata", key)]
        filt = F.create_map(*parts)
    else:
        filt = F.create_map().cast("map<string,string>")
    return c.select(
        F.col("chunk_id").alias("query_id"),
        "library_id",
        "embedding",
        kcol.cast("int").alias("k"),
        filt.alias("filters"),
    )
