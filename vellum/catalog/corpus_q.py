"""Corpus reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reshape as R
from ..operators.rank import positions
from ..sources import tables
from . import register
from .common import with_chunks


@register("flatten", with_chunks(
    "SELECT c.library_id, c.document_id, c.chunk_id, c.chunk_pos, d.doc_pos, c.text, "
    "CAST(len(c.embedding) AS BIGINT) AS dim, c.label, c.lang "
    "FROM chunks c JOIN docs d ON d.document_id = c.document_id AND d.library_id = c.library_id"))
def flatten(spark, sf):
    """R1 after R2: re-nest every document with its chunks (document rows
    carrying their library's id and metadata), then flatten back to chunk
    rows; positions come from the nested order."""
    c = tables.corpus(spark, sf)
    nested = R.library_documents(c.libraries, c.documents, c.chunks)
    x = nested.select("library_id", "doc_pos", "document_id",
                      F.posexplode("chunks").alias("chunk_pos", "ch"))
    return x.select("library_id", "document_id", F.col("ch.id").alias("chunk_id"),
                    F.col("chunk_pos").cast("bigint").alias("chunk_pos"), "doc_pos",
                    F.col("ch.text").alias("text"), F.size("ch.embedding").cast("bigint").alias("dim"),
                    F.element_at("ch.metadata", "label").alias("label"),
                    F.element_at("ch.metadata", "lang").alias("lang"))


@register("flatten_nested_libraries", with_chunks(
    "SELECT c.library_id, c.document_id, c.chunk_id, c.chunk_pos, d.doc_rank "
    "FROM chunks c JOIN (SELECT library_id, document_id, "
    "CAST(row_number() OVER (PARTITION BY library_id ORDER BY doc_pos, document_id) - 1 AS BIGINT) AS doc_rank "
    "FROM docs) d ON d.document_id = c.document_id AND d.library_id = c.library_id"))
def flatten_nested_libraries(spark, sf):
    """R1 on a nested corpus (documents of every library with their chunks):
    chunk positions come from the nested order, and a document's place in its
    library is the rank of its ``doc_pos`` (documents without chunks included)."""
    c = tables.corpus(spark, sf)
    nested = R.library_documents(c.libraries, c.documents, c.chunks)
    place = positions(c.documents.select("library_id", "document_id", "doc_pos"), ["doc_pos", "document_id"],
                      ["library_id"], out="doc_rank").select("library_id", "document_id", "doc_rank")
    return (nested.select("library_id", "document_id", F.posexplode("chunks").alias("chunk_pos", "ch"))
            .select("library_id", "document_id", F.col("ch.id").alias("chunk_id"),
                    F.col("chunk_pos").cast("bigint").alias("chunk_pos"))
            .join(place, ["library_id", "document_id"]))


@register("renest_documents", with_chunks("""
SELECT d.library_id, d.document_id, d.doc_pos,
       CAST(count(c.chunk_id) AS BIGINT) AS n_chunks,
       coalesce(string_agg(c.chunk_id, ',' ORDER BY c.chunk_pos), '') AS chunk_ids,
       CAST(coalesce(sum(length(c.text)), 0) AS BIGINT) AS text_len
FROM docs d LEFT JOIN chunks c ON c.document_id = d.document_id AND c.library_id = d.library_id
GROUP BY d.library_id, d.document_id, d.doc_pos"""))
def renest_documents(spark, sf):
    """R2: every document with its chunks in order; documents without chunks
    keep an empty list."""
    c = tables.corpus(spark, sf)
    n = R.renest_documents(c.documents, c.chunks)
    return n.select("library_id", "document_id", "doc_pos",
                    F.size("chunks").cast("bigint").alias("n_chunks"),
                    F.array_join(F.transform("chunks", lambda x: x["id"]), ",").alias("chunk_ids"),
                    F.aggregate(F.transform("chunks", lambda x: F.length(x["text"]).cast("bigint")),
                                F.lit(0).cast("bigint"), lambda a, b: a + b).alias("text_len"))


@register("renest_libraries", with_chunks("""
SELECT l.library_id, 'name=' || l.library_id AS library_meta,
       CAST(count(*) OVER (PARTITION BY l.library_id) AS BIGINT) AS n_documents,
       CAST(row_number() OVER (PARTITION BY l.library_id ORDER BY d.doc_pos, d.document_id) - 1 AS BIGINT) AS doc_rank,
       d.document_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_chunks
FROM (SELECT DISTINCT library_id FROM docs) l JOIN docs d ON d.library_id = l.library_id
LEFT JOIN (SELECT library_id, document_id, count(*) AS n FROM chunks GROUP BY 1, 2) n
  ON n.library_id = d.library_id AND n.document_id = d.document_id"""))
def renest_libraries(spark, sf):
    """Each library's nested documents in order, with the library's metadata
    and size; one row per document, since a library is no bounded row."""
    c = tables.corpus(spark, sf)
    n = R.library_documents(c.libraries, c.documents, c.chunks)
    key = ["library_id", "document_id"]
    place = positions(c.documents.select(*key, "doc_pos"), ["doc_pos", "document_id"], ["library_id"],
                      out="doc_rank").select(*key, "doc_rank")
    total = c.documents.groupBy("library_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return (n.select(*key, F.concat(F.lit("name="), F.element_at("library_metadata", "name")).alias("library_meta"),
                     F.size("chunks").cast("bigint").alias("n_chunks"))
            .join(place, key).join(total, "library_id")
            .select("library_id", "library_meta", "n_documents", "doc_rank", "document_id", "n_chunks"))


@register("library_documents", with_chunks("""
SELECT d.library_id, d.library_id AS library_name, d.doc_pos, d.document_id, d.lang,
       CAST(count(c.chunk_id) AS BIGINT) AS n_chunks
FROM docs d LEFT JOIN chunks c ON c.document_id = d.document_id AND c.library_id = d.library_id
GROUP BY d.library_id, d.doc_pos, d.document_id, d.lang"""))
def library_documents(spark, sf):
    """R5 at document granularity: nested documents with library metadata."""
    c = tables.corpus(spark, sf)
    n = R.library_documents(c.libraries, c.documents, c.chunks)
    return n.select("library_id", F.element_at("library_metadata", "name").alias("library_name"),
                    "doc_pos", "document_id", F.element_at("document_metadata", "lang").alias("lang"),
                    F.size("chunks").cast("bigint").alias("n_chunks"))


@register("project_chunk", with_chunks(
    "SELECT chunk_id AS id, text, CAST(len(embedding) AS BIGINT) AS dim, label, lang FROM chunks"))
def project_chunk(spark, sf):
    """Chunk read form (no document id)."""
    p = R.project_chunk(tables.chunks(spark, sf))
    return p.select("id", "text", F.size("embedding").cast("bigint").alias("dim"),
                    F.element_at("metadata", "label").alias("label"),
                    F.element_at("metadata", "lang").alias("lang"))


@register("project_document", with_chunks("SELECT document_id AS id, lang FROM docs"))
def project_document(spark, sf):
    """Document read form (no chunks)."""
    p = R.project_document(tables.documents(spark, sf))
    return p.select("id", F.element_at("metadata", "lang").alias("lang"))


@register("attach_parent", with_chunks(
    "SELECT c.chunk_id, c.document_id AS document_id FROM chunks c"))
def attach_parent(spark, sf):
    """Chunks re-parented from a wrong document id to the id of the
    document row they are attached to (the parent wins)."""
    c = tables.chunks(spark, sf).withColumn("document_id", F.concat(F.lit("wrong-"), "chunk_id"))
    emb = tables.read_table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.floor(F.col("vec_id") / 4).cast("string").alias("parent"))
    j = c.join(emb, "chunk_id")
    return R.attach_parent(j, "document_id", "parent").select("chunk_id", "document_id")


@register("default_ids", """
SELECT CAST(doc_id AS VARCHAR) AS document_id,
       CAST(row_number() OVER (ORDER BY source, doc_id) - 1 AS BIGINT) AS pos,
       md5(source || chr(1) || CAST(doc_id AS VARCHAR)) AS stable_id
FROM documents""")
def default_ids(spark, sf):
    """Dense row positions over an explicit order (computed without a
    single-task sort) and stable ids from natural keys."""
    d = tables.read_table(spark, sf, "documents").select("doc_id", "source")
    p = positions(d, [F.col("source"), F.col("doc_id")], out="pos")
    return p.select(F.col("doc_id").cast("string").alias("document_id"), "pos",
                    R.stable_id("source", "doc_id").alias("stable_id"))


@register("canonical_ids", """
SELECT CAST(doc_id AS VARCHAR) AS document_id,
       upper(substr(md5(text), 1, 8) || '-' || substr(md5(text), 9, 4) || '-' || substr(md5(text), 13, 4)
             || '-' || substr(md5(text), 17, 4) || '-' || substr(md5(text), 21, 12)) AS raw_id,
       md5(text) AS canonical,
       substr(md5(text), 1, 8) || '-' || substr(md5(text), 9, 4) || '-' || substr(md5(text), 13, 4)
             || '-' || substr(md5(text), 17, 4) || '-' || substr(md5(text), 21, 12) AS dashed
FROM documents""")
def canonical_ids(spark, sf):
    """Upper-case dashed ids (derived from each document's text) to
    the canonical undashed lower-case form and back."""
    d = tables.read_table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    raw = F.upper(R.dashed_id("h"))
    x = d.select(F.col("doc_id").cast("string").alias("document_id"), raw.alias("raw_id"))
    return x.select("document_id", "raw_id", R.canonical_id("raw_id").alias("canonical"),
                    R.dashed_id(R.canonical_id("raw_id")).alias("dashed"))


@register("join_corpus", with_chunks("""
SELECT c.chunk_id, c.document_id, c.library_id, d.doc_pos, d.lang AS document_lang,
       c.library_id AS library_name
FROM chunks c JOIN docs d ON d.document_id = c.document_id AND d.library_id = c.library_id"""))
def join_corpus(spark, sf):
    """Chunk ⋈ document ⋈ library on keys."""
    c = tables.corpus(spark, sf)
    j = R.join_corpus(c.libraries, c.documents, c.chunks)
    return j.select("chunk_id", "document_id", "library_id", "doc_pos",
                    F.element_at("document_metadata", "lang").alias("document_lang"),
                    F.element_at("library_metadata", "name").alias("library_name"))
