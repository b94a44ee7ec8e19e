"""Embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.embed import embed_and_insert, embed_column
from ..operators.mutate import Corpus3
from ..sources import tables
from . import register

_HASH_SQL = """
WITH toks AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM documents),
b AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS BIGINT) AS bucket,
             count(*) AS c
      FROM toks WHERE t <> '' GROUP BY doc_id, bucket),
n AS (SELECT doc_id, sqrt(sum(c * c)) AS nrm FROM b GROUP BY doc_id)
SELECT CAST(b.doc_id AS VARCHAR) AS document_id, b.bucket,
       round(CAST(CAST(b.c / n.nrm AS FLOAT) AS DOUBLE), 6) AS value
FROM b JOIN n ON n.doc_id = b.doc_id"""


@register("embed_hash", _HASH_SQL)
def embed_hash(spark, sf):
    """Every document's whole text embedded by the built-in hashing
    provider in Arrow batches; the non-zero components."""
    d = tables.read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    e = embed_column(d, "text")
    x = e.select("document_id", F.posexplode("embedding").alias("bucket", "value"))
    return x.filter(F.col("value") != 0).select(
        "document_id", F.col("bucket").cast("bigint").alias("bucket"),
        F.round(F.col("value").cast("double"), 6).alias("value"))


@register("embed_insert", """
WITH lab AS (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM labels),
docs AS (SELECT source AS library_id, CAST(doc_id AS VARCHAR) AS document_id, text FROM documents),
kept AS (SELECT d.source AS library_id, CAST(e.vec_id // 4 AS VARCHAR) AS document_id, CAST(e.vec_id AS VARCHAR) AS chunk_id,
                CAST(e.vec_id % 4 AS BIGINT) AS chunk_pos
         FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id // 4),
mx AS (SELECT document_id, max(chunk_pos) AS m FROM kept GROUP BY document_id)
SELECT chunk_id, document_id, chunk_pos FROM kept
UNION ALL
SELECT 'emb-' || d.document_id, d.document_id, CAST(coalesce(mx.m, -1) + 1 AS BIGINT)
FROM docs d JOIN lab ON lab.document_id = d.document_id LEFT JOIN mx ON mx.document_id = d.document_id""")
def embed_insert(spark, sf):
    """Embed the whole text of every labelled document and insert it as a
    new chunk at the end of that document (parent checks, parent id forced)."""
    c = tables.corpus(spark, sf)
    lab = tables.read_table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    docs = tables.read_table(spark, sf, "documents").select(
        F.col("source").alias("library_id"), F.col("doc_id").cast("string").alias("document_id"), "text")
    new = docs.join(lab, "document_id").select(
        "library_id", "document_id", F.concat(F.lit("emb-"), "document_id").alias("chunk_id"), "text",
        F.create_map(F.lit("origin"), F.lit("embedded")).alias("metadata"), F.lit(0).alias("seq"))
    out, _rejects = embed_and_insert(Corpus3(c.libraries, c.documents, c.chunks), new)
    return out.chunks.select("chunk_id", "document_id", "chunk_pos")


@register("embed_rejects", """
SELECT DISTINCT 'conv-' || CAST(conv_id AS VARCHAR) AS document_id,
  'turn-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS chunk_id, 'not_found:Library' AS reason
FROM conversations
UNION ALL
SELECT 'conv-' || source, 'doc-' || CAST(doc_id AS VARCHAR), 'not_found:Document' FROM documents""")
def embed_rejects(spark, sf):
    """E2 rejects: every turn of every conversation sent to a library that does not
    exist, and every document's text sent to a document its library does not hold."""
    c = tables.corpus(spark, sf)
    conv = tables.read_table(spark, sf, "conversations")
    text = lambda col: F.col(col).cast("string")
    common = [F.create_map().cast("map<string,string>").alias("metadata"), F.lit(0).alias("seq")]
    turns = conv.select(F.lit("conversations").alias("library_id"),
                        F.concat(F.lit("conv-"), text("conv_id")).alias("document_id"),
                        F.concat(F.lit("turn-"), text("conv_id"), F.lit("-"), text("turn")).alias("chunk_id"), "text", *common)
    docs = tables.read_table(spark, sf, "documents").select(
        F.col("source").alias("library_id"), F.concat(F.lit("conv-"), "source").alias("document_id"),
        F.concat(F.lit("doc-"), text("doc_id")).alias("chunk_id"), "text", *common)
    _out, rejects = embed_and_insert(Corpus3(c.libraries, c.documents, c.chunks), turns.unionByName(docs))
    return rejects.select("document_id", "chunk_id", "reason")
