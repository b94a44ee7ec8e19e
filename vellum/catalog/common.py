"""Shared pieces of the registered queries: the corpus binding in Spark and
the same binding in SQL, and SQL spellings of the vector functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

# The chunks binding of vellum.sources.tables, in DuckDB SQL (a CTE body).
CHUNKS_SQL = """
  SELECT d.source AS library_id,
         CAST(e.vec_id // 4 AS VARCHAR) AS document_id,
         CAST(e.vec_id AS VARCHAR) AS chunk_id,
         CAST(e.vec_id % 4 AS BIGINT) AS chunk_pos,
         substring(d.text, CAST((e.vec_id % 4) * ceil(length(d.text) / 4) + 1 AS INTEGER),
                   CAST(ceil(length(d.text) / 4) AS INTEGER)) AS text,
         e.embedding::DOUBLE[] AS embedding,
         CAST(e.label AS VARCHAR) AS label,
         d.lang AS lang
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id // 4
"""

DOCUMENTS_SQL = """
  SELECT source AS library_id, CAST(doc_id AS VARCHAR) AS document_id,
         CAST(doc_id AS BIGINT) AS doc_pos, lang
  FROM documents
"""

# Degenerate vectors derived from the labels table: chunks of documents
# labelled toxic lose their vector (empty), chunks of documents labelled low
# quality keep only their first 32 components (a second dimension).
def degenerate_sql(toxic: bool = True, short: bool = True) -> str:
    cases = []
    if toxic:
        cases.append("WHEN l.toxic = 1 THEN []::DOUBLE[]")
    if short:
        cases.append("WHEN l.quality = 0 THEN c.embedding[1:32]")
    emb = f"CASE {' '.join(cases)} ELSE c.embedding END" if cases else "c.embedding"
    return f"""
  SELECT c.library_id, c.document_id, c.chunk_id, c.chunk_pos, c.text, c.label, c.lang,
         {emb} AS embedding
  FROM chunks c LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = c.document_id
"""


DEGENERATE_SQL = degenerate_sql()


def sql_norm(a: str) -> str:
    return f"sqrt(list_dot_product({a}, {a}))"


def sql_cos(a: str, b: str) -> str:
    return (f"(CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0.0 "
            f"ELSE list_dot_product({a}, {b}) / ({sql_norm(a)} * {sql_norm(b)}) END)")


def with_chunks(body: str, extra: str = "") -> str:
    """SQL with the chunks (and documents) binding as CTEs."""
    ctes = f"chunks AS ({CHUNKS_SQL}), docs AS ({DOCUMENTS_SQL})"
    if extra:
        ctes += ", " + extra
    return f"WITH {ctes}\n{body}"


def degenerate_chunks(spark: SparkSession, sf: str, toxic: bool = True, short: bool = True) -> DataFrame:
    """Spark twin of :func:`degenerate_sql`."""
    c = tables.chunks(spark, sf)
    lab = tables.read_table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("document_id"), "toxic", "quality")
    j = c.join(lab, "document_id", "left")
    emb = F.col("embedding")
    if short:
        emb = F.when(F.col("quality") == 0, F.slice("embedding", 1, 32)).otherwise(emb)
    if toxic:
        emb = F.when(F.col("toxic") == 1, F.array().cast("array<float>")).otherwise(emb)
    return j.select("library_id", "document_id", "chunk_id", "chunk_pos", "text",
                    emb.alias("embedding"), "metadata")


def r6(col: str = "score"):
    return F.round(F.col(col), 6).alias(col)
