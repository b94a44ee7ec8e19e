"""Vector scalar queries (C1-C6) and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.sql import register_sql_functions
from ..sources import tables
from . import register
from .common import sql_cos, sql_norm, with_chunks


@register("vec_size", with_chunks("SELECT chunk_id, CAST(len(embedding) AS BIGINT) AS dim FROM chunks"))
def vec_size(spark, sf):
    """Vector length of every chunk."""
    return tables.chunks(spark, sf).select("chunk_id", V.vec_size("embedding").cast("bigint").alias("dim"))


@register("vec_norm", with_chunks(f"SELECT chunk_id, round({sql_norm('embedding')}, 6) AS norm FROM chunks"))
def vec_norm(spark, sf):
    """L2 norm of every chunk vector."""
    return tables.chunks(spark, sf).select("chunk_id", F.round(V.vec_norm("embedding"), 6).alias("norm"))


@register("vec_normalize", with_chunks(f"""
SELECT chunk_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos,
       round(CASE WHEN {sql_norm('embedding')} > 0 THEN unnest(embedding) / {sql_norm('embedding')}
                  ELSE unnest(embedding) END, 6) AS value
FROM chunks"""))
def vec_normalize(spark, sf):
    """Unit vectors, one row per component."""
    c = tables.chunks(spark, sf).select("chunk_id", V.vec_normalize("embedding").alias("u"))
    return c.select("chunk_id", F.posexplode("u").alias("pos", "value")).select(
        "chunk_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@register("vec_dot", with_chunks(
    "SELECT chunk_id, round(list_dot_product(embedding, list_reverse(embedding)), 6) AS dot FROM chunks"))
def vec_dot(spark, sf):
    """Dot product of each vector with its own reversal."""
    return tables.chunks(spark, sf).select(
        "chunk_id", F.round(V.vec_dot("embedding", F.reverse("embedding")), 6).alias("dot"))


_PAIRS = """pairs AS (
  SELECT a.chunk_id, b.chunk_id AS prev_chunk_id, a.embedding AS x, b.embedding AS y
  FROM chunks a JOIN chunks b
    ON a.library_id = b.library_id AND a.document_id = b.document_id AND b.chunk_pos = a.chunk_pos - 1)"""


def _pairs(spark, sf):
    c = tables.chunks(spark, sf)
    prev = c.select("library_id", "document_id", (F.col("chunk_pos") + 1).alias("chunk_pos"),
                    F.col("chunk_id").alias("prev_chunk_id"), F.col("embedding").alias("y"))
    return c.select("library_id", "document_id", "chunk_pos", "chunk_id", F.col("embedding").alias("x")) \
        .join(prev, ["library_id", "document_id", "chunk_pos"])


@register("cosine_sim", with_chunks(
    f"SELECT chunk_id, prev_chunk_id, round({sql_cos('x', 'y')}, 6) AS cos FROM pairs", _PAIRS))
def cosine_sim(spark, sf):
    """C4: cosine similarity of each chunk with the previous chunk of its
    document (an equi-join on position, not a pairing of all chunks)."""
    return _pairs(spark, sf).select("chunk_id", "prev_chunk_id", F.round(V.cosine_sim("x", "y"), 6).alias("cos"))


@register("cosine_dist", with_chunks(
    f"SELECT chunk_id, prev_chunk_id, round(1 - {sql_cos('x', 'y')}, 6) AS dist FROM pairs", _PAIRS))
def cosine_dist(spark, sf):
    """Cosine distance to the previous chunk of the document."""
    return _pairs(spark, sf).select("chunk_id", "prev_chunk_id", F.round(V.cosine_dist("x", "y"), 6).alias("dist"))


@register("sql_functions", with_chunks(
    f"SELECT chunk_id, CAST(len(embedding) AS BIGINT) AS dim, round({sql_norm('embedding')}, 6) AS norm, "
    f"round({sql_cos('embedding', 'list_reverse(embedding)')}, 6) AS cos_rev, "
    f"round(1 - {sql_cos('embedding', 'list_reverse(embedding)')}, 6) AS dist_rev FROM chunks"))
def sql_functions(spark, sf):
    """The vector functions called from Spark SQL."""
    register_sql_functions(spark)
    tables.chunks(spark, sf).createOrReplaceTempView("vellum_chunks")
    return spark.sql("""
        SELECT chunk_id, CAST(vec_size(embedding) AS BIGINT) AS dim, round(vec_norm(embedding), 6) AS norm,
               round(cosine_sim(embedding, reverse(embedding)), 6) AS cos_rev,
               round(cosine_dist(embedding, reverse(embedding)), 6) AS dist_rev
        FROM vellum_chunks""")
