"""k-NN join queries."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.knn import full_ranking, knn_join, topk_one
from ..operators.rank import positions
from ..plans.index import build_index
from ..sources import tables
from . import register
from .common import r6, sql_cos, with_chunks

_RANKED = f"""ranked AS (
  SELECT q.chunk_id AS query_id, q.label AS q_label, c.chunk_id,
         {sql_cos('q.embedding', 'c.embedding')} AS score,
         row_number() OVER (PARTITION BY q.chunk_id ORDER BY {sql_cos('q.embedding', 'c.embedding')} DESC,
                            c.chunk_id) AS rank
  FROM chunks q JOIN chunks c ON c.library_id = q.library_id)"""

_KNN10 = with_chunks("SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 10",
                     _RANKED)


def _index(spark, sf):
    c = tables.corpus(spark, sf)
    return build_index(c.chunks, c.libraries).index


@register("knn_join", _KNN10)
def knn_join_scan(spark, sf):
    """J3/T2, scan kernel: every chunk queries its library, exact top 10;
    the index is streamed in place, the bounded query batch rides along."""
    h = knn_join(_index(spark, sf), tables.queries(spark, sf), k=10, kernel="scan")
    return h.select("query_id", "rank", "chunk_id", r6())


@register("knn_join_grid", _KNN10)
def knn_join_grid(spark, sf):
    """J3/T2, grid kernel: vectors and queries hashed into blocks per library,
    one co-group per block pair."""
    h = knn_join(_index(spark, sf), tables.queries(spark, sf), k=10, kernel="grid")
    return h.select("query_id", "rank", "chunk_id", r6())


@register("knn_per_query_k", with_chunks(
    "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked "
    "WHERE rank <= CAST(q_label AS INTEGER) + 1", _RANKED))
def knn_per_query_k(spark, sf):
    """T2 with a per-query k (label + 1, 1..10)."""
    h = knn_join(_index(spark, sf), tables.queries(spark, sf, k=None))
    return h.select("query_id", "rank", "chunk_id", r6())


def mean_vector(spark: SparkSession, sf: str) -> list[float]:
    """The component-wise mean of all embeddings (one aggregate; d values
    reach the driver)."""
    e = tables.read_table(spark, sf, "embeddings")
    m = (e.select(F.posexplode("embedding").alias("pos", "x"))
         .groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m")))
    rows = m.collect()
    return [r["m"] for r in sorted(rows, key=lambda r: r["pos"])]


_MEAN = """mean AS (
  SELECT list(m ORDER BY pos) AS mv FROM (
    SELECT pos, avg(x) AS m FROM (
      SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY pos)),
scored AS (SELECT c.chunk_id, c.library_id, """ + sql_cos("c.embedding", "mean.mv") + """ AS score
           FROM chunks c, mean)"""


@register("topk_one", with_chunks(
    "SELECT chunk_id, library_id, round(score, 6) AS score FROM scored "
    "ORDER BY score DESC, chunk_id LIMIT 10", _MEAN))
def topk_one_q(spark, sf):
    """Exact top 10 of the whole corpus for one query vector (the mean
    of all embeddings), as an expression plus TakeOrderedAndProject."""
    idx = _index(spark, sf)
    return topk_one(idx, mean_vector(spark, sf), k=10).select("chunk_id", "library_id", r6())


@register("full_ranking", with_chunks(
    "SELECT chunk_id, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS BIGINT) AS rank, "
    "round(score, 6) AS score FROM scored", _MEAN))
def full_ranking_q(spark, sf):
    """T5: the whole corpus ranked against the mean vector; positions come
    from the distributed ranking helper, not a single-task sort."""
    idx = _index(spark, sf)
    q = mean_vector(spark, sf)
    scored = full_ranking(idx, q)
    ranked = positions(scored, [F.col("score").desc(), F.col("chunk_id")], out="pos")
    return ranked.select("chunk_id", (F.col("pos") + 1).alias("rank"), r6())


@register("knn_all_in_library", with_chunks(
    "SELECT library_id, CAST(row_number() OVER (PARTITION BY library_id ORDER BY score DESC, chunk_id) AS BIGINT) AS rank, "
    "chunk_id, round(score, 6) AS score FROM scored", _MEAN))
def knn_all_in_library(spark, sf):
    """T5 per library: all vectors of every library ranked against the mean
    vector, without a limit; ranks come from the distributed ranking helper."""
    scored = full_ranking(_index(spark, sf), mean_vector(spark, sf))
    ranked = positions(scored, [F.col("score").desc(), F.col("chunk_id")], ["library_id"], out="pos")
    return ranked.select("library_id", (F.col("pos") + 1).alias("rank"), "chunk_id", r6())


@register("knn_join_sampled", with_chunks(
    "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 5", _RANKED))
def knn_join_sampled(spark, sf):
    """J3 with score floors: the index build keeps a seeded 50% sample; each
    query's 5th best score in the sample lets every task drop candidates
    that cannot make the top 5.  Same rows as the plain join."""
    c = tables.corpus(spark, sf)
    b = build_index(c.chunks, c.libraries, sample_fraction=0.5)
    h = knn_join(b.index, tables.queries(spark, sf), k=5, kernel="scan", sample=b.sample)
    return h.select("query_id", "rank", "chunk_id", r6())
