"""Flagship search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.index import build_index
from ..plans.search import chunks_only, hits_nested, search, search_prefiltered
from ..sources import tables
from . import register
from .common import degenerate_sql, r6, sql_cos, with_chunks, degenerate_chunks

_SCORED = f"""scored AS (
  SELECT q.chunk_id AS query_id, q.label AS q_label, c.chunk_id, c.document_id, c.text, c.label,
         c.lang, {sql_cos('q.embedding', 'c.embedding')} AS score
  FROM chunks q JOIN chunks c ON c.library_id = q.library_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM scored)"""


def _search(spark, sf, k=10, filter_keys=(), **opts):
    c = tables.corpus(spark, sf)
    b = build_index(c.chunks, c.libraries)
    q = tables.queries(spark, sf, k=k, filter_keys=filter_keys)
    return search(b.index, b.meta, c.chunks, q, **opts)


@register("search_topk", with_chunks(
    "SELECT query_id, rank, chunk_id, document_id, round(score, 6) AS score, text "
    "FROM ranked WHERE rank <= 10", _SCORED))
def search_topk(spark, sf):
    """T3 without filters: top 10 of every query in its library, with text."""
    h = _search(spark, sf).hits
    return h.select("query_id", "rank", "chunk_id", "document_id", r6(), "text")


@register("search_filtered", with_chunks(
    "SELECT query_id, rank, chunk_id, document_id, round(score, 6) AS score, text "
    "FROM ranked WHERE rank <= 10 AND label = q_label", _SCORED))
def search_filtered(spark, sf):
    """T3, the flagship: top 10, then the per-query metadata filter
    ``label = own label`` applied after the cut (fewer than 10 rows remain)."""
    h = _search(spark, sf, filter_keys=("label",)).hits
    return h.select("query_id", "rank", "chunk_id", "document_id", r6(), "text")


@register("search_filtered_multi", with_chunks(
    "SELECT r.query_id, r.rank, r.chunk_id, round(r.score, 6) AS score "
    "FROM ranked r JOIN chunks qc ON qc.chunk_id = r.query_id "
    "WHERE rank <= 10 AND r.label = r.q_label AND r.lang = qc.lang", _SCORED))
def search_filtered_multi(spark, sf):
    """F1 with two keys (AND): label and lang must both match."""
    h = _search(spark, sf, filter_keys=("label", "lang")).hits
    return h.select("query_id", "rank", "chunk_id", r6())


@register("search_nested", with_chunks(
    "SELECT query_id, rank, chunk_id, round(score, 6) AS score, length(text) AS text_len "
    "FROM ranked WHERE rank <= 5", _SCORED))
def search_nested(spark, sf):
    """Hits in the wire form struct(chunk, score), read back as scalars."""
    h = hits_nested(_search(spark, sf, k=5).hits)
    return h.select("query_id", "rank", F.col("hit.chunk.id").alias("chunk_id"),
                    F.round("hit.score", 6).alias("score"),
                    F.length("hit.chunk.text").cast("bigint").alias("text_len"))


@register("search_chunks_only", with_chunks(
    "SELECT query_id, rank, chunk_id, document_id FROM ranked WHERE rank <= 5", _SCORED))
def search_chunks_only(spark, sf):
    """Chunks only, no score (``rank`` keeps the order); default k=5."""
    c = tables.corpus(spark, sf)
    b = build_index(c.chunks, c.libraries)
    q = tables.queries(spark, sf, k=10, filter_keys=()).withColumn("k", F.lit(None).cast("int"))
    h = chunks_only(search(b.index, b.meta, c.chunks, q).hits)
    return h.select("query_id", "rank", "chunk_id", "document_id")


@register("search_prefiltered", with_chunks(
    "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ("
    " SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank"
    " FROM scored WHERE lang = 'en') WHERE rank <= 10", _SCORED.split(",\nranked")[0]))
def search_prefiltered_q(spark, sf):
    """Filter first (lang = en), then the top 10: up to 10 rows per query."""
    c = tables.corpus(spark, sf)
    b = build_index(c.chunks, c.libraries)
    q = tables.queries(spark, sf, k=10, filter_keys=())
    h = search_prefiltered(b.index, b.meta, c.chunks, q, {"lang": "en"}).hits
    return h.select("query_id", "rank", "chunk_id", r6())


_REJECT_SQL = with_chunks(f"""
SELECT q.chunk_id AS query_id, q.library_id,
       CASE WHEN q.k < 1 OR q.k > 100 THEN 'k_out_of_range'
            WHEN NOT s.indexed THEN 'not_indexed'
            WHEN s.n > 0 AND coalesce(len(q.embedding), -1) <> s.dim THEN 'dimension_mismatch'
       END AS reason
FROM (SELECT *, CAST(label AS INTEGER) * 15 - 10 AS k FROM qdeg) q
JOIN libstat s ON s.library_id = q.library_id
WHERE (q.k < 1 OR q.k > 100) OR NOT s.indexed
   OR (s.n > 0 AND coalesce(len(q.embedding), -1) <> s.dim)
""", f"""deg AS ({degenerate_sql(True, False)}), qdeg AS ({degenerate_sql(True, True)}),
libstat AS (
  SELECT l.library_id,
         coalesce(x.n_empty, 0) = 0 AND coalesce(x.n_dims, 0) <= 1 AS indexed,
         coalesce(x.n, 0) AS n, x.dim
  FROM (SELECT DISTINCT library_id FROM docs) l
  LEFT JOIN (SELECT library_id,
                    sum(CASE WHEN len(embedding) = 0 THEN 1 ELSE 0 END) AS n_empty,
                    count(DISTINCT CASE WHEN len(embedding) > 0 THEN len(embedding) END) AS n_dims,
                    sum(CASE WHEN len(embedding) > 0 THEN 1 ELSE 0 END) AS n,
                    min(CASE WHEN len(embedding) > 0 THEN len(embedding) END) AS dim
             FROM deg GROUP BY library_id) x ON x.library_id = l.library_id)""")


@register("query_rejects", _REJECT_SQL)
def query_rejects(spark, sf):
    """V4 + V5 + V9 on one batch: a strict index of a corpus where the chunks
    of toxic-labelled documents have empty vectors (their libraries are
    refused, so not indexed), queried by every chunk with k = 15*label - 10
    (some outside 1..100), low-quality chunks with 32-d vectors (dimension
    mismatch) and toxic ones with empty vectors."""
    c = tables.corpus(spark, sf)
    deg = degenerate_chunks(spark, sf, toxic=True, short=False)
    qdeg = degenerate_chunks(spark, sf, toxic=True, short=True)
    b = build_index(deg, c.libraries, mode="strict")
    q = qdeg.select(F.col("chunk_id").alias("query_id"), "library_id", "embedding",
                   (F.element_at("metadata", "label").cast("int") * 15 - 10).alias("k"))
    return search(b.index, b.meta, deg, q).rejects.select("query_id", "library_id", "reason")
