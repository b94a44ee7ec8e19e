"""Index job queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans import incremental
from ..plans.index import build_index, index_counts, index_freshness
from ..sources.snapshot import scratch_root
from ..sources import tables
from . import register
from .common import degenerate_chunks, degenerate_sql, with_chunks

_STAT = """stat AS (
  SELECT l.library_id,
         coalesce(x.n_chunks, 0) AS n_chunks, coalesce(x.n_empty, 0) AS n_empty,
         coalesce(x.n_dims, 0) AS n_dims, x.dim
  FROM (SELECT DISTINCT library_id FROM docs) l LEFT JOIN (
    SELECT library_id, count(*) AS n_chunks,
           sum(CASE WHEN len(embedding) = 0 THEN 1 ELSE 0 END) AS n_empty,
           count(DISTINCT CASE WHEN len(embedding) > 0 THEN len(embedding) END) AS n_dims,
           min(CASE WHEN len(embedding) > 0 THEN len(embedding) END) AS dim
    FROM deg GROUP BY library_id) x ON x.library_id = l.library_id)"""


@register("index_build", with_chunks("""
SELECT library_id,
       CASE WHEN n_empty > 0 THEN 'empty_embeddings' WHEN n_dims > 1 THEN 'inconsistent_dimensions'
            ELSE 'indexed' END AS status,
       CAST(CASE WHEN n_empty = 0 AND n_dims <= 1 THEN n_chunks ELSE 0 END AS BIGINT) AS n_indexed,
       CAST(CASE WHEN n_empty = 0 AND n_dims <= 1 THEN coalesce(dim, 0) ELSE 0 END AS INTEGER) AS dim
FROM stat""", f"deg AS ({degenerate_sql(True, True)}), {_STAT}"))
def index_build(spark, sf):
    """X1 strict: libraries with an empty vector or two dimensions are
    refused; the rest are indexed (count and dimension per library; 0 for a
    refused library)."""
    c = tables.corpus(spark, sf)
    b = build_index(degenerate_chunks(spark, sf), c.libraries, mode="strict")
    return _status(b)


def _status(b):
    return (b.report.select("library_id", "status")
            .join(b.meta.select("library_id", F.col("n").alias("n_indexed"), "dim"), "library_id", "left")
            .select("library_id", "status", F.coalesce("n_indexed", F.lit(0)).cast("bigint").alias("n_indexed"),
                    F.coalesce("dim", F.lit(0)).cast("int").alias("dim")))


@register("index_lenient", with_chunks("""
SELECT library_id,
       CASE WHEN n_chunks - n_empty = 0 THEN 'nothing_to_index' WHEN n_dims > 1 THEN 'inconsistent_dimensions'
            ELSE 'indexed' END AS status,
       CAST(CASE WHEN n_chunks - n_empty > 0 AND n_dims <= 1 THEN n_chunks - n_empty ELSE 0 END AS BIGINT)
         AS n_indexed,
       CAST(CASE WHEN n_chunks - n_empty > 0 AND n_dims <= 1 THEN coalesce(dim, 0) ELSE 0 END AS INTEGER) AS dim
FROM stat""", f"deg AS ({degenerate_sql(True, False)}), {_STAT}"))
def index_lenient(spark, sf):
    """Lenient rebuild skips empty vectors (F4) and indexes the rest."""
    c = tables.corpus(spark, sf)
    b = build_index(degenerate_chunks(spark, sf, toxic=True, short=False), c.libraries, mode="lenient")
    return _status(b)


@register("index_rows", with_chunks(
    "SELECT library_id, chunk_id, CAST(len(embedding) AS BIGINT) AS dim, "
    "round(CASE WHEN list_dot_product(embedding, embedding) > 0 THEN 1 / sqrt(list_dot_product(embedding, embedding)) "
    "ELSE 0 END, 6) AS inv_norm FROM deg WHERE len(embedding) > 0",
    f"deg AS ({degenerate_sql(True, False)})"))
def index_rows(spark, sf):
    """X2 output rows: every non-empty vector with its stored 1/|v|."""
    c = tables.corpus(spark, sf)
    b = build_index(degenerate_chunks(spark, sf, toxic=True, short=False), c.libraries, mode="lenient")
    return b.index.select("library_id", "chunk_id", F.size("vector").cast("bigint").alias("dim"),
                          F.round("inv_norm", 6).alias("inv_norm"))


_FRESHNESS_CTES = """idx AS (SELECT library_id, chunk_id, embedding FROM chunks WHERE lang <> 'de'),
cur AS (SELECT c.library_id, c.chunk_id,
               CASE WHEN l.quality = 0 THEN list_reverse(c.embedding) ELSE c.embedding END AS embedding
        FROM chunks c LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = c.document_id
        WHERE coalesce(l.toxic, 0) = 0)"""
_FRESHNESS_SQL = with_chunks("""
SELECT coalesce(c.library_id, i.library_id) AS library_id, coalesce(c.chunk_id, i.chunk_id) AS chunk_id,
       CASE WHEN i.chunk_id IS NULL THEN 'not_indexed' WHEN c.chunk_id IS NULL THEN 'deleted'
            ELSE 'changed' END AS state
FROM cur c FULL OUTER JOIN idx i ON c.library_id = i.library_id AND c.chunk_id = i.chunk_id
WHERE i.chunk_id IS NULL OR c.chunk_id IS NULL OR c.embedding <> i.embedding""", _FRESHNESS_CTES)


def _old_and_current(spark, sf):
    """The build from when German chunks were not there yet, and the current chunks: documents labelled toxic
    were deleted, low-quality ones got new vectors."""
    c = tables.corpus(spark, sf)
    b = build_index(c.chunks.filter(F.element_at("metadata", "lang") != "de"), c.libraries)
    lab = tables.read_table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("document_id"), "toxic", "quality")
    cur = (c.chunks.join(lab, "document_id", "left")
           .filter(F.coalesce("toxic", F.lit(0)) == 0)
           .withColumn("embedding", F.when(F.col("quality") == 0, F.reverse("embedding"))
                       .otherwise(F.col("embedding"))))
    return b, cur, c.libraries


@register("index_freshness", _FRESHNESS_SQL)
def index_freshness_q(spark, sf):
    """An older index against the current chunks."""
    b, cur, _ = _old_and_current(spark, sf)
    return index_freshness(b.index, cur)


def _published(spark, sf):
    b, cur, libraries = _old_and_current(spark, sf)
    root = scratch_root(spark, f"incremental-{uuid.uuid4().hex}")
    incremental.publish(b, root)
    return root, cur, libraries


@register("index_freshness_digests", _FRESHNESS_SQL)
def index_freshness_digests(spark, sf):
    """X5 by stored digests: only the buckets whose digests differ are opened."""
    root, cur, _ = _published(spark, sf)
    return incremental.freshness(spark, root, cur)


@register("index_refresh", with_chunks(
    "SELECT library_id, chunk_id, round(embedding[1], 6) AS first, round(embedding[64], 6) AS last FROM cur WHERE len(embedding) > 0", _FRESHNESS_CTES))
def index_refresh(spark, sf):
    """X2 of what changed: the stale buckets are written anew, the others stay; the rows of the refreshed index."""
    root, cur, libraries = _published(spark, sf)
    incremental.refresh(spark, root, cur, libraries)
    index, _meta = incremental.read(spark, root)
    return index.select("library_id", "chunk_id", F.round(F.col("vector")[0].cast("double"), 6).alias("first"), F.round(F.col("vector")[63].cast("double"), 6).alias("last"))


@register("index_counts", with_chunks("""
SELECT l.library_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_documents,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_chunks, CAST(coalesce(c.nd, 0) AS BIGINT) AS n_documents_with_chunks,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_indexed
FROM (SELECT DISTINCT library_id FROM docs) l
LEFT JOIN (SELECT library_id, count(*) AS n FROM docs GROUP BY library_id) d ON d.library_id = l.library_id
LEFT JOIN (SELECT library_id, count(*) AS n, count(DISTINCT document_id) AS nd FROM chunks GROUP BY library_id) c
  ON c.library_id = l.library_id"""))
def index_counts_q(spark, sf):
    """A1: documents, chunks and index size per library (zeros kept)."""
    c = tables.corpus(spark, sf)
    b = build_index(c.chunks, c.libraries)
    return index_counts(c.chunks, c.documents, c.libraries, b.meta)
