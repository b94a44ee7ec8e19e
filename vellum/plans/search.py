"""Library search (T3, the flagship), with its checks and projections.

Plan, for a whole table of queries at once::

    queries ─ V5 k default/range ─ V9 indexed? ─ V4 dimension ─┐ rejects
        └─ accepted ─ knn_join(index)  (exact top-k per query, §knn)
                        └─ ⋈ chunks on (library_id, chunk_id)   J1 + F7
                              └─ post-filter on metadata          F1/F2/F3

The filter runs *after* the top-k, as the reference does: a query may get
fewer than k rows.  Hits are at most k per query.  They are written once;
up to ``HITS_BROADCAST_ROWS`` rows and ``HITS_BROADCAST_BYTES`` (both measured) they
are broadcast and the chunk table is read in place, beyond that both sides are
shuffled by key.
:func:`search_prefiltered` is the other query (filter first, then top-k).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maps import metadata_equals, metadata_matches
from ..functions.vector import has_non_finite
from ..operators.knn import knn_join
from ..schema import DEFAULT_K, MAX_K, MIN_K
from ..session import ensure_checkpoint_dir, fresh

HITS_BROADCAST_ROWS = 200_000
HITS_BROADCAST_BYTES = 32 << 20


@dataclass
class SearchResult:
    hits: DataFrame
    rejects: DataFrame


def validate_queries(queries: DataFrame, meta: DataFrame, default_k: int = DEFAULT_K, once: bool = False):
    """V5, V9, V4: split queries into accepted and rejected rows.

    ``reason`` is one of ``missing_embedding``, ``non_finite``, ``k_out_of_range``,
    ``not_indexed``, ``dimension_mismatch`` and ``duplicate_query`` (first failing
    check wins).  A query is known by ``(library_id, query_id)``; one given twice is
    ambiguous and every row of it is rejected.  ``once``: the decided queries are written (checkpoint), for callers
    that read them several times.  A
    library whose index is empty accepts any dimension (and then returns no
    hits)."""
    if "k" not in queries.columns:
        queries = queries.withColumn("k", F.lit(None).cast("int"))
    q = queries.withColumn("k", F.coalesce(F.col("k"), F.lit(default_k)).cast("int"))
    m = meta.select("library_id", F.col("dim").alias("_dim"), F.col("n").alias("_n"),
                    F.lit(True).alias("_indexed"))
    key = ["library_id", "query_id"]
    twice = fresh(q.groupBy(*key).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1"))
    j = q.join(m, "library_id", "left").join(twice, key, "left")
    reason = (F.when(F.col("embedding").isNull(), F.lit("missing_embedding"))
              .when(has_non_finite("embedding"), F.lit("non_finite"))
              .when((F.col("k") < MIN_K) | (F.col("k") > MAX_K), F.lit("k_out_of_range"))
              .when(F.col("_indexed").isNull(), F.lit("not_indexed"))
              .when((F.col("_n") > 0) & (F.coalesce(F.size("embedding"), F.lit(-1)) != F.col("_dim")),
                    F.lit("dimension_mismatch"))
              .when(F.col("_times") > 1, F.lit("duplicate_query")))
    j = j.withColumn("reason", reason)
    if once:
        j = j.checkpoint()
    accepted = j.filter(F.col("reason").isNull()).drop("_dim", "_n", "_indexed", "_times", "reason")
    rejects = j.filter(F.col("reason").isNotNull()).select("query_id", "library_id", "reason")
    return accepted, rejects


def search(index: DataFrame, meta: DataFrame, chunks: DataFrame, queries: DataFrame, *,
           default_k: int = DEFAULT_K, kernel: str = "auto",
           strategy: str = "exact", cells: DataFrame | None = None, blocks: DataFrame | None = None, **knn_opts) -> SearchResult:
    """Search every query of ``queries`` in its library.  ``strategy='cells'`` goes down the
    tree of ``blocks`` (:func:`vellum.operators.tree.build_blocks`), or takes ``cells`` with their rows as ``index``.

    Returns hits ``query_id, library_id, rank, chunk_id, document_id, score,
    text, embedding, metadata`` (``rank`` is the position in the unfiltered
    top-k) and rejects ``query_id, library_id, reason``."""
    ensure_checkpoint_dir(queries.sparkSession)
    accepted, rejects = validate_queries(queries, meta, default_k, once=True)
    if "filters" not in accepted.columns:
        accepted = accepted.withColumn("filters", F.create_map().cast("map<string,string>"))
    live = fresh(chunks.select("library_id", "chunk_id", "document_id", "text", "embedding", "metadata"))
    idx = index
    if strategy == "exact":
        top = knn_join(idx, accepted, kernel=kernel, **knn_opts)
    elif strategy == "cells":
        from ..operators.cells import knn_cells
        from ..operators.tree import knn_tree
        if cells is None and blocks is None:
            raise ValueError("strategy='cells' needs the blocks or the cells table")
        top = knn_tree(blocks, accepted, **knn_opts) if blocks is not None else knn_cells(idx, cells, accepted, **knn_opts)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    # the hits, at most k a query, are written once and their size decides how they meet the chunks
    found = (fresh(top).join(fresh(accepted.select("library_id", "query_id", "filters")), ["library_id", "query_id"])
             .select("query_id", "library_id", "rank", "chunk_id", "score", "filters"))
    found = found.checkpoint()
    ids = F.length("query_id") + F.length("library_id") + F.length("chunk_id")
    size = found.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.lit(64) + 4 * (ids + F.length(F.to_json("filters")))).alias("bytes")).first()
    small = size["n"] <= HITS_BROADCAST_ROWS and (size["bytes"] or 0) <= HITS_BROADCAST_BYTES
    hits = (live.join(F.broadcast(found) if small else found, ["library_id", "chunk_id"])   # J1, F7
            .filter(metadata_matches("metadata", "filters"))                                # F1-F3
            .select("query_id", "library_id", "rank", "chunk_id", "document_id", "score",
                    "text", "embedding", "metadata"))
    return SearchResult(hits, rejects)


def search_prefiltered(index: DataFrame, meta: DataFrame, chunks: DataFrame, queries: DataFrame,
                       filters: dict[str, str], *, default_k: int = DEFAULT_K, **knn_opts) -> SearchResult:
    """Filter first, then top-k (a different query from T3: up to k rows
    whatever the filter).  The constant filter is pushed down to the chunk
    scan by Catalyst."""
    cond: Column = F.lit(True)
    for key, val in filters.items():
        cond = cond & metadata_equals("metadata", key, val)
    keep = chunks.filter(cond).select("library_id", "chunk_id")
    sub = index.join(keep, ["library_id", "chunk_id"], "left_semi")
    return search(sub, meta, chunks, queries.withColumn("filters", F.create_map().cast("map<string,string>")),
                  default_k=default_k, **knn_opts)


def hits_nested(hits: DataFrame) -> DataFrame:
    """The wire form, one row per hit ``struct(chunk, score)`` in rank order."""
    return hits.select("query_id", "rank", F.struct(
        F.struct(F.col("chunk_id").alias("id"), "text", "embedding", "metadata").alias("chunk"),
        F.col("score")).alias("hit"))


def chunks_only(hits: DataFrame) -> DataFrame:
    """Scoreless search, same rows and order (``rank`` kept for order)."""
    return hits.drop("score")


def search_library(index: DataFrame, meta: DataFrame, chunks: DataFrame, library_id: str,
                   embedding: list[float], k: int = DEFAULT_K,
                   metadata_filters: dict[str, str] | None = None) -> DataFrame:
    """T3 for one request, the reference's ``search(library_id, embedding, k,
    metadata_filters)``: the checks raise (not indexed, dimension, k range),
    the top-k is an expression over the library's index rows with
    ``TakeOrderedAndProject``, then hits are joined to the live chunks and
    post-filtered.  Reads one row of ``meta`` to decide the checks."""
    from ..operators.knn import topk_one

    if not MIN_K <= k <= MAX_K:
        raise ValueError(f"k must be within {MIN_K}..{MAX_K}, got {k}")
    if not all(x is not None and math.isfinite(x) for x in embedding):
        raise ValueError("a component of the query is not a finite number")
    m = meta.filter(F.col("library_id") == library_id).select("dim", "n").first()
    if m is None:
        raise LookupError(f"{library_id}: not indexed")
    if m["n"] and len(embedding) != m["dim"]:
        raise ValueError(f"dimension {len(embedding)} of the query is not the library's {m['dim']}")
    if not m["n"]:
        return chunks.limit(0).select("library_id", F.lit(0).cast("long").alias("rank"), "chunk_id",
                                      "document_id", F.lit(0.0).alias("score"), "text", "embedding", "metadata")
    top = topk_one(index, embedding, k=k, library_id=library_id)
    # k rows at most: numbering them in one partition is bounded by k
    ranked = top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("score").desc(), F.col("chunk_id"))))
    live = chunks.filter(F.col("library_id") == library_id).select(
        "library_id", "chunk_id", "document_id", "text", "embedding", "metadata")
    hits = ranked.join(live, ["library_id", "chunk_id"])
    filt = F.create_map(*[x for kv in (metadata_filters or {}).items() for x in (F.lit(kv[0]), F.lit(kv[1]))]) \
        if metadata_filters else F.create_map().cast("map<string,string>")
    return (hits.filter(metadata_matches("metadata", filt))
            .select("library_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "document_id", "score",
                    "text", "embedding", "metadata"))
