"""Data-quality operators.

Each returns a *report* DataFrame (rows that fail, with a reason) and never
raises by itself; :func:`require_empty` turns a report into a failing job
for strict callers, with ``assert_true`` inside the plan so the check runs on
the executors as part of the same scan.  Library-level checks (V1, V2) live
in :func:`vellum.plans.index.library_report`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_K, MAX_K, MIN_K


def non_empty_vectors(chunks: DataFrame, col: str = "embedding") -> DataFrame:
    """rows with a non-empty vector."""
    return chunks.filter(F.col(col).isNotNull() & (F.size(col) > 0))


def dimension_mismatch(vectors: DataFrame, dim: int | str, col: str = "embedding",
                       id_col: str = "chunk_id") -> DataFrame:
    """V3: rows whose vector length differs from the declared dimension
    (a constant, or a column such as a joined per-library ``dim``)."""
    d = F.lit(dim) if isinstance(dim, int) else F.col(dim)
    size = F.coalesce(F.size(col), F.lit(-1))
    return (vectors.filter(size != d)
            .withColumn("expected_dim", d.cast("int"))
            .withColumn("actual_dim", F.size(col).cast("int")))


def k_rejects(queries: DataFrame, default_k: int = DEFAULT_K) -> DataFrame:
    """V5: queries whose k (default 5 when NULL) is outside 1..100."""
    k = F.coalesce(F.col("k"), F.lit(default_k))
    return (queries.withColumn("k", k.cast("int"))
            .filter((F.col("k") < MIN_K) | (F.col("k") > MAX_K)))


def null_report(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """V6: rows with a NULL id or a NULL vector (ids and vectors share a row,
    so "length agreement" reduces to this)."""
    return vectors.filter(F.col(id_col).isNull() | F.col(vec_col).isNull()).withColumn(
        "problem", F.when(F.col(id_col).isNull(), F.lit("null_id")).otherwise(F.lit("null_vector")))


def orphans(children: DataFrame, parents: DataFrame, keys: list[str], resource_type: str,
            id_col: str) -> DataFrame:
    """V7: children whose parent key is missing, reported as
    ``resource_type, resource_id`` (the not-found error's content)."""
    return (children.join(parents.select(*keys).distinct(), keys, "left_anti")
            .withColumn("resource_type", F.lit(resource_type))
            .withColumn("resource_id", F.col(id_col)))


def with_parent(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """V7 accepted side: children whose parent exists (``left_semi``)."""
    return children.join(parents.select(*keys), keys, "left_semi")


def duplicate_keys(batch: DataFrame, keys: list[str], existing: DataFrame | None = None) -> DataFrame:
    """V8: keys repeated inside ``batch`` (``in_batch``) or already present in
    ``existing`` (``exists``); one row per offending key and reason."""
    dup = (batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") > 1).select(*keys, F.lit("in_batch").alias("reason")))
    if existing is None:
        return dup
    clash = (batch.select(*keys).distinct().join(existing.select(*keys), keys, "left_semi")
             .select(*keys, F.lit("exists").alias("reason")))
    return dup.unionByName(clash)


def not_indexed(queries: DataFrame, meta: DataFrame, libraries: DataFrame | None = None) -> DataFrame:
    """V9: queries against a library without an index (and, when
    ``libraries`` is given, against a library that does not exist)."""
    q = queries.join(meta.select("library_id"), "library_id", "left_anti")
    if libraries is None:
        return q.withColumn("reason", F.lit("not_indexed"))
    known = libraries.select("library_id", F.lit(True).alias("_known"))
    return (q.join(known, "library_id", "left")
            .withColumn("reason", F.when(F.col("_known").isNull(), F.lit("library_not_found"))
                        .otherwise(F.lit("not_indexed")))
            .drop("_known"))


def require_empty(report: DataFrame, message: str) -> DataFrame:
    """Strict mode: a one-row DataFrame whose evaluation fails the job when
    ``report`` has rows (``assert_true`` evaluated on the executors)."""
    n = report.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.assert_true(F.col("n") == 0, F.lit(message)).alias("ok"), "n")
