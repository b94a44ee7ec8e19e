"""Compressed vectors with an exact answer: one byte a component.

A code is the vector divided by its largest component over 127 and rounded; with it are kept the scale and the length of
what the rounding left (``err``).  For a unit query q, |q·v - scale q·code| is at most ``err``, so a code gives an upper and a
lower bound of the cosine.  A search

1. scans the codes only, a quarter of the bytes, and keeps in each task the rows whose upper bound reaches the
   k-th best lower bound there;
2. drops those below the k-th best lower bound of all tasks;
3. reads the float vectors of what is left, and ranks them exactly.

Rows that tie at the bound are kept, so the result is that of the exact join, row for row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import inv_norm as inv_norm_expr
from ..functions.vector import vec_dot
from ..schema import DEFAULT_K
from ..session import ensure_checkpoint_dir, fresh
from .knn import _MAX_SCORE_CELLS, QUERY_KEY, _salt_for, arrow_matrix, bounded_queries, inv_norms, knn_join, merge_topk

#: Candidate pairs up to this many are broadcast to the float vectors (some 80 bytes each).
BROADCAST_PAIRS = 200_000
#: Bounds are widened by this for the rounding of sums.
SLACK = 1e-7

CODES = T.StructType([T.StructField("library_id", T.StringType()), T.StructField("chunk_id", T.StringType()), T.StructField("code", T.BinaryType()),
                      T.StructField("scale", T.DoubleType()), T.StructField("err", T.DoubleType()), T.StructField("inv_norm", T.DoubleType())])
_PAIR = "query_id string, library_id string, chunk_id string, low double, high double, k int"


def compress(index: DataFrame) -> DataFrame:
    """``CODES`` of index rows (``library_id, chunk_id, vector, inv_norm``).  A zero vector has the code 0."""
    def run(batches):
        for b in batches:
            size = b.column("vector").value_lengths().to_numpy()
            code, scale, err = [b""] * len(b), np.zeros(len(b)), np.zeros(len(b))
            for dim in np.unique(size):
                mine = np.flatnonzero(size == dim)
                v = arrow_matrix(b.column("vector").take(pa.array(mine))) if dim else np.zeros((len(mine), 0))
                s = np.abs(v).max(axis=1, initial=0.0) / 127
                c = np.rint(np.divide(v, s[:, None], out=np.zeros_like(v), where=s[:, None] > 0)).astype(np.int8)
                left = v - c * s[:, None]
                scale[mine], err[mine] = s, np.sqrt((left * left).sum(axis=1))
                for i, x in zip(mine, c):
                    code[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("library_id"), b.column("chunk_id"), pa.array(code, pa.binary()), pa.array(scale), pa.array(err),
                                              b.column("inv_norm")], [f.name for f in CODES.fields])

    return index.select("library_id", "chunk_id", "vector", "inv_norm").mapInArrow(run, CODES)


def _scan(codes: DataFrame, packed: dict) -> DataFrame:
    shared = codes.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        floors: dict = {}
        for b in batches:
            lib = np.array(b.column("library_id").to_pylist(), object)
            length = np.array([len(c) for c in b.column("code").to_pylist()])
            for name in set(lib) & set(shared.value):
                ids, unit, ks = shared.value[name]
                mine = np.flatnonzero((lib == name) & (length == unit.shape[1]))
                if not len(mine):
                    continue
                some = b.take(pa.array(mine))
                c = np.frombuffer(b"".join(some.column("code").to_pylist()), np.int8).reshape(len(mine), -1).astype(np.float64)
                inv = some.column("inv_norm").to_numpy()
                mid, off = some.column("scale").to_numpy() * inv, some.column("err").to_numpy() * inv + SLACK
                floor = floors.setdefault(name, np.full(len(ids), -np.inf))
                names = some.column("chunk_id").to_numpy(zero_copy_only=False)
                step = max(1, _MAX_SCORE_CELLS // len(mine))
                for s in range(0, len(ids), step):
                    q = slice(s, min(s + step, len(ids)))
                    about = (unit[q] @ c.T) * mid
                    low, high = about - off, about + off
                    # of one k at a time: the k-th best lower bound here is one that the k-th best of all reaches
                    for k in np.unique(ks[q]):
                        of = np.flatnonzero(ks[q] == k)
                        if k <= len(mine):
                            kth = np.partition(low[of], len(mine) - k, axis=1)[:, len(mine) - k]
                            floor[s + of] = np.maximum(floor[s + of], kth)
                    i, j = np.nonzero(high >= floor[q][:, None])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[s + i], pa.string()), pa.array([name] * len(i), pa.string()), pa.array(names[j], pa.string()), pa.array(low[i, j]),
                         pa.array(high[i, j]), pa.array(ks[s + i].astype(np.int32))], ["query_id", "library_id", "chunk_id", "low", "high", "k"])

    return codes.mapInArrow(run, _PAIR)


def knn_codes(codes: DataFrame, index: DataFrame, queries: DataFrame, k: int | None = None, *, broadcast_rows: int = 20_000, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Exact top-k per query from the codes of ``index``; same output as :func:`vellum.operators.knn.knn_join`, which also
    answers batches of queries too large to broadcast."""
    if k is not None:
        queries = queries.withColumn("k", F.lit(int(k)).cast("int"))
    queries = queries.withColumn("k", F.coalesce(F.col("k"), F.lit(DEFAULT_K)).cast("int"))
    rows = bounded_queries(queries, broadcast_rows, broadcast_bytes)
    if rows is None:
        return knn_join(index, queries, kernel="grid")
    ensure_checkpoint_dir(index.sparkSession)
    packed, lib = {}, rows.column("library_id").to_pylist()
    for name in {x for x in lib if x is not None}:
        mine = rows.take(pa.array([i for i, x in enumerate(lib) if x == name]))
        raw = arrow_matrix(mine.column("embedding").combine_chunks())
        packed[name] = (mine.column("query_id").to_numpy(), raw * inv_norms(raw)[:, None], mine.column("k").to_numpy().astype(np.int64))
    kmax = max([1, *rows.column("k").to_pylist()])
    found = _scan(codes.filter(F.col("library_id").isin(sorted(packed))), packed).checkpoint()
    order = F.row_number().over(Window.partitionBy(*QUERY_KEY).orderBy(F.desc("low")))
    kth = found.withColumn("_r", order).filter(F.col("_r") <= kmax).filter(F.col("_r") == F.col("k")).select(*QUERY_KEY, F.col("low").alias("_floor"))
    pairs = found.join(fresh(kth), QUERY_KEY, "left").filter(F.col("_floor").isNull() | (F.col("high") >= F.col("_floor"))).select(*QUERY_KEY, "chunk_id", "k").checkpoint()
    asked = fresh(queries.select(*QUERY_KEY, "embedding")).withColumn("_q_inv", inv_norm_expr("embedding"))
    few = pairs.count() <= BROADCAST_PAIRS
    held = fresh(index.select("library_id", "chunk_id", "vector", "inv_norm"))
    met = held.join(F.broadcast(pairs) if few else pairs, ["library_id", "chunk_id"]).join(asked, QUERY_KEY)
    score = vec_dot("vector", "embedding") * F.col("inv_norm") * F.col("_q_inv")
    return merge_topk(met.select("query_id", "library_id", "chunk_id", score.alias("score"), "k"), kmax, _salt_for(index.sparkSession))
