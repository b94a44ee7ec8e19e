"""Approximate neighbours by random hyperplanes, with multi-probe search.

A table is ``bits`` random hyperplanes; a vector's code in it is the sides it lies on.  The codes of all ``tables`` are
stored with the index row (:func:`sign`).  A query looks into its own bucket of each table and into those that differ in
the sides it is nearest to, in order of the squared distances to the planes crossed (multi-probe): ``probes``
buckets a table.  Rows that share a looked-at bucket with it are scored exactly, once, in the task that reads them;
nothing is shuffled but each task's k best.  Buckets have no cap: one that holds many rows is scored in slices.

What is missed is what no looked-at bucket holds; more tables or probes miss less, and with ``probes = 2 ** bits``
nothing is missed.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import DEFAULT_K
from .knn import CAND_SCHEMA, _MAX_SCORE_CELLS, _emit, _reduce_candidates, _salt_for, arrow_matrix, bounded_queries, inv_norms, knn_join, merge_topk


def planes(dim: int, tables: int, bits: int, seed: int = 5) -> np.ndarray:
    """(tables * bits) x dim normals, the same for every task and run."""
    return np.random.default_rng([seed, dim]).standard_normal((tables * bits, dim))


def _codes(v: np.ndarray, tables: int, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x tables) and signed distances (rows x tables x bits)."""
    side = (v @ planes(v.shape[1], tables, bits, seed).T).reshape(len(v), tables, bits)
    return ((side > 0) @ (1 << np.arange(bits))).astype(np.int64), side


def sign(index: DataFrame, tables: int = 12, bits: int = 10, seed: int = 5) -> DataFrame:
    """Index rows with ``codes``: their bucket in every table."""
    cols = ["library_id", "chunk_id", "vector", "inv_norm"]

    def run(batches):
        for b in batches:
            size = b.column("vector").value_lengths().to_numpy()
            out = np.zeros((len(b), tables), np.int64)
            for dim in np.unique(size[size > 0]):
                mine = np.flatnonzero(size == dim)
                out[mine] = _codes(arrow_matrix(b.column("vector").take(pa.array(mine))), tables, bits, seed)[0]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], pa.array(out.astype(np.int32).tolist(), pa.list_(pa.int32()))], [*cols, "codes"])

    return index.select(*cols).mapInArrow(run, "library_id string, chunk_id string, vector array<float>, inv_norm double, codes array<int>")


def probe_order(distance: np.ndarray, probes: int) -> list[int]:
    """The ``probes`` bit patterns to flip, least sum of squared distances first (the empty one is first)."""
    cost = distance * distance
    by = np.argsort(cost, kind="stable")
    out, heap = [0], [(float(cost[by[0]]), (0,))] if len(by) else []
    while heap and len(out) < probes:
        total, at = heapq.heappop(heap)
        out.append(int(sum(1 << int(by[i]) for i in at)))
        last = at[-1]
        if last + 1 < len(by):
            heapq.heappush(heap, (total - float(cost[by[last]]) + float(cost[by[last + 1]]), (*at[:-1], last + 1)))
            heapq.heappush(heap, (total + float(cost[by[last + 1]]), (*at, last + 1)))
    return out


def knn_lsh(signed: DataFrame, queries: DataFrame, k: int | None = None, *, tables: int = 12, bits: int = 10, seed: int = 5, probes: int = 12,
            broadcast_rows: int = 20_000, broadcast_bytes: int = 32 << 20, scored=None) -> DataFrame:
    """The k best of the rows that share a looked-at bucket with each query: approximate, with exact scores.  ``signed``
    as :func:`sign` gives it with the same ``tables``, ``bits`` and ``seed``.  Same output as
    :func:`vellum.operators.knn.knn_join`, which answers batches too large to broadcast.  ``scored``, an
    accumulator of a pair of numbers, receives the scored and all (query, vector) pairs."""
    if k is not None:
        queries = queries.withColumn("k", F.lit(int(k)).cast("int"))
    queries = queries.withColumn("k", F.coalesce(F.col("k"), F.lit(DEFAULT_K)).cast("int"))
    rows = bounded_queries(queries, broadcast_rows, broadcast_bytes)
    if rows is None:
        return knn_join(signed, queries, kernel="grid")
    packed, lib = {}, rows.column("library_id").to_pylist()
    for name in {x for x in lib if x is not None}:
        mine = rows.take(pa.array([i for i, x in enumerate(lib) if x == name]))
        raw = arrow_matrix(mine.column("embedding").combine_chunks())
        code, side = _codes(raw, tables, bits, seed)
        asked = []                                       # per table: bucket codes in order, and the query of each
        for t in range(tables):
            looked = np.array([[int(code[i, t]) ^ f for f in probe_order(side[i, t], probes)] for i in range(len(raw))])
            flat, who = looked.ravel(), np.repeat(np.arange(len(raw)), looked.shape[1])
            order = np.argsort(flat, kind="stable")
            asked.append((flat[order], who[order]))
        packed[name] = (mine.column("query_id").to_numpy(), raw, mine.column("k").to_numpy().astype(np.int64), asked)
    kmax = max([1, *rows.column("k").to_pylist()])
    shared = signed.sparkSession.sparkContext.broadcast(packed)
    arrow = to_arrow_schema(CAND_SCHEMA)

    def run(batches):
        pending, done, every = [], 0, 0
        for b in batches:
            libs, size = np.array(b.column("library_id").to_pylist(), object), b.column("vector").value_lengths().to_numpy()
            for name in set(libs) & set(shared.value):
                q_ids, raw, ks, asked = shared.value[name]
                mine = np.flatnonzero((libs == name) & (size == raw.shape[1]))
                if not len(mine):
                    continue
                some = b.take(pa.array(mine))
                v, inv, ids = arrow_matrix(some.column("vector")), some.column("inv_norm").to_numpy(), some.column("chunk_id").to_numpy(zero_copy_only=False)
                codes = some.column("codes").flatten().to_numpy().reshape(len(mine), -1)
                every += len(mine) * len(q_ids)
                q_inv = inv_norms(raw)
                # (query, row) pairs as a bitmap of a slice of rows: bounded, whatever the buckets hold
                step = max(1, _MAX_SCORE_CELLS // len(q_ids))
                for s in range(0, len(mine), step):
                    met = np.zeros((len(q_ids), len(mine[s:s + step])), bool)
                    for t, (bucket, who) in enumerate(asked):
                        at, end = np.searchsorted(bucket, codes[s:s + step, t]), np.searchsorted(bucket, codes[s:s + step, t], side="right")
                        n = end - at
                        first = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                        met[who[first + np.arange(n.sum())], np.repeat(np.arange(len(n)), n)] = True
                    qi, ri = np.nonzero(met)
                    done += len(qi)
                    score = np.empty(len(qi))
                    for x in range(0, len(qi), _MAX_SCORE_CELLS // max(1, raw.shape[1])):
                        part = slice(x, x + _MAX_SCORE_CELLS // max(1, raw.shape[1]))
                        score[part] = np.einsum("ij,ij->i", raw[qi[part]], v[s + ri[part]]) * inv[s + ri[part]] * q_inv[qi[part]]
                    out = _emit(q_ids, np.full(len(q_ids), name, object), ks, ids, pd.DataFrame({"qi": qi, "ci": s + ri, "score": score}))
                    pending = [_reduce_candidates(pd.concat([*pending, out], ignore_index=True))]
        if scored is not None:
            scored.add(np.array([done, every]))
        if pending:
            yield pa.RecordBatch.from_pandas(pending[0], schema=arrow, preserve_index=False)

    found = signed.filter(F.col("library_id").isin(sorted(packed))).mapInArrow(run, CAND_SCHEMA)
    return merge_topk(found, kmax, _salt_for(signed.sparkSession))
