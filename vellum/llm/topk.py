"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are quantised to integers (``floor(SCALE * x)``); a dimension is a term.
Rows are range-partitioned by id (rows of one id by a hash) and cut into blocks, each with the largest
and smallest value of every dimension.  For a query the greatest sum a block can
reach is, dimension by dimension, the query's component times the maximum (or
the minimum, for a negative component).  Blocks are scored in the order of that
bound, through their forward index (a rows x dimensions matrix), until the next
bound is below the query's k-th score so far.

The work is split both ways, as in a blocked matrix product: a cell is a group of
``GROUP_BLOCKS`` neighbouring blocks against a slice of ``SLICE`` queries, so no task holds
more than one group and one slice, however large either table is.  Every query starts from
a floor, its k-th score among a bounded random sample of rows.  Groups have bounds like blocks: a query meets its group of
highest bound first, which raises the floor, and then only groups whose bound reaches it; vectors are
copied to the slices that have such a query, and to no others.
Cells return their k best rows per query; a window ranks them.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh
from .common import bounded_sample, cut

SCALE = 64
BLOCK = 512
GROUP_BLOCKS = 32
SLICE = 1024
#: Rows of the sample that floors come from (at most twice as many reach the driver and are broadcast).
FLOOR_ROWS = 2048
#: Bytes of the bounds of groups that queries are held against in a task, and pairs of a group and a slice that are broadcast.
BOUND_BYTES = 64 << 20
BROADCAST_CELLS = 500_000


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, dim, v array<bigint>), one row per id and vector: of rows that repeat
    both, one counts.  Rows with a null id, a null vector or a null or non-finite
    component are left out."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    q = x.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad).dropDuplicates(["id", "x"])
    return q.select("id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(scale * c)).alias("v"))


def _matrix(column) -> np.ndarray:
    """Rows of equal length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), len(values) // max(1, len(flat)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of a with rows of b, in floats where they are exact."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2 ** 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2 ** 53 else a @ b.T


def search_cell(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, v: np.ndarray,
                k: int, block: int = BLOCK, stats: dict | None = None):
    """The k best rows for each query among ``ids`` (ascending): arrays query
    position, row position, score; none below the query's floor."""
    low = np.iinfo(np.int64).min
    starts = np.arange(0, len(ids), block)
    top = np.stack([v[s:s + block].max(0) for s in starts]).astype(float)
    bottom = np.stack([v[s:s + block].min(0) for s in starts]).astype(float)
    bound = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ bottom.T
    bound += 1e-9 * np.abs(bound) + 1e-6                      # rounding beyond 2^53
    order = np.argsort(-bound, axis=1, kind="stable")
    best = np.full((len(q), k), low)
    row = np.full((len(q), k), -1)
    kth = floor.copy()
    for step in range(len(starts)):
        now = order[:, step]
        active = np.flatnonzero(bound[np.arange(len(q)), now] >= kth)
        if not len(active):
            break
        for b in np.unique(now[active]):
            who = active[now[active] == b]
            part = slice(starts[b], starts[b] + block)
            s = _product(q[who], v[part])
            if stats is not None:
                stats["scored"] = stats.get("scored", 0) + s.size
            s[ids[None, part] == qid[who, None]] = low
            s[s < kth[who, None]] = low
            who_hit = np.flatnonzero((s > low).any(1))
            if not len(who_hit):
                continue
            w = who[who_hit]
            cand = np.concatenate([best[w], s[who_hit]], 1)
            at = np.concatenate([row[w], np.broadcast_to(np.arange(part.start, min(part.stop, len(ids))), s[who_hit].shape)], 1)
            at = np.where(cand == low, len(ids), at)
            pick = np.lexsort((at, ~cand), axis=1)[:, :k]
            best[w] = np.take_along_axis(cand, pick, 1)
            row[w] = np.take_along_axis(at, pick, 1)
            kth[w] = np.maximum(kth[w], best[w, -1])
    i, j = np.nonzero(best > low)
    return i, row[i, j], best[i, j]


def _group_bounds(batches):
    """(g, dim, top, bottom): the largest and smallest value of every dimension among a group's rows."""
    held: dict = {}
    for b in batches:
        g, dim = b.column("g").to_numpy(), b.column("dim").to_numpy()
        for key in set(zip(g.tolist(), dim.tolist())):
            v = _matrix(b.column("v").filter(pa.array((g == key[0]) & (dim == key[1])))).astype(np.int64)
            top, bottom = held.get(key, (v[0], v[0]))
            held[key] = (np.maximum(top, v.max(0)), np.minimum(bottom, v.min(0)))
    keys = list(held)
    kind = pa.list_(pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                      pa.array([held[k][0] for k in keys], kind), pa.array([held[k][1] for k in keys], kind)], ["g", "dim", "top", "bottom"])


def _merged_bounds(bounds: DataFrame, groups: int) -> tuple[int, dict]:
    """By dimension: numbers and bounds of groups, ``merge`` neighbours as one where all would not fit ``BOUND_BYTES``."""
    size = bounds.agg(F.coalesce(F.sum(16 * F.col("dim")), F.lit(0))).first()[0]
    merge = max(1, math.ceil(size / BOUND_BYTES))
    rows = bounds.withColumn("g", F.floor(F.col("g") / merge).cast("int")) if merge > 1 else bounds
    out: dict = {}
    for batch in rows.orderBy("dim", "g").toArrow().to_batches():
        for g, dim, top, bottom in zip(*(batch.column(c).to_pylist() for c in ("g", "dim", "top", "bottom"))):
            known = out.setdefault(dim, {})
            known[g] = (np.maximum(known[g][0], top), np.minimum(known[g][1], bottom)) if g in known else (np.array(top), np.array(bottom))
    return merge, {dim: (np.array(sorted(x)), np.stack([x[g][0] for g in sorted(x)]).astype(float), np.stack([x[g][1] for g in sorted(x)]).astype(float))
                   for dim, x in out.items()}


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, stats: dict | None = None) -> DataFrame:
    """``vectors`` and ``queries`` as :func:`quantise` gives them.  Returns query_id,
    rank (from 1), vec_id, score: for every query the k greatest scores (all,
    if fewer) among the rows of its dimension other than its own id,
    ties to the smaller id.  Rows of one id are candidates each, and as queries share
    the id's k ranks.  A query without such rows gives none, as do empty tables."""
    spark = vectors.sparkSession
    v, q = cut(vectors), cut(queries)
    n, nq = v.count(), q.count()
    groups = max(1, math.ceil(n / (BLOCK * GROUP_BLOCKS)))
    slices = max(1, math.ceil(nq / SLICE))
    sample = bounded_sample(v, FLOOR_ROWS, n).toArrow()
    floors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in set(sample.column("dim").to_pylist()):
        part = sample.filter(pa.compute.equal(sample.column("dim"), dim))
        floors[dim] = (part.column("id").to_numpy(), _matrix(part.column("v")))
    shared = spark.sparkContext.broadcast(floors)

    def with_floor(batches):
        """Adds each query's k-th score in the sample: no row below it can be a result."""
        for batch in batches:
            t = pa.Table.from_batches([batch])
            none = np.iinfo(np.int64).min + 1
            out = np.full(len(t), none)
            dims = t.column("dim").to_numpy()
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                if dim not in shared.value or len(shared.value[dim][0]) <= k:
                    continue
                ids, m = shared.value[dim]
                some = t.take(pa.array(mine))
                s = _product(_matrix(some.column("v")), m)
                s[ids[None, :] == some.column("id").to_numpy()[:, None]] = none
                out[mine] = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
            yield from t.append_column("floor", pa.array(out)).to_batches()

    # neighbours in id order form a group; the group number is the range partition.  Values travel as 16 bits where they fit
    widest = v.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 0
    kind = "array<smallint>" if widest < 1 << 15 else "array<bigint>"
    placed = cut(v.repartitionByRange(groups, F.col("id"), F.xxhash64("v")).sortWithinPartitions("id")
                 .select(F.spark_partition_id().alias("g"), "id", "dim", F.col("v").cast(kind).alias("v")))
    merge, bounds = _merged_bounds(placed.mapInArrow(_group_bounds, "g int, dim int, top array<bigint>, bottom array<bigint>"), groups)
    reach = spark.sparkContext.broadcast(bounds)
    asked = cut(q.mapInArrow(with_floor, "id bigint, dim int, v array<bigint>, floor bigint")
                .withColumn("s", F.pmod(F.xxhash64("id", "v"), F.lit(slices)).cast("int")))

    def reached(first: bool):
        """Adds ``gs``: the groups of each query, by bound, of which the best (``first``) or the others reach its floor."""
        def run(batches):
            for b in batches:
                dims, floor = b.column("dim").to_numpy(), b.column("floor").to_numpy()
                out = [[] for _ in range(len(b))]
                for dim in np.unique(dims):
                    if dim not in reach.value:
                        continue
                    g, top, bottom = reach.value[dim]
                    mine = np.flatnonzero(dims == dim)
                    x = _matrix(b.column("v").take(pa.array(mine))).astype(float)
                    bound = np.maximum(x, 0) @ top.T + np.minimum(x, 0) @ bottom.T
                    bound += 1e-9 * np.abs(bound) + 1e-6
                    best = bound.argmax(1)
                    for i, row in enumerate(mine):
                        hit = bound[i] >= floor[row]
                        if first:
                            out[row] = [int(g[best[i]])] if hit[best[i]] else []
                        else:
                            hit[best[i]] = False
                            out[row] = g[hit].tolist()
                yield b.append_column("gs", pa.array(out, pa.list_(pa.int32())))
        return run

    def cell(rows: pa.Table, some: pa.Table) -> pa.Table:
        if not len(rows) or not len(some):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.int64())})
        rows = rows.sort_by("id")
        ids, qid = rows.column("id").to_numpy(), some.column("id").to_numpy()
        i, j, s = search_cell(qid, _matrix(some.column("v")).astype(np.int64), some.column("floor").to_numpy(), ids,
                              _matrix(rows.column("v")).astype(np.int64), k)
        return pa.table({"query_id": qid[i], "vec_id": ids[j], "score": s})

    def wave(some: DataFrame, first: bool) -> DataFrame:
        """The hits of the groups that queries reach; a vector meets only slices with such a query, and a query only such groups."""
        right = some.mapInArrow(reached(first), "id bigint, dim int, v array<bigint>, floor bigint, s int, gs array<int>")
        right = right.withColumn("m", F.explode("gs")).drop("gs")
        right = right.withColumn("g", F.explode(F.sequence(F.col("m") * merge, F.col("m") * merge + merge - 1))) if merge > 1 else right.withColumnRenamed("m", "g")
        right = cut(right.select("id", "dim", F.col("v").cast(kind).alias("v"), "floor", "s", "g"))
        met = fresh(cut(right.select("dim", "g", "s").distinct()))
        if stats is not None:
            stats.setdefault("met", []).append((met.count(), groups * slices))
        few = met.count() <= BROADCAST_CELLS
        left = placed.join(F.broadcast(met) if few else met, ["dim", "g"])
        return left.groupBy("dim", "g", "s").cogroup(right.groupBy("dim", "g", "s")).applyInArrow(cell, "query_id bigint, vec_id bigint, score bigint")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    # first each query's group of highest bound: its k-th score there is the floor for the others
    found = cut(wave(asked, True).withColumn("rank", rank).filter(F.col("rank") <= k))
    kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    again = asked.join(kth, "id", "left").select("id", "dim", "v", F.greatest("floor", F.coalesce("kth", "floor")).alias("floor"), "s")
    hits = found.drop("rank").unionByName(wave(again, False))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
