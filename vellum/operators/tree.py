"""Cell tree (X3), and exact top-k search down the tree.

Build.  A cell is a heap number: root 1, children 2c and 2c+1; a node is split at the median
of its axis of largest variance, equal values by chunk_id.

1. Top.  Cells of more than ``GROUP_VALUES`` vector components are halved level by level, all cells of a level at once:
   the axis by the moments of all rows of a cell (one partial a task and cell), the median row by a
   selection over all of them.  A row is compared with its cell's median and no cell is sorted or shuffled whole; identical
   vectors are told apart by their ids, so no cell stays hot.  Levels: log2 of the components of a library by
   ``GROUP_VALUES``.
2. Rest.  A cell's rows meet in one task and are split down to the leaves exactly.  The task also measures centroid,
   radius and angle of every node over all its rows, and packs nodes, ids and vectors of a subtree of
   at most ``BLOCK_VALUES`` components into one row, a *block*.

So every library, of whatever size, is split by the exact rule throughout.

Search.  A batch of queries of a checked size is broadcast and blocks are read in place.  In a
block the queries go down level by level: only children of a node that can still hold a hit are
looked at (``cos(angle to centroid - angle of the node)`` against the query's k-th best so far).  The leaves that are
left are scored; a query that needs most of the block gets the whole block in one product, as in the exact
scan, so a tree that prunes nothing costs its bounds and no more.  Where there are many blocks, each query's most promising
blocks are searched first, and only blocks whose own bound reaches the floor so found are read.
Larger batches stay where they are, and the blocks go round part by part (:mod:`vellum.operators.rounds`); where the blocks
are the larger side, the queries do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_K, DEFAULT_LEAF_SIZE
from ..session import ensure_checkpoint_dir, fresh, stored
from .knn import CAND_SCHEMA, _salt_for, arrow_matrix, bounded_queries, inv_norms, merge_topk
from .rank import at_rank
from .rounds import Asked, id_ranks, parts_of, search_rounds, unit_floats

ANGLE_SLACK = 1e-6
#: Components (rows x dimension) that one task splits by itself: 32 MB as doubles.
GROUP_VALUES = 1 << 22
#: Components of a block: 1 MB as floats.
BLOCK_VALUES = 1 << 18
#: Rows around the median of a large cell that are ranked; while there are more, a histogram narrows them.
FIT_ROWS = 16_384
#: Blocks above which the most promising ones are searched first.
PROBE_BLOCKS = 64
#: Block names up to this many are broadcast (40 bytes each).
BROADCAST_NAMES = 200_000
#: Share of a block from which it is scored whole.
WHOLE = 0.5

_ROW = "library_id string, chunk_id string, vector array<float>, inv_norm double, cell bigint"
BLOCK = ("library_id string, block bigint, dim int, n int, center array<double>, angle double, chunk_ids array<string>, vectors array<float>, "
         "inv_norms array<double>, node_ids array<bigint>, node_start array<int>, node_end array<int>, node_centers array<double>, "
         "node_angles array<double>, node_radii array<double>")


# ---------------------------------------------------------------------------
# build
# ---------------------------------------------------------------------------

def _units(t: pa.Table) -> np.ndarray:
    return arrow_matrix(t.column("vector").combine_chunks()) * t.column("inv_norm").to_numpy()[:, None]


def _halves(unit: np.ndarray, rank: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray]:
    """The split axis of ``rows``, and them in order of (component, id)."""
    axis = int(np.argmax(unit[rows].var(axis=0)))
    return axis, rows[np.lexsort((rank[rows], unit[rows, axis]))]


def _split_large(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``rows`` with the cells of ``large`` (``library_id, cell``, and their rows ``n``) halved: axis by the moments of
    all rows of a cell, the row at floor(n/2) by (value, id) by selection over all of them."""
    from .cells import component_stats, split_axis, unit_expr      # which builds on this module

    g = ["library_id", "cell"]
    mine = rows.join(fresh(large), g, "left_semi")
    # small tables, written: their size is known, so they are broadcast and no hot cell is shuffled
    axes = fresh(stored(split_axis(component_stats(mine.withColumn("unit", unit_expr()), g), g).select(*g, "axis")))
    value = F.element_at("vector", F.col("axis") + 1).cast("double") * F.col("inv_norm")
    targets = large.select(*g, F.floor(F.col("n") / 2).alias("target"))
    first = stored(at_rank(rows.join(axes, g).withColumn("_v", value), g, "_v", "chunk_id", targets, small=FIT_ROWS))
    cuts = fresh(axes.join(fresh(first), g))
    right = (value > F.col("_t")) | ((value == F.col("_t")) & (F.col("chunk_id") >= F.col("_id")))
    cell = F.when(F.col("_t").isNull(), F.col("cell")).otherwise(F.col("cell") * 2 + right.cast("long"))
    return stored(rows.join(cuts, g, "left").select("library_id", "chunk_id", "vector", "inv_norm", cell.alias("cell")))


def split_tree(unit: np.ndarray, rank: np.ndarray, leaf_size: int, root: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Node numbers (ascending), where each starts and ends, and the rows in
    the order that makes every node one run."""
    order, nodes, todo = np.arange(len(unit)), [], [(root, 0, len(unit))]
    while todo:
        node, s, e = todo.pop()
        nodes.append((node, s, e))
        if e - s > leaf_size:
            order[s:e] = _halves(unit, rank, order[s:e])[1]
            half = s + (e - s) // 2
            todo += [(2 * node, s, half), (2 * node + 1, half, e)]
    nodes = np.array(sorted(nodes), np.int64)
    return nodes[:, 0], nodes[:, 1], nodes[:, 2], order


def node_bounds(unit: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroid, largest angle and largest cosine distance from it, of every run of rows."""
    center, angle, radius = np.zeros((len(start), unit.shape[1])), np.zeros(len(start)), np.zeros(len(start))
    for i, (s, e) in enumerate(zip(start, end)):
        c = unit[s:e].mean(axis=0)
        norm = math.sqrt(c @ c)
        center[i] = c / norm if norm > 0 else c
        least = float(np.clip((unit[s:e] @ center[i]).min(), -1.0, 1.0))
        angle[i], radius[i] = math.acos(least), 1.0 - least
    return center, angle, radius


def _lists(values, sizes, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind) if not isinstance(values, pa.Array) else values)


def _local(leaf_size: int):
    """One cell's rows, split to the leaves and packed as blocks."""
    def run(t: pa.Table) -> pa.Table:
        unit, dim = _units(t), len(t.column("vector")[0])
        ids = t.column("chunk_id").to_numpy()
        node, start, end, order = split_tree(unit, id_ranks(ids), leaf_size, t.column("cell")[0].as_py())
        unit = unit[order]
        center, angle, radius = node_bounds(unit, start, end)
        t = t.take(pa.array(order))
        at = {int(x): i for i, x in enumerate(node)}
        limit = max(leaf_size, BLOCK_VALUES // max(1, dim))
        roots = [i for i, x in enumerate(node) if end[i] - start[i] <= limit and (i == 0 or end[at[int(x) >> 1]] - start[at[int(x) >> 1]] > limit)]
        roots.sort(key=lambda i: start[i])
        below = [np.flatnonzero((start >= start[r]) & (end <= end[r]) & (node >= node[r])) for r in roots]
        sizes, many = [end[r] - start[r] for r in roots], [len(b) for b in below]
        every = np.concatenate(below)
        offset = np.repeat([start[r] for r in roots], many)
        return pa.table({
            "library_id": pa.array([t.column("library_id")[0].as_py()] * len(roots), pa.string()), "block": pa.array([int(node[r]) for r in roots], pa.int64()),
            "dim": pa.array([dim] * len(roots), pa.int32()), "n": pa.array(sizes, pa.int32()), "center": pa.array([center[r] for r in roots], pa.list_(pa.float64())),
            "angle": pa.array([angle[r] for r in roots], pa.float64()),
            "chunk_ids": _lists(t.column("chunk_id").combine_chunks().cast(pa.string()), sizes, None),
            "vectors": _lists(t.column("vector").combine_chunks().flatten(), np.array(sizes) * dim, None),
            "inv_norms": _lists(t.column("inv_norm").combine_chunks(), sizes, None),
            "node_ids": _lists(node[every], many, pa.int64()), "node_start": _lists((start[every] - offset).astype(np.int32), many, pa.int32()),
            "node_end": _lists((end[every] - offset).astype(np.int32), many, pa.int32()), "node_centers": _lists(center[every].ravel(), np.array(many) * dim, pa.float64()),
            "node_angles": _lists(angle[every], many, pa.float64()), "node_radii": _lists(radius[every], many, pa.float64())})

    return run


def build_blocks(index: DataFrame, leaf_size: int = DEFAULT_LEAF_SIZE) -> DataFrame:
    """The cell tree of every library of ``index`` (``library_id, chunk_id, vector, inv_norm``; one
    dimension a library), one row per block (schema ``BLOCK``), written once to the checkpoint folder."""
    ensure_checkpoint_dir(index.sparkSession)
    g = ["library_id", "cell"]
    rows = index.select("library_id", "chunk_id", "vector", "inv_norm").withColumn("cell", F.lit(1).cast("long"))

    def large(cells: DataFrame) -> DataFrame:
        return stored(cells.filter((F.col("n") * F.col("dim") > GROUP_VALUES) & (F.col("n") > leaf_size)))

    cells = large(rows.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")))
    if not cells.isEmpty():
        rows = stored(rows)
    while not cells.isEmpty():
        rows = _split_large(rows, cells)
        left = F.floor(F.col("n") / 2)
        halves = F.array(F.struct((F.col("cell") * 2).alias("cell"), left.alias("n")), F.struct((F.col("cell") * 2 + 1).alias("cell"), (F.col("n") - left).alias("n")))
        cells = large(cells.select("library_id", "dim", F.explode(halves).alias("h")).select("library_id", "h.cell", "h.n", "dim"))
    return rows.groupBy(*g).applyInArrow(_local(leaf_size), BLOCK).checkpoint()


def block_rows(blocks: DataFrame) -> DataFrame:
    """The index rows of blocks with their leaf ``cell``."""
    def run(batches):
        for b in batches:
            for x in range(len(b)):
                one = _Block(b, x)
                leaf = np.flatnonzero(one.leaf)
                leaf = leaf[np.argsort(one.start[leaf])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one.library] * one.n, pa.string()), one.ids, pa.ListArray.from_arrays(pa.array(np.arange(one.n + 1) * one.dim, pa.int32()), one.flat),
                     pa.array(one.inv), pa.array(np.repeat(one.nodes[leaf], one.end[leaf] - one.start[leaf]))], [c.split()[0] for c in _ROW.split(", ")])

    return blocks.mapInArrow(run, _ROW)


_CELL = "library_id string, cell bigint, centroid array<double>, radius double, angle double, n bigint"


def block_cells(blocks: DataFrame) -> DataFrame:
    """The leaves of blocks: library_id, cell, centroid, radius, angle, n."""
    def run(batches):
        for b in batches:
            for x in range(len(b)):
                one = _Block(b, x)
                leaf = np.flatnonzero(one.leaf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one.library] * len(leaf), pa.string()), pa.array(one.nodes[leaf]), pa.array(list(one.centers[leaf]), pa.list_(pa.float64())),
                     pa.array(one.radii[leaf]), pa.array(one.angles[leaf]), pa.array((one.end - one.start)[leaf].astype(np.int64))],
                    [c.split()[0] for c in _CELL.split(", ")])

    return blocks.mapInArrow(run, _CELL)


# ---------------------------------------------------------------------------
# search
# ---------------------------------------------------------------------------

class _Block:
    """Arrays of one block row of a record batch."""

    def search(self, q: Asked, stats: dict) -> None:
        search_block(q, self, stats)

    def __init__(self, batch: pa.RecordBatch, at: int):
        get = lambda c: batch.column(c)[at].values
        self.library, self.dim, self.n = batch.column("library_id")[at].as_py(), batch.column("dim")[at].as_py(), batch.column("n")[at].as_py()
        self.block = batch.column("block")[at].as_py()
        self.ids, self.flat = get("chunk_ids"), get("vectors")
        self.inv = get("inv_norms").to_numpy()
        self.nodes, self.start, self.end = (get(c).to_numpy() for c in ("node_ids", "node_start", "node_end"))
        self.centers = get("node_centers").to_numpy().reshape(len(self.nodes), -1)
        self.angles, self.radii = get("node_angles").to_numpy(), get("node_radii").to_numpy()
        self.parent = np.searchsorted(self.nodes, self.nodes >> 1)
        self.leaf = ~np.isin(2 * self.nodes, self.nodes)
        self.raw = None

    def vectors(self) -> np.ndarray:
        if self.raw is None:
            self.raw = self.flat.to_numpy().reshape(self.n, -1)
        return self.raw


def upper(cos: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """The greatest similarity to members within ``angle`` of a centre at ``cos``."""
    a = np.minimum(np.pi, angle + ANGLE_SLACK)
    return np.where(cos >= np.cos(a), 1.0, cos * np.cos(a) + np.sqrt(np.maximum(0.0, 1.0 - cos * cos)) * np.sin(a))


def _kept(q: Asked, b: _Block) -> np.ndarray:
    """(nodes x queries) whether a node can hold a hit, and all above it: the angle to its centre is at most the node's and the
    floor's together, cos(centre) >= cos(node) floor - sin(node) sin(floor).  Nodes or floors wider than a right angle are kept."""
    angle = b.angles + ANGLE_SLACK
    wide = angle >= np.pi / 2
    node = np.column_stack([b.centers, np.cos(angle), np.sin(angle)]).astype(np.float32)
    node[wide, :-1], node[wide, -1] = 0, 1
    floor = np.clip(q.floor, 0.0, 1.0)
    asked = np.column_stack([q.floats, -floor, np.sqrt(1.0 - floor * floor)]).astype(np.float32)
    asked[floor == 0, :-1] = 0
    kept = node @ asked.T >= np.float32(-4 * q.slack)
    level = np.frexp(b.nodes.astype(np.float64))[1]
    for x in np.unique(level)[1:]:
        cols = np.flatnonzero(level == x)
        kept[cols] &= kept[b.parent[cols]]
    return kept


def search_block(q: Asked, b: _Block, stats: dict | None = None) -> None:
    """The hits of one block, merged into ``q``."""
    if not b.n or b.dim != q.raw.shape[1]:
        return
    floats = unit_floats(b.vectors(), b.inv)

    def take(who, s, e, without=None):
        qi, ci, score = q.hits(who, floats[s:e], b.vectors()[s:e], b.inv[s:e])
        ci = ci + s
        if without is not None:
            # what the dive found is found again
            new = (without[qi] < 0) | (ci < b.start[without[qi]]) | (ci >= b.end[without[qi]])
            qi, ci, score = qi[new], ci[new], score[new]
        if stats is not None:
            stats["scored"] = stats.get("scored", 0) + len(who) * int(e - s)
        q.keep(qi, b.ids.take(pa.array(ci)).to_numpy(zero_copy_only=False), score)

    if stats is not None:
        stats["all"] = stats.get("all", 0) + len(q.ids) * b.n
    q.merge()
    dived = np.full(len(q.ids), -1)
    fresh_ones = np.flatnonzero(np.isneginf(q.floor))
    if len(fresh_ones) and len(b.nodes) > 1:
        # a query without a floor goes straight down to its most promising leaf first
        node = np.zeros(len(fresh_ones), np.int64)
        while (open_ := np.flatnonzero(~b.leaf[node])).size:
            left = np.searchsorted(b.nodes, 2 * b.nodes[node[open_]])
            right = np.searchsorted(b.nodes, 2 * b.nodes[node[open_]] + 1)
            u = q.unit[fresh_ones[open_]]
            better = upper(np.einsum("ij,ij->i", u, b.centers[right]), b.angles[right]) > upper(np.einsum("ij,ij->i", u, b.centers[left]), b.angles[left])
            node[open_] = np.where(better, right, left)
        dived[fresh_ones] = node
        for x in np.unique(node):
            take(fresh_ones[node == x], b.start[x], b.end[x])
        q.merge()
    leaves = np.flatnonzero(b.leaf)
    kept = _kept(q, b)[leaves]
    kept[np.searchsorted(leaves, dived[fresh_ones]), fresh_ones] &= dived[fresh_ones] < 0
    share = ((b.end - b.start)[leaves].astype(np.float32) / b.n) @ kept.astype(np.float32)
    # a query that needs most of the block takes it whole
    whole = share > WHOLE
    if whole.any():
        take(np.flatnonzero(whole), 0, b.n, dived)
    kept &= ~whole
    for i in np.flatnonzero(kept.any(axis=1)):
        take(np.flatnonzero(kept[i]), b.start[leaves[i]], b.end[leaves[i]])


def _by_library(rows: pa.Table, floors: dict) -> dict:
    out = {}
    lib = rows.column("library_id").to_pylist()
    for name in set(lib):
        mine = rows.take(pa.array([i for i, x in enumerate(lib) if x == name]))
        ids = mine.column("query_id").to_numpy()
        out[name] = (ids, arrow_matrix(mine.column("embedding").combine_chunks()), mine.column("k").to_numpy().astype(np.int64),
                     [floors.get((name, i), -np.inf) for i in ids])
    return out


def _candidates(blocks: DataFrame, packed: dict, scored) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        asked, stats = {}, {}
        for batch in batches:
            for x in range(len(batch)):
                lib = batch.column("library_id")[x].as_py()
                if lib not in shared.value:
                    continue
                if lib not in asked:
                    asked[lib] = Asked(*shared.value[lib])
                search_block(asked[lib], _Block(batch, x), stats)
        for lib, q in asked.items():
            q.merge()
            qi, ids, score = q.best
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[qi], pa.string()), pa.array([lib] * len(qi), pa.string()), pa.array(ids, pa.string()),
                                              pa.array(score), pa.array(q.k[qi].astype(np.int32))], [f.name for f in CAND_SCHEMA.fields])
        if scored is not None:
            scored.add(np.array([stats.get("scored", 0), stats.get("all", 0)]))

    return blocks.mapInArrow(run, CAND_SCHEMA)


def _roots(blocks: DataFrame, packed: dict, most: int) -> DataFrame:
    """Per task and query, the ``most`` blocks of highest bound: (library_id, query_id, block, ub, n)."""
    shared = blocks.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        for b in batches:
            lib, dims = np.array(b.column("library_id").to_pylist(), object), b.column("dim").to_numpy()
            for name in set(lib) & set(shared.value):
                ids, raw, _, _ = shared.value[name]
                mine = np.flatnonzero((lib == name) & (dims == raw.shape[1]))
                if not len(mine):
                    continue
                some = b.take(pa.array(mine))
                ub = upper((raw * inv_norms(raw)[:, None]) @ arrow_matrix(some.column("center")).T, some.column("angle").to_numpy()[None, :])
                best = np.argsort(-ub, axis=1, kind="stable")[:, :most]
                qi = np.repeat(np.arange(len(ids)), best.shape[1])
                bi = best.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(qi), pa.string()), pa.array(ids[qi], pa.string()), some.column("block").take(pa.array(bi)),
                                                  pa.array(ub[qi, bi])], ["library_id", "query_id", "block", "ub"])

    return blocks.select("library_id", "block", "dim", "center", "angle").mapInArrow(run, "library_id string, query_id string, block bigint, ub double")


def _reached(blocks: DataFrame, packed: dict) -> DataFrame:
    """(library_id, block) of the blocks that some query's floor does not rule out."""
    shared = blocks.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        for b in batches:
            lib, dims = np.array(b.column("library_id").to_pylist(), object), b.column("dim").to_numpy()
            for name in set(lib) & set(shared.value):
                _, raw, _, floor = shared.value[name]
                mine = np.flatnonzero((lib == name) & (dims == raw.shape[1]))
                if len(mine):
                    some = b.take(pa.array(mine))
                    ub = upper((raw * inv_norms(raw)[:, None]) @ arrow_matrix(some.column("center")).T, some.column("angle").to_numpy()[None, :])
                    hit = np.flatnonzero((ub >= np.array(floor)[:, None] - 1e-12).any(0))
                    yield some.select(["library_id", "block"]).take(pa.array(hit))

    return blocks.select("library_id", "block", "dim", "center", "angle").mapInArrow(run, "library_id string, block bigint")


def _opened(batches: list[pa.RecordBatch]):
    """The blocks of a part: (library, dimension, block)."""
    for b in batches:
        for x in range(len(b)):
            one = _Block(b, x)
            yield one.library, one.dim, one


def _in_parts(blocks: DataFrame, queries: DataFrame, most_rows: int, most_bytes: int, scored) -> DataFrame:
    """:func:`knn_tree` of a batch of any size.  Of blocks and queries, those that make fewer parts are broadcast part by
    part: blocks past the queries, which stay with their hits (:mod:`vellum.operators.rounds`), or queries past the blocks, a part's
    hits written before the next begins."""
    q = queries.select("query_id", "library_id", "embedding", "k")
    n, size, widest, kmax = q.agg(F.count(F.lit(1)), F.sum(F.lit(64) + 8 * F.coalesce(F.size("embedding"), F.lit(0))),
                                  F.max(F.lit(64) + 8 * F.coalesce(F.size("embedding"), F.lit(0))), F.max("k")).first()
    most_rows = max(1_000, most_rows)
    # a quarter to spare, since a hash does not part evenly
    parts = max(2, math.ceil(n / most_rows * 1.25), math.ceil(size / max(1, most_bytes) * 1.25))
    held = F.col("n") * (F.col("dim") * 4 + 40) + F.size("node_ids") * (F.col("dim") * 8 + 40)
    rounds = parts_of(blocks.agg(F.sum(held)).first()[0], most_bytes)
    if rounds <= parts:
        return merge_topk(search_rounds(blocks, ["library_id", "block"], rounds, _opened, q, n, scored), max(1, kmax))
    q = stored(q.withColumn("_part", F.pmod(F.xxhash64("library_id", "query_id"), F.lit(parts))))
    # every task at work in every part: the blocks may have come out of a build in few partitions
    blocks = blocks.repartition(blocks.sparkSession.sparkContext.defaultParallelism).checkpoint()
    out = None
    for part in range(parts):
        # one that came out larger all the same is parted again
        some = stored(knn_tree(blocks, q.filter(F.col("_part") == part).drop("_part"), broadcast_rows=2 * most_rows,
                               broadcast_bytes=2 * most_bytes + 1_000 * widest, scored=scored))
        out = some if out is None else out.unionByName(some)
    return out


def knn_tree(blocks: DataFrame, queries: DataFrame, k: int | None = None, *, broadcast_rows: int = 20_000, broadcast_bytes: int = 32 << 20,
             scored=None) -> DataFrame:
    """Exact top-k per query down the tree of ``blocks``; same output as :func:`vellum.operators.knn.knn_join`.
    ``scored``, an accumulator of a pair of numbers, receives the scored and all (query, vector) pairs."""
    if k is not None:
        queries = queries.withColumn("k", F.lit(int(k)).cast("int"))
    queries = queries.withColumn("k", F.coalesce(F.col("k"), F.lit(DEFAULT_K)).cast("int"))
    rows = bounded_queries(queries, broadcast_rows, broadcast_bytes)
    if rows is None:
        return _in_parts(blocks, queries, broadcast_rows, broadcast_bytes, scored)
    kmax = max([1, *rows.column("k").to_pylist()])
    libraries = sorted({x for x in rows.column("library_id").to_pylist() if x is not None})
    blocks = blocks.filter(F.col("library_id").isin(libraries))
    packed = _by_library(rows, {})
    if (total := blocks.count()) > PROBE_BLOCKS:
        first = _roots(blocks, packed, 2).groupBy("library_id", "query_id").agg(F.max_by("block", F.struct("ub", "block")).alias("block"))
        names = first.select("library_id", "block").distinct().checkpoint()      # one a query at most
        probed = merge_topk(_candidates(blocks.join(F.broadcast(names), ["library_id", "block"], "left_semi"), packed, scored), kmax)
        kth = probed.filter(F.col("rank") == F.col("k")).select("library_id", "query_id", "score").toArrow()
        packed = _by_library(rows, {(x["library_id"], x["query_id"]): x["score"] for x in kth.to_pylist()})
        names = _reached(blocks, packed).checkpoint()
        some = names.count()
        if some <= BROADCAST_NAMES and some < total:
            blocks = blocks.join(F.broadcast(names), ["library_id", "block"], "left_semi")
    return merge_topk(_candidates(blocks, packed, scored), kmax, _salt_for(blocks.sparkSession))
