"""Cell index: recursive max-variance median split (X3, A3-A6, W2) and
exact cell-pruned top-k search (X4, T4).

Build (X3): by :mod:`vellum.operators.tree` (``split='local'``, one pass below cells of a task's size), or level by level over *all*
libraries at once (``'median'``, ``'approx'``), never in a loop over cells:

1. cells still larger than ``leaf_size`` are active;
2. per active cell, mean and population variance of the unit vectors as arrays (tasks
   hand on one partial a cell, however hot the cell);
3. the split axis is the dimension of largest variance, lowest index on ties;
4. the row at position ``floor(n/2)`` by ``(unit[axis], chunk_id)`` is selected by
   histogram refinement, and rows before it go left: ``cell -> 2*cell`` or ``2*cell + 1``;
5. the level is written and read back (lineage and constraints cut; survives executor loss).

A leaf cell gets its normalised centroid, its radius as the reference keeps
it (largest cosine distance to the centroid) and its *angular* radius, which
is what makes pruning exact (cosine distance breaks the triangle inequality).

Search, exact for every query (block co-groups throughout):

A. probe: for query q and cell c at angle θ with angular radius α, every
   member's similarity lies in [cos(min(π, θ + α)), cos(max(0, θ - α))].
   The cells with the best upper bounds are taken until they hold k
   vectors and their vectors are scored exactly; the k-th best of those
   scores (or the smallest member lower bound, if higher) is τ, a
   similarity that at least k vectors reach, so the k-th best is >= τ.
B. prune: a cell can hold a top-k vector only if its upper bound >= τ; the
   output is one row per (query, scoring block) listing its kept cells.
C. score: vectors of surviving cells only, scores below τ dropped in the
   task, exact local top-k, ranked merge.

Both bounds are widened by a small angle so float rounding can only keep
more cells, never lose a true neighbour.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vector import vec_dot, vec_normalize
from ..schema import DEFAULT_K, DEFAULT_LEAF_SIZE
from ..session import ensure_checkpoint_dir, fresh, stored
from .knn import (_MAX_SCORE_CELLS, CAND_SCHEMA, QUERY_KEY, _emit, _salt_for, _unit_rows, arrow_matrix, grid_cogroup, inv_norms,
                  merge_topk, raw_scores)
from .rank import at_rank
from .tree import block_cells, build_blocks
from .tree import block_rows as block_rows_of

ANGLE_SLACK = 1e-6
# Scored pairs a task holds before it cuts them to each query's k best.
_MAX_PENDING = 500_000


def unit_expr():
    """The unit vector of an index row, derived (never stored)."""
    return F.transform("vector", lambda x: x.cast("double") * F.col("inv_norm"))


def unit_rows(index: DataFrame) -> DataFrame:
    """Index rows with their unit vector as array<double>."""
    return index.withColumn("unit", unit_expr())


#: Groups whose partial sums a task holds before it hands them on.
_MAX_PARTIALS = 4_096


def _merged(group_cols: list[str]):
    """Partial moments of one group, combined (Chan et al.: no cancellation)."""
    def run(t: pa.Table) -> pa.Table:
        n = t.column("n").to_numpy().astype(np.float64)
        mean, m2 = arrow_matrix(t.column("mean").combine_chunks()), arrow_matrix(t.column("m2").combine_chunks())
        total = n.sum()
        center = n @ mean / total
        spread = m2.sum(axis=0) + n @ (mean - center) ** 2
        return pa.table({**{c: t.column(c)[:1] for c in group_cols}, "n": pa.array([int(total)]), "mean": pa.array([center]), "m2": pa.array([spread])})

    return run


def _same_length(b: pa.RecordBatch, vec: str) -> list[pa.RecordBatch]:
    """A batch by the length of its vectors: libraries may differ in it."""
    size = b.column(vec).value_lengths().to_numpy()
    each = np.unique(size)
    return [b] * len(each) if len(each) < 2 else [b.take(pa.array(np.flatnonzero(size == x))) for x in each]


def component_stats(rows: DataFrame, group_cols: list[str], vec: str = "unit") -> DataFrame:
    """A3/A5 inputs: per group ``n``, and the arrays ``mean`` and ``var`` (population variance) of its
    vectors.  A task adds up whole vectors by group and hands on one partial (count,
    mean, squared deviations) a group; partials are combined in two steps where there are many tasks."""
    x = rows.select(*group_cols, F.col(vec).alias("_x"))
    kinds = [f for f in x.schema.fields if f.name in group_cols]
    schema = T.StructType([*kinds, T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType())),
                           T.StructField("m2", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def partials(batches):
        held: dict = {}

        def out():
            keys, sums = list(held), list(held.values())
            cols = [pa.array([k[i] for k in keys], arrow.field(i).type) for i in range(len(kinds))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([int(v[0]) for v in sums], pa.int64()), pa.array([v[1] for v in sums], arrow.field("mean").type),
                                               pa.array([v[2] for v in sums], arrow.field("m2").type)], schema=arrow)

        for b in (some for whole in batches for some in _same_length(whole, "_x")):
            keys = list(zip(*(b.column(f.name).to_pylist() for f in kinds)))
            number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            code = np.fromiter((number[k] for k in keys), np.int64, len(keys))
            m = arrow_matrix(b.column("_x"))
            order = np.argsort(code, kind="stable")
            n = np.bincount(code)
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            mean = np.add.reduceat(m[order], at, axis=0) / n[:, None]
            m2 = np.add.reduceat((m - mean[code])[order] ** 2, at, axis=0)
            for k, i in number.items():
                if k in held:
                    n0, mean0, m20 = held[k]
                    both, d = n0 + n[i], mean[i] - mean0
                    held[k] = (both, mean0 + d * n[i] / both, m20 + m2[i] + d * d * n0 * n[i] / both)
                else:
                    held[k] = (n[i], mean[i], m2[i])
            if len(held) > _MAX_PARTIALS:
                yield out()
                held = {}
        if held:
            yield out()

    parts = x.filter(F.size("_x") > 0).mapInArrow(partials, schema)
    salts = _salt_for(rows.sparkSession)
    if salts > 1:
        salted = T.StructType([*kinds, T.StructField("_salt", T.LongType()), *schema.fields[len(kinds):]])
        by = [*group_cols, "_salt"]
        parts = parts.withColumn("_salt", F.pmod(F.spark_partition_id().cast("long"), F.lit(salts))).groupBy(*by).applyInArrow(_merged(by), salted).drop("_salt")
    whole = parts.groupBy(*group_cols).applyInArrow(_merged(group_cols), schema)
    return whole.select(*group_cols, "n", "mean", F.transform("m2", lambda v: v / F.col("n")).alias("var"))


def split_axis(stats: DataFrame, group_cols: list[str]) -> DataFrame:
    """Dimension of largest variance per group, lowest index on ties."""
    most = F.array_max("var")
    return stats.select(*group_cols, (F.array_position("var", most) - 1).cast("int").alias("axis"), most.alias("var"))


def centroids(stats: DataFrame, group_cols: list[str]) -> DataFrame:
    """A3: mean vector per group, re-normalised (a zero mean stays zero)."""
    return stats.select(*group_cols, vec_normalize("mean").alias("centroid"))


def radii(rows: DataFrame, cents: DataFrame, group_cols: list[str], vec: str = "unit") -> DataFrame:
    """A4: largest cosine distance (the reference's radius) and largest angle
    (the exact one) from the centroid, with the member count."""
    j = rows.select(*group_cols, vec).join(cents, group_cols)
    cos = F.least(F.greatest(vec_dot(vec, "centroid"), F.lit(-1.0)), F.lit(1.0))
    return j.groupBy(*group_cols).agg(
        F.max(F.lit(1.0) - cos).alias("radius"),
        F.max(F.acos(cos)).alias("angle"),
        F.count(F.lit(1)).alias("n"))


def median_split(rows: DataFrame, axes: DataFrame, sizes: DataFrame, group_cols: list[str], vec: str = "unit") -> DataFrame:
    """The first ``floor(n/2)`` rows of each group by ``(vec[axis], chunk_id)`` are left
    (``side`` 0), the rest right (1).  The first row of the right half is
    selected for all groups at once (:func:`vellum.operators.rank.at_rank`) and every row compared
    with it: no group, of whatever size, is sorted or ranked whole."""
    axes = fresh(axes.select(*group_cols, "axis").checkpoint())       # one row a group, read twice
    j = rows.join(axes, group_cols)
    if "vector" in rows.columns:    # one component, no need for the whole unit vector
        j = j.withColumn("_v", F.element_at("vector", F.col("axis") + 1).cast("double") * F.col("inv_norm"))
    else:
        j = j.withColumn("_v", F.element_at(vec, F.col("axis") + 1))
    if vec in j.columns and "vector" in rows.columns:
        j = j.drop(vec)
    targets = sizes.select(*group_cols, F.floor(F.col("n") / 2).alias("target"))
    first = at_rank(j, group_cols, "_v", "chunk_id", targets)
    j = j.join(fresh(first), group_cols)
    right = (F.col("_v") > F.col("_t")) | ((F.col("_v") == F.col("_t")) & (F.col("chunk_id") >= F.col("_id")))
    return j.withColumn("side", right.cast("int")).join(sizes.select(*group_cols, "n"), group_cols).drop("_v", "_t", "_id")


def approx_split(rows: DataFrame, axes: DataFrame, group_cols: list[str], accuracy: int = 10_000) -> DataFrame:
    """Split without ranking: each cell's threshold is the approximate median
    of its axis values (``percentile_approx``, a mergeable sketch, so a hot
    cell costs one partial aggregate), and a row goes right when its value
    is above the threshold.  Cells whose rows would all land on one side are
    not split (``side`` NULL)."""
    v = F.element_at("vector", F.col("axis") + 1).cast("double") * F.col("inv_norm")
    j = rows.join(axes.select(*group_cols, "axis"), group_cols).withColumn("_v", v)
    th = j.groupBy(*group_cols).agg(F.percentile_approx("_v", 0.5, accuracy).alias("_t"),
                                    F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    th = th.withColumn("_ok", F.col("_lo") < F.col("_hi")).withColumn(
        "_t", F.when(F.col("_t") >= F.col("_hi"), F.col("_lo")).otherwise(F.col("_t")))
    out = j.join(th, group_cols)
    side = F.when(F.col("_ok"), (F.col("_v") > F.col("_t")).cast("int"))
    return out.withColumn("side", side).drop("_v", "_t", "_lo", "_hi", "_ok")


def cells_of_blocks(blocks: DataFrame, block_rows: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """``(cell_index, cells)`` of the blocks of :func:`vellum.operators.tree.build_blocks`."""
    n = blocks.groupBy("library_id").agg(F.ceil(F.sum("n") / F.lit(block_rows)).alias("_nb"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(fresh(n), "library_id").withColumn("cblock", _place(F.col("_nb")).cast("int")).drop("_nb")

    rows = placed(block_rows_of(blocks)).select("library_id", "chunk_id", "vector", "inv_norm", "cell", "cblock")
    return rows, placed(block_cells(blocks)).select("library_id", "cell", "cblock", "centroid", "radius", "angle", "n")


def _place(blocks):
    """The scoring block of a cell.  Halves are about equal, so a leaf's place in the tree is its rows' share of
    the library: neighbouring leaves share a block, and blocks are about equally full."""
    level = F.length(F.bin("cell")) - 1
    place = F.col("cell") / F.pow(F.lit(2.0), level) - F.lit(1.0)
    return F.least(F.floor(place * blocks), blocks - 1)


def build_cells(index: DataFrame, leaf_size: int = DEFAULT_LEAF_SIZE, block_rows: int = 16_384,
                max_levels: int = 62, split: str = "local") -> tuple[DataFrame, DataFrame]:
    """Returns ``(cell_index, cells)``.

    ``split='local'``: the reference's rule (first floor(n/2) rows by the axis value go left) throughout
    (:mod:`vellum.operators.tree`): cells too large for one task by a selection over all their rows, level by level, the rest
    in one pass.  ``split='median'`` is that rule by a selection and a rewrite of the rows at every level.  ``split='approx'``
    splits level by level at an approximate median from a sketch.  Search stays exact in any case, since pruning
    uses each cell's measured angle.

    ``cell_index``: index rows with ``cell`` (heap numbering: root 1,
    children 2c and 2c+1) and ``cblock`` (the scoring block of the cell).
    ``cells``: one row per leaf: ``library_id, cell, cblock, centroid,
    radius, angle, n``."""
    if split == "local":
        return cells_of_blocks(build_blocks(index, leaf_size), block_rows)
    spark = index.sparkSession
    ensure_checkpoint_dir(spark)
    g = ["library_id", "cell"]
    # levels checkpoint only the stored columns; unit vectors are derived
    if split not in ("median", "approx"):
        raise ValueError(f"split must be 'local', 'median' or 'approx', not {split!r}")
    rows = (index.select("library_id", "chunk_id", "vector", "inv_norm")
            .withColumn("cell", F.lit(1).cast("long")).withColumn("_final", F.lit(False)))
    for level in range(max_levels + 1):
        sizes = rows.filter(~F.col("_final")).groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
        active = stored(sizes.filter(F.col("n") > leaf_size))
        if active.isEmpty():
            break
        if level == max_levels:
            raise ValueError(f"cells of more than {leaf_size} rows are left after {max_levels} levels")
        act = rows.join(active.select(*g), g, "left_semi")
        rest = rows.join(active.select(*g), g, "left_anti")
        axes = split_axis(component_stats(act.withColumn("unit", unit_expr()), g), g)
        if split == "median":
            parts = median_split(act, axes, active, g)
        else:
            parts = approx_split(act, axes, g)
        parts = (parts.withColumn("_final", F.col("side").isNull())
                 .withColumn("cell", F.when(F.col("side").isNull(), F.col("cell"))
                             .otherwise(F.col("cell") * 2 + F.col("side"))))
        rows = stored(rest.unionByName(parts.select(*rows.columns)))
    rows = rows.drop("_final")
    lib_n = rows.groupBy("library_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("_nb"))
    if split == "median":
        cblock = _place(F.col("_nb"))
    else:
        cblock = F.pmod(F.xxhash64("cell"), F.col("_nb"))
    rows = rows.join(lib_n, "library_id").withColumn("cblock", cblock.cast("int")).drop("_nb")
    rows = stored(rows)
    with_unit = rows.withColumn("unit", unit_expr())
    stats = component_stats(with_unit, g)
    cents = centroids(stats, g)
    r = radii(with_unit, cents, g)
    cb = rows.select(*g, "cblock").distinct()
    cells = cents.join(r, g).join(cb, g).select("library_id", "cell", "cblock", "centroid", "radius", "angle", "n")
    cell_index = rows.select("library_id", "chunk_id", "vector", "inv_norm", "cell", "cblock")
    return cell_index, cells


# ---------------------------------------------------------------------------
# search
# ---------------------------------------------------------------------------

_TAU_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("library_id", T.StringType(), True),
    T.StructField("cell", T.LongType(), False),
    T.StructField("cblock", T.IntegerType(), False),
    T.StructField("lb", T.DoubleType(), False),
    T.StructField("ub", T.DoubleType(), False),
    T.StructField("n", T.LongType(), False),
    T.StructField("k", T.IntegerType(), False),
])

_KEEP_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("library_id", T.StringType(), True),
    T.StructField("cblock", T.IntegerType(), False),
    T.StructField("_rblock", T.IntegerType(), False),
    T.StructField("cells", T.ArrayType(T.LongType(), False), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("k", T.IntegerType(), False),
    T.StructField("tau", T.DoubleType(), False),
])


def _angles(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(q @ c.T, -1.0, 1.0))


def knn_cells(cell_index: DataFrame, cells: DataFrame, queries: DataFrame, k: int | None = None, *,
              query_block_rows: int = 2_048, cell_block_rows: int = 16_384,
              kept: list | None = None) -> DataFrame:
    """Exact top-k per query scoring only cells that can hold a hit.
    Same output as :func:`vellum.operators.knn.knn_join`.  ``kept`` (a list)
    receives the cells scored (one row per query and scoring block, listing
    its cells), first those of the probe, then those kept: a query's scores are
    computed for the vectors of these cells and no others."""
    if k is not None:
        queries = queries.withColumn("k", F.lit(int(k)).cast("int"))
    # a query without a k of its own gets the default, whatever its neighbours ask for
    queries = queries.withColumn("k", F.coalesce(F.col("k"), F.lit(DEFAULT_K)).cast("int"))
    got = int(k) if k is not None else queries.agg(F.max("k")).first()[0]
    kmax = max(1, int(got) if got is not None else 1)
    q = fresh(queries.select("query_id", "library_id", "embedding", "k"))
    cl = fresh(cells.select("library_id", "cell", "cblock", "centroid", "angle", "n"))
    cell_index = fresh(cell_index)

    # A: per query, the most promising cells (best upper bound) until they
    # hold k vectors (k cells suffice: every cell holds a vector).  Two
    # valid floors for the k-th best score come from them: the smallest
    # member lower bound, and the k-th best exact score of their vectors.
    tau_arrow = to_arrow_schema(_TAU_SCHEMA)

    def pass_a(ct: pa.Table, qt_: pa.Table) -> pa.Table:
        cen = arrow_matrix(ct.column("centroid").combine_chunks())
        qu = _unit_rows(arrow_matrix(qt_.column("embedding").combine_chunks()))
        if qu.shape[1] != cen.shape[1]:
            return tau_arrow.empty_table()
        ang = _angles(qu, cen)
        alpha = ct.column("angle").to_numpy()[None, :]
        lb = np.cos(np.minimum(np.pi, ang + alpha + ANGLE_SLACK))
        ub = np.cos(np.maximum(0.0, ang - alpha - ANGLE_SLACK))
        q_ids = qt_.column("query_id").to_numpy()
        q_k = qt_.column("k").to_numpy().astype(np.int64)
        cell_ids = ct.column("cell").to_numpy()
        qi, ci, _ = _topk_generic(ub, q_k, cell_ids)
        out = pd.DataFrame({"query_id": q_ids[qi], "library_id": qt_.column("library_id").to_numpy()[qi],
                            "cell": cell_ids[ci], "cblock": ct.column("cblock").to_numpy()[ci].astype(np.int32),
                            "lb": lb[qi, ci], "ub": ub[qi, ci],
                            "n": ct.column("n").to_numpy()[ci], "k": q_k[qi].astype(np.int32)})
        return pa.Table.from_pandas(out, schema=tau_arrow, preserve_index=False)

    cand = grid_cogroup(cl, q, pass_a, _TAU_SCHEMA, left_id="cell", right_id="query_id",
                        left_block_rows=cell_block_rows, right_block_rows=query_block_rows, arrow=True)
    w = Window.partitionBy(*QUERY_KEY).orderBy(F.col("ub").desc(), F.col("cell").asc())
    top = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= kmax)
    top = top.withColumn("_cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    probe = top.filter(F.col("_cum") - F.col("n") < F.col("k")).checkpoint()
    tau_lb = (probe.groupBy(*QUERY_KEY)
              .agg(F.min("lb").alias("_lb"), F.max("_cum").alias("_tot"), F.first("k").alias("_k"))
              .select(*QUERY_KEY, F.when(F.col("_tot") >= F.col("_k"), F.col("_lb")).otherwise(F.lit(-2.0))
                      .alias("tau_lb")))

    nb = cl.groupBy("library_id").agg((F.max("cblock") + 1).cast("int").alias("_nb"))
    qn = q.groupBy("library_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(query_block_rows)).cast("int").alias("_nqb"))
    vectors = cell_index.select("library_id", "chunk_id", "vector", "inv_norm", "cell", "cblock")

    # exact scores of the probed cells' vectors: their k-th best is a floor
    probe_rows = (probe.groupBy(*QUERY_KEY, "cblock").agg(F.collect_list("cell").alias("cells"))
                  .join(fresh(q.select(*QUERY_KEY, "embedding", "k")), QUERY_KEY)
                  .join(fresh(qn), "library_id")
                  .withColumn("_rblock", F.pmod(F.xxhash64("query_id"), F.col("_nqb")).cast("int"))
                  .withColumn("tau", F.lit(-2.0)).drop("_nqb"))
    probed = merge_topk(_score_kept(vectors, probe_rows), kmax)
    tau_probe = probed.filter(F.col("rank") == F.col("k")).select(*QUERY_KEY, F.col("score").alias("tau_probe"))
    tau = (fresh(tau_lb).join(fresh(tau_probe), QUERY_KEY, "left")
           .select(*QUERY_KEY, F.greatest("tau_lb", F.coalesce("tau_probe", F.lit(-2.0))).alias("tau")))
    qt = fresh(q.join(fresh(tau), QUERY_KEY, "left").withColumn("tau", F.coalesce("tau", F.lit(-2.0))))

    # B: keep the cells whose upper bound reaches tau.  Cells are grouped by
    # their scoring block, so the output is one row per (query, scoring
    # block) listing its kept cells: never one row per (query, cell) pair.
    blocks = fresh(fresh(nb).join(fresh(qn), "library_id"))
    cb = (cl.join(blocks, "library_id")
          .withColumn("_rblock", F.explode(F.sequence(F.lit(0), F.col("_nqb") - 1))).drop("_nb", "_nqb"))
    qb = (qt.join(blocks, "library_id")
          .withColumn("_rblock", F.pmod(F.xxhash64("query_id"), F.col("_nqb")).cast("int"))
          .withColumn("cblock", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).drop("_nb", "_nqb"))

    keep_arrow = to_arrow_schema(_KEEP_SCHEMA)

    def pass_b(key, ct: pa.Table, qt_: pa.Table) -> pa.Table:
        if ct.num_rows == 0 or qt_.num_rows == 0:
            return keep_arrow.empty_table()
        cen = arrow_matrix(ct.column("centroid").combine_chunks())
        qu = _unit_rows(arrow_matrix(qt_.column("embedding").combine_chunks()))
        if qu.shape[1] != cen.shape[1]:
            return keep_arrow.empty_table()
        ub = np.cos(np.maximum(0.0, _angles(qu, cen) - ct.column("angle").to_numpy()[None, :] - ANGLE_SLACK))
        keep = ub >= qt_.column("tau").to_numpy()[:, None] - 1e-12
        cell_ids = ct.column("cell").to_numpy()
        rows = np.nonzero(keep.any(axis=1))[0]
        taken = qt_.take(pa.array(rows, type=pa.int64()))
        return pa.table({
            "query_id": taken.column("query_id"),
            "library_id": taken.column("library_id"),
            "cblock": pa.array(np.full(len(rows), key[1].as_py(), dtype=np.int32)),
            "_rblock": pa.array(np.full(len(rows), key[2].as_py(), dtype=np.int32)),
            "cells": pa.array([cell_ids[keep[i]].astype(np.int64) for i in rows],
                              type=pa.list_(pa.int64(), )),
            "embedding": taken.column("embedding"),
            "k": taken.column("k").cast(pa.int32()),
            "tau": taken.column("tau").cast(pa.float64()),
        }, schema=keep_arrow)

    keys = ["library_id", "cblock", "_rblock"]
    # written once: the cells asked for select the vectors, then the rows meet them
    rb = cb.groupBy(*keys).cogroup(qb.groupBy(*keys)).applyInArrow(pass_b, _KEEP_SCHEMA).checkpoint()
    if kept is not None:
        kept.append(probe_rows.select("query_id", "library_id", "cblock", "cells"))
        kept.append(rb.select("query_id", "library_id", "cblock", "cells"))

    # C: score the vectors of kept cells, one co-group per (library, scoring
    # block, query block); a query row lists its kept cells in that block.
    return merge_topk(_score_kept(vectors, rb), kmax)


def _score_kept(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """Exact local top-k of the vectors in each query's listed cells: one
    co-group per (library, scoring block, query block), and in it one product per
    cell, of the cell's vectors with the queries that list it.  ``vectors`` carry
    ``cell, cblock``; only those of a listed cell are shuffled, once per query
    block that lists it.  ``rows`` carry ``query_id, library_id, cblock, _rblock,
    cells, embedding, k, tau`` (scores below ``tau`` are dropped)."""
    cand_arrow = to_arrow_schema(CAND_SCHEMA)

    def pass_c(vt: pa.Table, qt_: pa.Table) -> pa.Table:
        if vt.num_rows == 0 or qt_.num_rows == 0:
            return cand_arrow.empty_table()
        c_ids = vt.column("chunk_id").to_numpy()
        cm = arrow_matrix(vt.column("vector").combine_chunks())
        vcell = vt.column("cell").to_numpy()
        c_inv = vt.column("inv_norm").to_numpy()
        qr = arrow_matrix(qt_.column("embedding").combine_chunks())
        q_inv = inv_norms(qr)
        q_ids = qt_.column("query_id").to_numpy()
        q_k = qt_.column("k").to_numpy().astype(np.int64)
        floor = qt_.column("tau").to_numpy() - 1e-12
        if cm.shape[1] != qr.shape[1]:
            return cand_arrow.empty_table()
        # both sides in order of their cells
        lists = qt_.column("cells").combine_chunks()
        asked, asker = lists.flatten().to_numpy(), np.repeat(np.arange(len(q_ids)), lists.value_lengths().to_numpy())
        by_cell = np.argsort(asked, kind="stable")
        asked, asker = asked[by_cell], asker[by_cell]
        members = np.argsort(vcell, kind="stable")
        found = np.unique(vcell)
        v_at = np.searchsorted(vcell[members], [found, found + 1])
        q_at = np.searchsorted(asked, [found, found + 1])
        best, waiting, n_waiting = [], [], 0
        for v0, v1, q0, q1 in zip(*v_at, *q_at):
            if q0 == q1:
                continue
            cs, qs = members[v0:v1], asker[q0:q1]
            for s in range(0, len(qs), max(1, _MAX_SCORE_CELLS // len(cs))):
                part = qs[s:s + max(1, _MAX_SCORE_CELLS // len(cs))]
                S = raw_scores(qr[part], q_inv[part], cm[cs], c_inv[cs])
                qi, ci = np.nonzero(S >= floor[part][:, None])
                qi, ci = part[qi], cs[ci]
                # one rounding for every pair, whatever product it came from: exact ties stay ties
                score = _pair_dots(qr, cm, qi, ci) * c_inv[ci] * q_inv[qi]
                waiting.append(pd.DataFrame({"qi": qi, "ci": ci, "score": score}))
                n_waiting += len(qi)
                if n_waiting > _MAX_PENDING:
                    best = [_best_per_query(best + waiting, q_k, c_ids)]
                    waiting, n_waiting = [], 0
        if not best + waiting:
            return cand_arrow.empty_table()
        res = _best_per_query(best + waiting, q_k, c_ids)
        out = _emit(q_ids, qt_.column("library_id").to_numpy(), q_k, c_ids, res)
        return pa.Table.from_pandas(out, schema=cand_arrow, preserve_index=False)

    keys = ["library_id", "cblock", "_rblock"]
    rows = rows.select("query_id", "library_id", "cblock", "_rblock", "cells", "embedding",
                       F.col("k").cast("int").alias("k"), F.col("tau").cast("double").alias("tau"))
    need = rows.select("library_id", "_rblock", F.explode("cells").alias("cell")).distinct()
    asked_for = vectors.join(fresh(need), ["library_id", "cell"])
    return asked_for.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(pass_c, CAND_SCHEMA)


def _pair_dots(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Dot products of the listed pairs, in slices of bounded memory."""
    out = np.empty(len(qi))
    step = max(1, _MAX_SCORE_CELLS // max(1, q.shape[1]))
    for s in range(0, len(qi), step):
        out[s:s + step] = np.einsum("ij,ij->i", q[qi[s:s + step]], c[ci[s:s + step]])
    return out


def _best_per_query(parts: list, q_k: np.ndarray, c_ids: np.ndarray) -> pd.DataFrame:
    """The k best entries of every query by ``(score desc, chunk_id asc)``."""
    df = pd.concat(parts, ignore_index=True)
    df["cid"] = c_ids[df["ci"].to_numpy()]
    df = df.sort_values(["qi", "score", "cid"], ascending=[True, False, True], kind="mergesort")
    r = df.groupby("qi").cumcount().to_numpy()
    return df.loc[r < q_k[df["qi"].to_numpy()], ["qi", "ci", "score"]]


def _topk_generic(S: np.ndarray, q_k: np.ndarray, ids: np.ndarray):
    """Per row of ``S``, the k largest entries by (value desc, id asc);
    returns (row idx, col idx, value) arrays."""
    nq, nc = S.shape
    kmax = int(q_k.max()) if nq else 0
    if nc == 0 or nq == 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, np.zeros(0)
    if kmax < nc:
        kth = -np.partition(-S, kmax - 1, axis=1)[:, kmax - 1]
        qi, ci = np.nonzero(S >= kth[:, None])
    else:
        qi, ci = np.indices(S.shape).reshape(2, -1)
    df = pd.DataFrame({"qi": qi, "ci": ci, "v": S[qi, ci], "id": ids[ci]})
    df = df.sort_values(["qi", "v", "id"], ascending=[True, False, True], kind="mergesort")
    r = df.groupby("qi").cumcount().to_numpy()
    df = df[r < q_k[df["qi"].to_numpy()]]
    return df["qi"].to_numpy(), df["ci"].to_numpy(), df["v"].to_numpy()


def add_to_cells(cell_index: DataFrame, cells: DataFrame, new: DataFrame,
                 query_block_rows: int = 2_048, leaf_size: int = DEFAULT_LEAF_SIZE, report: bool = False) -> tuple[DataFrame, ...]:
    """Q15 / U1 on a cell index without a rebuild: every new vector (index
    rows ``library_id, chunk_id, vector, inv_norm``) joins the leaf whose
    centroid is nearest (a k=1 search over centroids with the grid kernel),
    and that leaf's angular radius grows to cover it, so pruning stays exact.
    Centroids are kept; a rebuild re-balances.  Vectors of a library that has no
    cells yet get cells of their own (:func:`build_cells`).  An id given twice
    in a library with different rows is ambiguous and not added; equal rows count as
    one.  Returns ``(cell_index, cells)``, with ``report=True`` also the keys not added."""
    from .knn import knn_join
    from .mutate import gate

    cells, cell_index = fresh(cells), fresh(cell_index)
    new, twice = gate(new.select("library_id", "chunk_id", "vector", "inv_norm"), ["library_id", "chunk_id"], equal_once=True)
    new = new.checkpoint()
    known = fresh(cells.select("library_id").distinct())
    first_index, first_cells = build_cells(fresh(new.join(known, "library_id", "left_anti")), leaf_size)
    new = fresh(new.join(known, "library_id", "left_semi"))
    cen = cells.select("library_id", F.col("cell").cast("string").alias("chunk_id"),
                       F.col("centroid").cast("array<float>").alias("vector"),
                       F.lit(1.0).alias("inv_norm"))
    q = new.select(F.col("chunk_id").alias("query_id"), "library_id",
                   F.transform("vector", lambda x: x * F.col("inv_norm")).cast("array<float>").alias("embedding"),
                   F.lit(1).alias("k"))
    nearest = knn_join(cen, q, k=1, kernel="grid", query_block_rows=query_block_rows)
    placed = (new.join(fresh(nearest.select(F.col("query_id").alias("chunk_id"), "library_id",
                                            F.col("chunk_id").cast("long").alias("cell"))), ["library_id", "chunk_id"])
              .join(cells.select("library_id", "cell", "cblock"), ["library_id", "cell"]))
    grown = (placed.join(cells.select("library_id", "cell", "centroid"), ["library_id", "cell"])
             .withColumn("_cos", F.least(F.greatest(vec_dot(unit_expr(), "centroid"), F.lit(-1.0)), F.lit(1.0)))
             .groupBy("library_id", "cell")
             .agg(F.max(F.acos("_cos")).alias("_a"), F.max(F.lit(1.0) - F.col("_cos")).alias("_r"),
                  F.count(F.lit(1)).alias("_n")))
    cells2 = (cells.join(grown, ["library_id", "cell"], "left")
              .select("library_id", "cell", "cblock", "centroid",
                      F.greatest("radius", F.coalesce("_r", F.lit(0.0))).alias("radius"),
                      (F.greatest("angle", F.coalesce("_a", F.lit(0.0))) + F.lit(ANGLE_SLACK)).alias("angle"),
                      (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")))
    rows = cell_index.unionByName(placed.select(*cell_index.columns)).unionByName(first_index)
    out = rows, cells2.unionByName(first_cells)
    return (*out, twice.withColumn("reason", F.lit("duplicate_in_batch"))) if report else out


def remove_from_cells(cell_index: DataFrame, cells: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U4 on a cell index: drop rows by ``(library_id, chunk_id)`` and
    recount each leaf (the search's bound relies on exact counts; radii stay
    valid upper bounds).  Empty leaves disappear."""
    keys = ["library_id", "chunk_id"]
    rows = cell_index.join(ids.select(*keys).distinct(), keys, "left_anti")
    n = rows.groupBy("library_id", "cell").agg(F.count(F.lit(1)).alias("_n"))
    cells2 = cells.join(n, ["library_id", "cell"]).withColumn("n", F.col("_n")).drop("_n")
    return rows, cells2
