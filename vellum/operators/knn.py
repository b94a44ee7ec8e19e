"""Exact cosine k-nearest-neighbour joins.

Scoring all vectors of a library against a query is inherent to exact
search; what must not happen at scale is materialising every (query, vector)
pair as a row.  Both batch kernels therefore score *blocks* inside an Arrow
batch with one NumPy matrix product and emit only each block's local top-k,
ordered by the total order ``(score desc, chunk_id asc)``.  Because the local
cut uses the same total order as the final one, the union of local top-k sets
contains the global top-k exactly, and one ranked merge finishes the job.

* ``scan`` kernel: the query batch is small enough to ship to every task
  (its size is checked: at most ``broadcast_rows`` rows and
  ``broadcast_bytes`` of vectors).  The index is read in place with
  ``mapInArrow`` (vectors go from the Arrow buffer to a matrix without
  per-row objects); it is never shuffled.
* ``grid`` kernel: any number of queries.  Each library's vectors are hashed
  into blocks of about ``block_rows`` vectors and its queries into blocks of
  about ``query_block_rows``; a (vector block, query block) pair is one
  co-group, so one task holds at most one block of each side, whatever the
  skew between libraries.  A hot library simply has more blocks.
* rounds (:mod:`vellum.operators.rounds`): a batch too large to broadcast, unless ``grid`` is asked
  for, a sample is given or the index makes more parts than the queries.  Vectors are broadcast part by part
  past the queries, which keep their best hits; no row is copied to another block.

The ranked merge keeps ``rank <= k`` with a ``row_number`` window whose
constant bound Catalyst turns into a partial ``WindowGroupLimit`` before the
shuffle; when the candidate list per query can be long it first merges within
salted sub-groups so no single group receives every block's candidates.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vector import inv_norm, literal_vector, vec_dot
from ..schema import DEFAULT_K
from ..session import fresh
from .rounds import inv_norms, parts_of, rows_of, search_rounds

CAND_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("library_id", T.StringType(), True),
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("k", T.IntegerType(), False),
])

# A query is one request to one library: the same ``query_id`` may be asked of several.
QUERY_KEY = ["library_id", "query_id"]

# Largest score matrix one NumPy product may build (entries); queries are
# processed in slices below this so memory per task stays bounded.
_MAX_SCORE_CELLS = 4_000_000


# ---------------------------------------------------------------------------
# NumPy block kernel
# ---------------------------------------------------------------------------

def empty_frame(schema: T.StructType) -> pd.DataFrame:
    """A zero-row frame whose dtypes Arrow converts to ``schema`` (an empty
    float64 column cannot become a string column)."""
    num = {T.LongType: np.int64, T.IntegerType: np.int32, T.DoubleType: np.float64,
           T.FloatType: np.float32, T.BooleanType: bool}
    return pd.DataFrame({f.name: pd.Series(np.zeros(0, dtype=num.get(type(f.dataType), object)))
                         for f in schema.fields})


def arrow_matrix(arr) -> np.ndarray:
    """An Arrow list<float> column of equal-length vectors as a float64
    matrix, straight from the values buffer (no per-row Python objects)."""
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0), dtype=np.float64)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    d = len(flat) // n
    if d * n != len(flat):
        raise ValueError("vectors of one library must share a dimension")
    return flat.reshape(n, d)


def _as_matrix(vectors) -> np.ndarray:
    """Stack a pandas Series of equal-length arrays into a float64 matrix."""
    if len(vectors) == 0:
        return np.zeros((0, 0), dtype=np.float64)
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def raw_scores(q_raw: np.ndarray, q_inv: np.ndarray, c_raw: np.ndarray, c_inv: np.ndarray) -> np.ndarray:
    """Cosine scores as the SQL form computes them: the raw dot product
    first, then the two inverse norms (dot * 1/|c| * 1/|q|).  Normalising
    first would turn exact ties (e.g. a dot product of exactly 0) into
    rounding noise and break the id tie rule."""
    S = q_raw @ c_raw.T
    S *= c_inv[None, :]
    S *= q_inv[:, None]
    return S


def _unit_rows(m: np.ndarray) -> np.ndarray:
    if m.size == 0:
        return m
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    inv = np.divide(1.0, n, out=np.zeros_like(n), where=n > 0)
    return m * inv[:, None]


def block_topk(q_ids: np.ndarray, q_raw: np.ndarray, q_inv: np.ndarray, q_k: np.ndarray,
               c_ids: np.ndarray, c_raw: np.ndarray, c_inv: np.ndarray,
               q_floor: np.ndarray | None = None) -> pd.DataFrame:
    """Local exact top-k of one block: for each query row keep its ``k`` best
    vectors by ``(score desc, chunk_id asc)``.  Ties at the cut are resolved
    by id, the same way the global merge resolves them.  ``q_floor`` (per
    query) drops scores below a bound the global k-th best is known to reach."""
    nq, nc = len(q_ids), len(c_ids)
    if nq == 0 or nc == 0:
        return pd.DataFrame({"qi": np.zeros(0, np.int64), "ci": np.zeros(0, np.int64),
                             "score": np.zeros(0)})
    out = []
    step = max(1, _MAX_SCORE_CELLS // nc)
    for s in range(0, nq, step):
        ks = q_k[s:s + step]
        S = raw_scores(q_raw[s:s + step], q_inv[s:s + step], c_raw, c_inv)   # (slice, nc) float64
        if q_floor is not None:
            S[S < q_floor[s:s + step, None]] = -np.inf
        kmax = int(ks.max())
        if kmax < nc:
            # k-th best score per row; keep everything >= it (ties included)
            kth = -np.partition(-S, kmax - 1, axis=1)[:, kmax - 1]
            qi, ci = np.nonzero(S >= kth[:, None])
        else:
            qi, ci = np.indices(S.shape).reshape(2, -1)
        sc = S[qi, ci]
        if q_floor is not None:
            live = np.isfinite(sc)
            qi, ci, sc = qi[live], ci[live], sc[live]
        df = pd.DataFrame({"qi": qi + s, "ci": ci, "score": sc, "cid": c_ids[ci]})
        df = df.sort_values(["qi", "score", "cid"], ascending=[True, False, True], kind="mergesort")
        df["r"] = df.groupby("qi").cumcount()
        df = df[df["r"].to_numpy() < q_k[df["qi"].to_numpy()]]
        out.append(df[["qi", "ci", "score"]])
    return pd.concat(out, ignore_index=True)


def _emit(q_ids, q_libs, q_k, c_ids, res: pd.DataFrame) -> pd.DataFrame:
    qi = res["qi"].to_numpy()
    return pd.DataFrame({
        "query_id": q_ids[qi],
        "library_id": q_libs[qi],
        "chunk_id": c_ids[res["ci"].to_numpy()],
        "score": res["score"].to_numpy(dtype=np.float64),
        "k": q_k[qi].astype(np.int32),
    })


def _reduce_candidates(df: pd.DataFrame) -> pd.DataFrame:
    """Keep each query's k best rows of a candidate frame."""
    if df.empty:
        return df
    df = df.sort_values([*QUERY_KEY, "score", "chunk_id"], ascending=[True, True, False, True],
                        kind="mergesort")
    r = df.groupby(QUERY_KEY).cumcount().to_numpy()
    return df[r < df["k"].to_numpy()]


# ---------------------------------------------------------------------------
# kernels
# ---------------------------------------------------------------------------

def _scan_candidates(index: DataFrame, qrows: list, floors: dict | None = None) -> DataFrame:
    """``scan`` kernel: queries (already bounded, collected) ride along to every
    task; the index is streamed batch by batch and never shuffled.
    ``floors`` ((library, query) -> score) lets tasks drop scores that cannot reach
    the global top-k."""
    spark = index.sparkSession
    by_lib: dict = defaultdict(list)
    for r in qrows:
        by_lib[r["library_id"]].append(r)
    packed = {}
    for lib, rows in by_lib.items():
        ids = np.array([r["query_id"] for r in rows], dtype=object)
        m = _as_matrix([r["embedding"] for r in rows])
        ks = np.array([int(r["k"]) for r in rows], dtype=np.int64)
        fl = None
        if floors:
            fl = np.array([floors.get((lib, r["query_id"]), -np.inf) for r in rows], dtype=np.float64)
        packed[lib] = (ids, m, inv_norms(m), ks, fl)
    bc = spark.sparkContext.broadcast(packed)

    arrow_schema = to_arrow_schema(CAND_SCHEMA)

    def run(batches):
        table = bc.value
        pending, pending_rows = [], 0
        for rb in batches:
            if rb.num_rows == 0:
                continue
            libs = rb.column("library_id").to_numpy(zero_copy_only=False)
            ids = rb.column("chunk_id").to_numpy(zero_copy_only=False)
            inv = rb.column("inv_norm").to_numpy(zero_copy_only=False)
            vec = rb.column("vector")
            # group the batch's rows by library once (stable sort + split)
            names, inverse = np.unique(libs.astype(str), return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            bounds = np.cumsum(np.bincount(inverse, minlength=len(names)))[:-1]
            for lib, rows in zip(names, np.split(order, bounds)):
                if lib not in table:
                    continue
                q_ids, q_raw, q_inv, q_k, q_floor = table[lib]
                c = arrow_matrix(vec.take(pa.array(rows)))
                if c.shape[1] != q_raw.shape[1]:
                    continue  # dimension mismatch is rejected before the join
                res = block_topk(q_ids, q_raw, q_inv, q_k, ids[rows], c, inv[rows], q_floor)
                pending.append(_emit(q_ids, np.full(len(q_ids), lib, dtype=object), q_k, ids[rows], res))
                pending_rows += len(res)
            if pending_rows > 200_000:
                pending = [_reduce_candidates(pd.concat(pending, ignore_index=True))]
                pending_rows = len(pending[0])
        if pending:
            out = _reduce_candidates(pd.concat(pending, ignore_index=True))
            yield pa.RecordBatch.from_pandas(out, schema=arrow_schema, preserve_index=False)

    # only the libraries the batch asks about: with the index stored
    # partitioned by library this is partition pruning at the scan
    libs = sorted(k for k in packed if k is not None)
    return (index.filter(F.col("library_id").isin(libs))
            .select("library_id", "chunk_id", "vector", "inv_norm")
            .mapInArrow(run, CAND_SCHEMA))


def grid_cogroup(left: DataFrame, right: DataFrame, fn, schema, *, key: str = "library_id",
                 left_id: str, right_id: str, left_block_rows: int, right_block_rows: int,
                 arrow: bool = False) -> DataFrame:
    """Co-group two keyed tables block by block: within each ``key`` value the
    left rows are hashed into ``ceil(n_left / left_block_rows)`` blocks and the
    right rows into ``ceil(n_right / right_block_rows)`` blocks, and ``fn``
    runs once per (key, left block, right block) with both sides as pandas
    frames.  Every left row meets every right row of its key exactly once,
    and one call never holds more than about one block of each side.  Each
    row is copied once per block of the other side, never once per row.
    With ``arrow=True`` ``fn`` takes and returns ``pyarrow.Table``s.
    """
    left, right = fresh(left), fresh(right)     # the two sides may share a lineage
    l_stats = left.groupBy(key).agg(F.count(F.lit(1)).alias("_nl"))
    r_stats = right.groupBy(key).agg(F.count(F.lit(1)).alias("_nr"))
    blocks = (fresh(l_stats).join(fresh(r_stats), key)
              .select(key,
                      F.ceil(F.col("_nl") / F.lit(left_block_rows)).cast("int").alias("_nb"),
                      F.ceil(F.col("_nr") / F.lit(right_block_rows)).cast("int").alias("_nqb")))
    blocks = fresh(blocks)
    lb = (left.join(blocks, key)
          .withColumn("_lblock", F.pmod(F.xxhash64(left_id), F.col("_nb")).cast("int"))
          .withColumn("_rblock", F.explode(F.sequence(F.lit(0), F.col("_nqb") - 1)))
          .drop("_nb", "_nqb"))
    rb = (right.join(blocks, key)
          .withColumn("_rblock", F.pmod(F.xxhash64(right_id), F.col("_nqb")).cast("int"))
          .withColumn("_lblock", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
          .drop("_nb", "_nqb"))
    keys = [key, "_lblock", "_rblock"]

    grouped = lb.groupBy(*keys).cogroup(rb.groupBy(*keys))
    if arrow:
        empty = to_arrow_schema(schema).empty_table()

        def run_arrow(lt: pa.Table, rt: pa.Table) -> pa.Table:
            if lt.num_rows == 0 or rt.num_rows == 0:
                return empty
            return fn(lt, rt)

        return grouped.applyInArrow(run_arrow, schema)

    def run(_k, lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if lpdf.empty or rpdf.empty:
            return empty_frame(schema)
        return fn(lpdf, rpdf)

    return grouped.applyInPandas(run, schema)


def _grid_candidates(index: DataFrame, queries: DataFrame,
                     block_rows: int, query_block_rows: int) -> DataFrame:
    """``grid`` kernel: co-group (library, vector block, query block); both
    blocks arrive as Arrow tables and become matrices from their buffers."""
    arrow_schema = to_arrow_schema(CAND_SCHEMA)

    def fn(lt: pa.Table, rt: pa.Table) -> pa.Table:
        c = arrow_matrix(lt.column("vector").combine_chunks())
        q = arrow_matrix(rt.column("embedding").combine_chunks())
        if q.shape[1] != c.shape[1]:
            return arrow_schema.empty_table()
        c_ids = lt.column("chunk_id").to_numpy()
        q_ids = rt.column("query_id").to_numpy()
        q_libs = rt.column("library_id").to_numpy()
        q_k = rt.column("k").to_numpy().astype(np.int64)
        floor = None
        if "_floor" in rt.column_names:
            floor = rt.column("_floor").to_numpy(zero_copy_only=False)
            floor = np.where(np.isnan(floor.astype(np.float64)), -np.inf, floor.astype(np.float64))
        res = block_topk(q_ids, q, inv_norms(q), q_k, c_ids, c, lt.column("inv_norm").to_numpy(), floor)
        out = _emit(q_ids, q_libs, q_k, c_ids, res)
        return pa.Table.from_pandas(out, schema=arrow_schema, preserve_index=False)

    cols = ["query_id", "library_id", "embedding", "k"]
    if "_floor" in queries.columns:
        cols.append("_floor")
    q = queries.select(*cols)
    return grid_cogroup(index.select("library_id", "chunk_id", "vector", "inv_norm"), q, fn, CAND_SCHEMA,
                        left_id="chunk_id", right_id="query_id",
                        left_block_rows=block_rows, right_block_rows=query_block_rows, arrow=True)


def merge_topk(cands: DataFrame, kmax: int, salt_buckets: int = 1,
               rank_col: str = "rank") -> DataFrame:
    """Global ranked merge of local candidates: ``rank`` is the position by
    ``(score desc, chunk_id asc)`` within ``(library_id, query_id)``; rows with
    ``rank <= k`` remain (``kmax`` is the largest k of all queries).
    ``salt_buckets > 1`` merges in two rounds (within a salt first) so no group ever holds every candidate of a
    query with a very long candidate list."""
    order = [F.col("score").desc(), F.col("chunk_id").asc()]
    if salt_buckets > 1:
        w1 = Window.partitionBy(*QUERY_KEY, "_salt").orderBy(*order)
        cands = (cands.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salt_buckets)))
                 .withColumn("_r1", F.row_number().over(w1))
                 .filter(F.col("_r1") <= kmax).drop("_salt", "_r1"))
    w = Window.partitionBy(*QUERY_KEY).orderBy(*order)
    return (cands.withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= kmax)
            .filter(F.col(rank_col) <= F.col("k"))
            .withColumn(rank_col, F.col(rank_col).cast("long")))


def _salt_for(spark) -> int:
    """Salts of the first merge round, from the parallelism the session is set
    up for (asking the frame for its partitions would run its shuffles)."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return 1 if n <= 64 else int(math.ceil(math.sqrt(n)))


def bounded_queries(queries: DataFrame, most_rows: int, most_bytes: int) -> pa.Table | None:
    """The batch of queries when its rows and the bytes of its vectors, known before
    anything is collected, are within the bounds; else None."""
    q = queries.select("query_id", "library_id", "embedding", "k")
    size = F.lit(64) + 8 * F.coalesce(F.size("embedding"), F.lit(0))
    n, total = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return q.toArrow() if n <= most_rows and total <= most_bytes else None


def knn_join(index: DataFrame, queries: DataFrame, k: int | None = None, *,
             kernel: str = "auto", broadcast_rows: int = 20_000, broadcast_bytes: int = 32 << 20, block_rows: int = 16_384,
             query_block_rows: int = 8_192, sample: DataFrame | None = None) -> DataFrame:
    """Exact top-k per query among the indexed vectors of the query's
    library.

    ``index``: ``library_id, chunk_id, vector, inv_norm`` (see
    :func:`vellum.plans.index.build_index`).  ``queries``: ``query_id,
    library_id, embedding`` and, unless ``k`` is given, a per-query ``k``.
    Returns ``query_id, library_id, chunk_id, score, k, rank``; fewer than k
    rows when the library holds fewer vectors (T5: k >= n gives the full
    ranking).  A NULL k is ``schema.DEFAULT_K``.  A batch of queries too large to
    broadcast is searched in rounds or by the grid kernel, also when ``scan`` is asked for.  A
    query is known by ``(library_id, query_id)``: one id asked of several libraries is several queries.

    ``sample`` (optional, both kernels): a stored sample of the index (see
    ``plans.index.build_index(sample_fraction=...)``).  The k-th best score
    of a query within the sample is a floor the true k-th best reaches (the
    sample is a subset), so every task drops scores below it: the candidates
    shuffled per query shrink from about k per task to about k / fraction,
    and the result is unchanged.
    """
    if k is not None:
        queries = queries.withColumn("k", F.lit(int(k)).cast("int"))
    # a query without a k of its own gets the default, whatever its neighbours ask for
    queries = queries.withColumn("k", F.coalesce(F.col("k"), F.lit(DEFAULT_K)).cast("int"))
    q = queries.select("query_id", "library_id", "embedding", "k")

    if kernel in ("auto", "scan"):
        rows = bounded_queries(q, broadcast_rows, broadcast_bytes)
        if rows is not None:
            rows = rows.to_pylist()
            kmax = max([1, *(int(r["k"]) for r in rows)])
            floors = None
            if sample is not None:
                pre = merge_topk(_scan_candidates(sample, rows), kmax)
                # a floor only for queries whose sample held k vectors (bounded: one row per query)
                kth = pre.filter(F.col("rank") == F.col("k")).select(*QUERY_KEY, "score").collect()
                floors = {(r["library_id"], r["query_id"]): r["score"] for r in kth}
            cands = _scan_candidates(index, rows, floors)
            return merge_topk(cands, kmax, _salt_for(index.sparkSession))
    got = int(k) if k is not None else queries.agg(F.max("k")).first()[0]
    kmax = max(1, int(got) if got is not None else 1)
    if kernel != "grid" and sample is None:
        n, size = q.agg(F.count(F.lit(1)), F.sum(F.lit(64) + 8 * F.coalesce(F.size("embedding"), F.lit(0)))).first()
        rows = index.select("library_id", "chunk_id", "vector", "inv_norm")
        parts = parts_of(rows.agg(F.sum(F.lit(64) + 4 * F.size("vector"))).first()[0], broadcast_bytes)
        if parts <= max(parts_of(size, broadcast_bytes), parts_of(n, max(1_000, broadcast_rows))):
            return merge_topk(search_rounds(rows, ["library_id", "chunk_id"], parts, rows_of, q, n), kmax)
    if sample is not None:
        # floors as a table joined to the queries: nothing is collected
        pre = merge_topk(_grid_candidates(sample, q, block_rows, query_block_rows), kmax)
        floors = pre.filter(F.col("rank") == F.col("k")).select(*QUERY_KEY, F.col("score").alias("_floor"))
        q = fresh(q).join(fresh(floors), QUERY_KEY, "left")
    cands = _grid_candidates(index, q, block_rows, query_block_rows)
    return merge_topk(cands, kmax, 1)


def topk_one(index: DataFrame, query: list[float], k: int = 5,
             library_id: str | None = None) -> DataFrame:
    """Exact top-k for one query vector given as a constant.  Pure
    Catalyst: the score is an expression, the cut is ``TakeOrderedAndProject``
    (a per-task top-k, then one merge of k rows per task)."""
    idx = index if library_id is None else index.filter(F.col("library_id") == library_id)
    qv = literal_vector(query)
    q_inv = inv_norm(qv)
    scored = idx.select("library_id", "chunk_id",
                        (vec_dot("vector", qv) * F.col("inv_norm") * q_inv).alias("score"))
    return scored.orderBy(F.col("score").desc(), F.col("chunk_id").asc()).limit(int(k))


def full_ranking(index: DataFrame, query: list[float], library_id: str | None = None) -> DataFrame:
    """T5: every vector scored against one query, in descending order (what
    T1 returns when k >= n).  ``orderBy`` is a range-partitioned sort, so no
    task holds more than its slice; :func:`vellum.operators.rank.positions`
    numbers the rows when dense ranks are needed."""
    idx = index if library_id is None else index.filter(F.col("library_id") == library_id)
    qv = literal_vector(query)
    scored = idx.select("library_id", "chunk_id",
                        (vec_dot("vector", qv) * F.col("inv_norm") * inv_norm(qv)).alias("score"))
    return scored.orderBy(F.col("score").desc(), F.col("chunk_id").asc())
