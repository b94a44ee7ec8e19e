"""Cell index: the level-wise Spark build equals a recursive NumPy build of
the same rules, and the pruned search equals brute force exactly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators.cells import build_cells, knn_cells
from vellum.schema import INDEX

from .helpers import brute_topk


def _index(spark, ids, vecs):
    rows = []
    for i, v in zip(ids, vecs):
        v32 = np.asarray(v, dtype=np.float32)
        n = float(np.sqrt(np.sum(v32.astype(np.float64) ** 2)))
        rows.append(("lib", i, [float(x) for x in v32], 1.0 / n if n > 0 else 0.0, 0))
    return spark.createDataFrame(rows, INDEX)


def numpy_cells(ids, vecs, leaf):
    """Reference rules: split on the max-variance axis (lowest index on ties),
    first floor(n/2) rows by (value, id) go left; heap cell numbers."""
    m = np.asarray(vecs, dtype=np.float32).astype(np.float64)
    n = np.sqrt((m * m).sum(axis=1))
    u = m * np.where(n > 0, 1.0 / np.where(n > 0, n, 1), 0)[:, None]
    out = {}

    def rec(idx, cell):
        if len(idx) <= leaf:
            for i in idx:
                out[ids[i]] = cell
            return
        axis = int(np.argmax(u[idx].var(axis=0)))
        order = sorted(idx, key=lambda i: (u[i, axis], ids[i]))
        h = len(order) // 2
        rec(order[:h], 2 * cell)
        rec(order[h:], 2 * cell + 1)

    rec(list(range(len(ids))), 1)
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(42)
    vecs = rng.standard_normal((100, 10))
    ids = [f"v{i:03d}" for i in range(100)]
    return ids, vecs


@pytest.mark.parametrize("split", ["local", "median"])
def test_build_matches_recursive_numpy(spark, data, split):
    ids, vecs = data
    ci, cells = build_cells(_index(spark, ids, vecs), leaf_size=8, split=split)
    got = {r["chunk_id"]: r["cell"] for r in ci.collect()}
    assert got == numpy_cells(ids, vecs, 8)
    c = cells.collect()
    assert sum(r["n"] for r in c) == 100 and all(r["n"] <= 8 for r in c)
    assert all(0 <= r["radius"] <= 2 and 0 <= r["angle"] <= np.pi for r in c)


@pytest.mark.parametrize("dim,k", [(3, 5), (10, 10)])
def test_knn_cells_exact(spark, dim, k):
    rng = np.random.default_rng(dim)
    vecs = rng.standard_normal((120, dim))
    ids = [f"v{i:03d}" for i in range(120)]
    ci, cells = build_cells(_index(spark, ids, vecs), leaf_size=6)
    qs = rng.standard_normal((6, dim))
    q = spark.createDataFrame([(f"q{j}", "lib", [float(x) for x in v], k) for j, v in enumerate(qs)],
                              "query_id string, library_id string, embedding array<float>, k int")
    res = knn_cells(ci, cells, q, cell_block_rows=3, query_block_rows=2)
    got = {}
    for r in res.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for j in range(len(qs)):
        qv = np.asarray(qs[j], dtype=np.float32)
        want = [i for i, _ in brute_topk(ids, np.asarray(vecs, dtype=np.float32), qv, k)]
        assert got[f"q{j}"] == want


def test_approx_split_is_exact_for_search(spark):
    rng = np.random.default_rng(11)
    vecs = rng.standard_normal((150, 4))
    vecs[:20] = vecs[0]                      # a block of identical vectors cannot be split
    ids = [f"v{i:03d}" for i in range(150)]
    ci, cells = build_cells(_index(spark, ids, vecs), leaf_size=6, split="approx")
    c = cells.collect()
    assert sum(r["n"] for r in c) == 150
    qs = rng.standard_normal((4, 4))
    q = spark.createDataFrame([(f"q{j}", "lib", [float(x) for x in v], 7) for j, v in enumerate(qs)],
                              "query_id string, library_id string, embedding array<float>, k int")
    got = {}
    for r in knn_cells(ci, cells, q, cell_block_rows=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for j in range(4):
        want = [i for i, _ in brute_topk(ids, np.asarray(vecs, dtype=np.float32),
                                         np.asarray(qs[j], dtype=np.float32), 7)]
        assert got[f"q{j}"] == want


def test_add_and_remove_keep_search_exact(spark):
    from vellum.operators.cells import add_to_cells, remove_from_cells

    rng = np.random.default_rng(21)
    vecs = rng.standard_normal((160, 5))
    ids = [f"v{i:03d}" for i in range(160)]
    idx = _index(spark, ids, vecs)
    base = idx.filter("chunk_id < 'v120'")
    new = idx.filter("chunk_id >= 'v120'")
    ci, cells = build_cells(base, leaf_size=6)
    ci, cells = add_to_cells(ci, cells, new)
    assert ci.count() == 160 and sum(r["n"] for r in cells.collect()) == 160
    gone = spark.createDataFrame([("lib", f"v{i:03d}") for i in range(0, 160, 3)], "library_id string, chunk_id string")
    ci, cells = remove_from_cells(ci, cells, gone)
    keep = [i for i in range(160) if i % 3]
    kids, kvecs = [ids[i] for i in keep], vecs[keep]
    qs = rng.standard_normal((5, 5))
    q = spark.createDataFrame([(f"q{j}", "lib", [float(x) for x in v], 6) for j, v in enumerate(qs)],
                              "query_id string, library_id string, embedding array<float>, k int")
    got = {}
    for r in knn_cells(ci, cells, q, cell_block_rows=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for j in range(5):
        want = [i for i, _ in brute_topk(kids, np.asarray(kvecs, dtype=np.float32),
                                         np.asarray(qs[j], dtype=np.float32), 6)]
        assert got[f"q{j}"] == want


def _two_libraries(spark):
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((60, 3)), rng.standard_normal((50, 3))
    ids = [f"v{i:03d}" for i in range(60)]
    # the same chunk ids in both libraries
    idx = _index(spark, ids, a).withColumn("library_id", F.lit("A")).unionByName(
        _index(spark, ids[:50], b).withColumn("library_id", F.lit("B")))
    return idx, {"A": (ids, a), "B": (ids[:50], b)}


def _check_against_brute(spark, ci, cells, held, k=6):
    rng = np.random.default_rng(6)
    qs = rng.standard_normal((4, 3))
    rows = [(f"q{j}", lib, [float(x) for x in v], k) for lib in held for j, v in enumerate(qs)]
    q = spark.createDataFrame(rows, "query_id string, library_id string, embedding array<float>, k int")
    got = {}
    for r in knn_cells(ci, cells, q).orderBy("library_id", "query_id", "rank").collect():
        got.setdefault((r["library_id"], r["query_id"]), []).append(r["chunk_id"])
    for lib, (ids, vecs) in held.items():
        for j in range(4):
            want = [i for i, _ in brute_topk(ids, np.asarray(vecs, dtype=np.float32), np.asarray(qs[j], dtype=np.float32), k)]
            assert got[(lib, f"q{j}")] == want


def test_same_ids_in_two_libraries(spark):
    idx, held = _two_libraries(spark)
    ci, cells = build_cells(idx, leaf_size=6)
    _check_against_brute(spark, ci, cells, held)


def test_add_same_ids_and_a_new_library(spark):
    """One id added to two libraries is kept in both; a library without cells gets its own."""
    from vellum.operators.cells import add_to_cells

    idx, held = _two_libraries(spark)
    base = idx.filter("library_id = 'A' AND chunk_id < 'v040'")
    ci, cells = build_cells(base, leaf_size=6)
    new = idx.join(base.select("library_id", "chunk_id"), ["library_id", "chunk_id"], "left_anti")
    ci, cells = add_to_cells(ci, cells, new, leaf_size=6)
    assert ci.count() == 110 and sum(r["n"] for r in cells.collect()) == 110
    _check_against_brute(spark, ci, cells, held)


def test_few_cells_are_scored_in_three_dimensions(spark):
    """Scores are computed for the listed cells only, a small share of the vectors."""
    rng = np.random.default_rng(9)
    vecs = rng.standard_normal((2000, 3))
    ci, cells = build_cells(_index(spark, [f"v{i:04d}" for i in range(2000)], vecs), leaf_size=20)
    q = spark.createDataFrame([(f"q{j}", "lib", [float(x) for x in rng.standard_normal(3)], 5) for j in range(5)],
                              "query_id string, library_id string, embedding array<float>, k int")
    kept = []
    assert knn_cells(ci, cells, q, kept=kept).count() == 25
    n = {r["cell"]: r["n"] for r in cells.collect()}
    scored = sum(n[c] for part in kept for r in part.collect() for c in r["cells"])
    assert scored <= 0.1 * 5 * 2000


def test_add_reports_ids_given_twice(spark):
    from vellum.operators.cells import add_to_cells

    rng = np.random.default_rng(22)
    idx = _index(spark, [f"v{i:02d}" for i in range(40)], rng.standard_normal((40, 3)))
    ci, cells = build_cells(idx.filter("chunk_id < 'v30'"), leaf_size=6)
    new, other = idx.filter("chunk_id >= 'v30'"), idx.filter("chunk_id = 'v31'").withColumn("chunk_id", F.lit("v30"))
    ci, cells, twice = add_to_cells(ci, cells, new.unionByName(new).unionByName(other), report=True)
    assert ci.count() == 39 and sum(r["n"] for r in cells.collect()) == 39
    assert [(r["chunk_id"], r["reason"]) for r in twice.collect()] == [("v30", "duplicate_in_batch")]


@pytest.mark.parametrize("split", ["median", "approx"])
def test_levels_are_tables_without_the_constraints_of_earlier_ones(spark, split):
    r = np.random.default_rng(4)
    ids = [f"v{i:03d}" for i in range(60)]
    index, _ = build_cells(_index(spark, ids, r.standard_normal((60, 3))), leaf_size=20, split=split)
    # a checkpoint keeps the constraints of its plan, which multiplied from level to level; a file has none
    assert index.inputFiles() and index.count() == 60
