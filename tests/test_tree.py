"""The one-pass cell tree and its search against brute force; rank selection; array moments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import cells as CL
from vellum.operators import tree as TR
from vellum.operators.rank import at_rank
from vellum.schema import INDEX

from .helpers import brute_topk


def index_of(spark, libs):
    rows = []
    for lib, (ids, vecs) in libs.items():
        for i, v in zip(ids, np.asarray(vecs, dtype=np.float32)):
            n = float(np.sqrt(np.sum(v.astype(np.float64) ** 2)))
            rows.append((lib, i, [float(x) for x in v], 1.0 / n if n > 0 else 0.0, 0))
    return spark.createDataFrame(rows, INDEX)


def queries_of(spark, rows):
    return spark.createDataFrame(rows, "query_id string, library_id string, embedding array<float>, k int")


def clustered(n, dim, seed, spread=0.05):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((12, dim))
    return [f"v{i:05d}" for i in range(n)], (centers[r.integers(0, 12, n)] + spread * r.standard_normal((n, dim))).astype(np.float32)


def check(spark, libs, blocks, seed=0, k=(1, 7, 25), **opts):
    r = np.random.default_rng(seed)
    rows = [(f"q{j}", lib, [float(x) for x in r.standard_normal(len(vecs[0]))], k[j % len(k)]) for lib, (_, vecs) in libs.items() for j in range(6)]
    rows += [(f"own{j}", lib, [float(x) for x in vecs[j]], 5) for lib, (_, vecs) in libs.items() for j in range(0, len(vecs), max(1, len(vecs) // 4))]
    got = {}
    for x in TR.knn_tree(blocks, queries_of(spark, rows), **opts).orderBy("rank").collect():
        got.setdefault((x["library_id"], x["query_id"]), []).append(x["chunk_id"])
    for q, lib, v, n in rows:
        ids, vecs = libs[lib]
        assert got[lib, q] == [i for i, _ in brute_topk(ids, vecs, np.asarray(v, dtype=np.float32), n)], (lib, q)


def libraries():
    zeros = np.zeros((5, 4), np.float32)
    ids, v = clustered(700, 4, 1)
    same = np.repeat(np.array([[1.0, 2, 3, 4]], np.float32), 90, axis=0)
    return {"a": (ids, v), "b": clustered(300, 8, 2), "ties": ([f"t{i:03d}" for i in range(95)], np.concatenate([same, zeros])), "one": (["x"], np.array([[1.0, 0, 0]], np.float32))}


def test_search_is_exact(spark):
    libs = libraries()
    blocks = TR.build_blocks(index_of(spark, libs), 8)
    check(spark, libs, blocks)
    assert blocks.agg(F.sum("n")).first()[0] == sum(len(i) for i, _ in libs.values())


def test_large_libraries_are_routed_by_fitted_trees(spark, monkeypatch):
    monkeypatch.setattr(TR, "GROUP_VALUES", 200)
    monkeypatch.setattr(TR, "FIT_ROWS", 128)
    monkeypatch.setattr(TR, "BLOCK_VALUES", 100)
    monkeypatch.setattr(TR, "PROBE_BLOCKS", 3)
    libs = libraries()
    index = index_of(spark, libs)
    blocks = TR.build_blocks(index, 8)
    rows = blocks.collect()
    assert max(r["n"] * r["dim"] for r in rows) <= 100 and len({(r["library_id"], r["block"]) for r in rows}) == len(rows)
    check(spark, libs, blocks)
    check(spark, libs, blocks, broadcast_rows=0)                # the co-group search
    # every row is in the cell its leaf says, once, whatever the partitioning of the input
    found = sorted((r["library_id"], r["chunk_id"], r["cell"]) for r in TR.block_rows(blocks).collect())
    again = sorted((r["library_id"], r["chunk_id"], r["cell"]) for r in TR.block_rows(TR.build_blocks(index.repartition(7, "chunk_id"), 8)).collect())
    assert found == again and len(found) == index.count()
    cells = TR.block_cells(blocks).collect()
    assert sorted((c["library_id"], c["cell"]) for c in cells) == sorted({(lib, cell) for lib, _, cell in found})
    assert all(c["n"] <= 8 for c in cells)


def test_pruning_is_measured_and_falls_through(spark):
    r = np.random.default_rng(4)
    low, high = r.standard_normal((4000, 3)), r.standard_normal((1500, 48))
    for vecs, least, most in ((low, 0.0, 0.1), (high, 0.9, 1.05)):
        libs = {"lib": ([f"v{i:05d}" for i in range(len(vecs))], vecs.astype(np.float32))}
        scored = spark.sparkContext.accumulator(np.zeros(2, np.int64), _Sum())
        check(spark, libs, TR.build_blocks(index_of(spark, libs), 20), k=(10,), scored=scored)
        some, every = scored.value
        assert least <= some / every <= most


from pyspark.accumulators import AccumulatorParam  # noqa: E402


class _Sum(AccumulatorParam):
    def zero(self, value):
        return np.zeros_like(value)

    def addInPlace(self, a, b):
        return a + b


def test_bounds_hold_for_zero_centres_and_queries():
    r = np.random.default_rng(9)
    for _ in range(200):
        v = r.standard_normal((6, 3))
        v[r.integers(0, 6)] = 0
        n = np.sqrt((v * v).sum(1, keepdims=True))
        unit = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        center, angle, _ = TR.node_bounds(unit, np.array([0]), np.array([6]))
        q = r.standard_normal(3) * r.integers(0, 2)
        norm = np.sqrt(q @ q)
        q = q / norm if norm else q
        assert (unit @ q).max() <= TR.upper(q @ center[0], angle[0]) + 1e-12


@pytest.mark.parametrize("small,bins", [(4096, 1024), (1, 4), (3, 2)])
def test_at_rank_selects_without_sorting(spark, small, bins):
    r = np.random.default_rng(2)
    rows = []
    for g, n in (("a", 1), ("b", 2), ("c", 57), ("hot", 400), ("same", 120)):
        for i in range(n):
            v = 1.0 if g == "same" else float(r.choice([0.0, -1.5, 2.25, r.standard_normal()]))
            rows.append((g, f"{r.integers(0, 3)}x" * int(r.integers(0, 3)) + f"{i}", v))
    df = spark.createDataFrame(rows, "g string, id string, v double").repartition(5)
    for share in (0.0, 0.5, 0.99):
        want = {}
        for g in {x[0] for x in rows}:
            mine = sorted((v, i) for h, i, v in rows if h == g)
            want[g] = mine[int(share * len(mine))]
        targets = df.groupBy("g").agg(F.floor(F.count(F.lit(1)) * share).alias("target"))
        got = {x["g"]: (x["_t"], x["_id"]) for x in at_rank(df, ["g"], "v", "id", targets, small, bins).collect()}
        assert got == want


def test_moments_equal_numpy(spark, monkeypatch):
    r = np.random.default_rng(3)
    m, g = 1e3 + r.standard_normal((500, 6)), r.integers(0, 5, 500)
    df = spark.createDataFrame([(int(a), None if a == 4 else "x", [float(v) for v in x]) for a, x in zip(g, m)], "g long, h string, unit array<double>").repartition(6)
    for salts in (1, 3):
        monkeypatch.setattr(CL, "_salt_for", lambda spark: salts)
        stats = CL.component_stats(df, ["g", "h"])
        plan = stats._jdf.queryExecution().toString()
        assert "Generate" not in plan and "explode" not in plan
        for x in stats.collect():
            mine = m[g == x["g"]]
            assert x["n"] == len(mine) and np.allclose(x["mean"], mine.mean(0)) and np.allclose(x["var"], mine.var(0))
        for x in CL.split_axis(stats, ["g", "h"]).collect():
            assert x["axis"] == int(np.argmax(m[g == x["g"]].var(0)))


def test_large_batches_are_searched_part_by_part_on_blocks(spark, monkeypatch):
    def plainer(*a, **k):
        raise AssertionError("cells one by one")

    monkeypatch.setattr(CL, "knn_cells", plainer)
    ids, vecs = clustered(300, 6, 9)
    blocks = TR.build_blocks(index_of(spark, {"l": (ids, vecs)}), 20)
    rows = [(f"q{j:04d}", "l", [float(x) for x in vecs[j % 300]], 3) for j in range(1_500)]
    got = {}
    for x in TR.knn_tree(blocks, queries_of(spark, rows), broadcast_rows=0).orderBy("rank").collect():
        got.setdefault(x["query_id"], []).append(x["chunk_id"])
    assert len(got) == 1_500
    for q, _, v, k in rows[::97]:
        assert got[q] == [i for i, _ in brute_topk(ids, vecs, np.asarray(v, dtype=np.float32), k)]


def test_large_cells_are_split_by_all_their_rows(spark, monkeypatch):
    from .test_cells import numpy_cells

    monkeypatch.setattr(TR, "GROUP_VALUES", 200)
    monkeypatch.setattr(TR, "FIT_ROWS", 16)
    ids, vecs = clustered(700, 4, 1)
    ids, vecs = [*ids, *[f"w{i:03d}" for i in range(150)]], np.concatenate([vecs, np.repeat(vecs[:1], 150, axis=0)])     # many of one value
    blocks = TR.build_blocks(index_of(spark, {"a": (ids, vecs), "small": clustered(30, 4, 5)}).repartition(6), 8)
    got = {r["chunk_id"]: r["cell"] for r in TR.block_rows(blocks).filter("library_id = 'a'").collect()}
    assert got == numpy_cells(ids, vecs, 8)


def test_blocks_go_round_past_more_queries(spark, monkeypatch):
    from vellum.operators import rounds as RO

    ids, vecs = clustered(900, 6, 11)
    vecs[40:80] = vecs[40]          # equal scores
    vecs[7] = 0
    blocks = TR.build_blocks(index_of(spark, {"l": (ids, vecs), "m": clustered(60, 3, 12)}), 20)
    rows = [(f"q{j:04d}", "l", [float(x) for x in vecs[j % 900]], 1 + j % 12) for j in range(2_600)]
    rows += [("m1", "m", [1.0, 0.0, 0.0], 100), ("none", "n", [1.0], 3), ("other", "l", [1.0, 0.0], 3), ("gone", None, [1.0], 3)]

    def lists(frame):
        got = {}
        for x in frame.orderBy("rank").collect():
            got.setdefault((x["library_id"], x["query_id"]), []).append(x["chunk_id"])
        return got

    def spread(*a, **k):
        raise AssertionError("queries were sent to the blocks")

    with monkeypatch.context() as one:
        one.setattr(TR, "_candidates", spread)
        got = lists(TR.knn_tree(blocks, queries_of(spark, rows), broadcast_rows=0, broadcast_bytes=40_000))     # several parts
    assert len(got) == 2_601 and len(got["m", "m1"]) == 60
    for q, lib, v, k in [*rows[::53], *rows[40:44], rows[7]]:
        if lib == "l":
            assert got[lib, q] == [i for i, _ in brute_topk(ids, vecs, np.asarray(v, dtype=np.float32), k)], q
    # where the blocks are the larger side the queries go round
    monkeypatch.setattr(TR, "parts_of", lambda total, most: 1 << 30)
    monkeypatch.setattr(TR, "search_rounds", spread)
    assert lists(TR.knn_tree(blocks, queries_of(spark, rows[:2_600]), broadcast_rows=0)) == {k: v for k, v in got.items() if k[0] == "l"}
    assert RO.parts_of(None, 1) == 1


def test_float_products_lose_no_hit():
    from vellum.operators.rounds import Asked, unit_floats

    r = np.random.default_rng(5)
    v = (r.standard_normal((500, 24)) * 10.0 ** r.integers(-25, 25, (500, 1))).astype(np.float32)
    v[100:140], v[9] = v[100] * np.float32(2), 0
    ids = np.array([f"{i * 7919 % 500:03d}" for i in range(500)], object)
    inv = 1 / np.maximum(np.sqrt((v.astype(np.float64) ** 2).sum(1)), 1e-300) * (v != 0).any(1)
    q = Asked(np.arange(60), v[80:140].astype(np.float64), r.integers(1, 30, 60))
    for s in range(0, 500, 90):
        qi, ci, score = q.hits(np.arange(60), unit_floats(v[s:s + 90], inv[s:s + 90]), v[s:s + 90], inv[s:s + 90])
        q.keep(qi, ids[s:s + 90][ci], score)
    q.merge()
    exact = np.einsum("qd,nd->qn", v[80:140].astype(np.float64), v.astype(np.float64)) * inv * inv[80:140, None]
    for i in range(60):
        want = sorted(range(500), key=lambda n: (-round(exact[i, n], 12), ids[n]))[:q.k[i]]
        mine = [(x, y) for o, x, y in zip(*q.best) if o == i]
        assert sorted(x for x, _ in mine) == sorted(ids[n] for n in want), i
        assert np.allclose(sorted(y for _, y in mine), sorted(exact[i, want]), atol=1e-12)
