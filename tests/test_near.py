"""Compressed vectors give the exact answer; hyperplane tables reach the recall; the data source publishes whole writes only."""

import os
import uuid

import numpy as np
import pytest
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from vellum.operators import codes as CO
from vellum.operators import graph as G
from vellum.operators import lsh as L
from vellum.operators.knn import knn_join
from vellum.sources import datasource
from vellum.sources.snapshot import scratch_root

from .helpers import brute_topk
from .test_tree import clustered, index_of, libraries, queries_of


class Pair(AccumulatorParam):
    def zero(self, value):
        return np.zeros_like(value)

    def addInPlace(self, a, b):
        return a + b


def asked(libs, seed=0, k=(1, 7, 25)):
    r = np.random.default_rng(seed)
    rows = [(f"q{j}", lib, [float(x) for x in r.standard_normal(len(vecs[0]))], k[j % len(k)]) for lib, (_, vecs) in libs.items() for j in range(6)]
    rows += [(f"own{j}", lib, [float(x) for x in vecs[j]], 5) for lib, (_, vecs) in libs.items() for j in range(0, len(vecs), max(1, len(vecs) // 4))]
    return rows


def found(hits):
    got = {}
    for x in hits.orderBy("rank").collect():
        got.setdefault((x["library_id"], x["query_id"]), []).append(x["chunk_id"])
    return got


@pytest.mark.parametrize("broadcast_pairs", [200_000, 0])
def test_codes_are_exact(spark, monkeypatch, broadcast_pairs):
    monkeypatch.setattr(CO, "BROADCAST_PAIRS", broadcast_pairs)
    libs = libraries()
    index = index_of(spark, libs).repartition(5)
    rows = [*asked(libs), ("zero", "a", [0.0] * 4, 3)]
    got = found(CO.knn_codes(CO.compress(index), index, queries_of(spark, rows)))
    want = found(knn_join(index, queries_of(spark, rows)))
    assert got == want
    for q, lib, v, k in rows:
        ids, vecs = libs[lib]
        assert got[lib, q] == [i for i, _ in brute_topk(ids, vecs, np.asarray(v, dtype=np.float32), k)]
    assert found(CO.knn_codes(CO.compress(index), index, queries_of(spark, rows), broadcast_rows=0)) == want


def test_codes_take_a_quarter_of_the_bytes(spark):
    r = np.random.default_rng(1)
    index = index_of(spark, {"l": ([f"v{i}" for i in range(3000)], r.standard_normal((3000, 64)).astype(np.float32))}).coalesce(1)
    root = scratch_root(spark, f"test-codes-{uuid.uuid4().hex}").removeprefix("file:")
    index.select("library_id", "chunk_id", "vector", "inv_norm").write.parquet(f"{root}/floats")
    CO.compress(index).write.parquet(f"{root}/codes")
    size = {n: sum(os.path.getsize(f"{root}/{n}/{f}") for f in os.listdir(f"{root}/{n}")) for n in ("floats", "codes")}
    assert size["codes"] < 0.4 * size["floats"]
    few = CO._scan(CO.compress(index), {"l": (np.array(["q"], object), np.eye(1, 64), np.array([10]))}).count()
    assert 10 <= few < 300


def test_probe_order_is_by_distance():
    r = np.random.default_rng(2)
    for bits in (1, 3, 6):
        d = r.standard_normal(bits)
        cost = {m: sum(d[i] ** 2 for i in range(bits) if m >> i & 1) for m in range(1 << bits)}
        got = L.probe_order(d, 1 << bits)
        assert sorted(got) == list(range(1 << bits)) and np.allclose([cost[m] for m in got], sorted(cost.values()))


def test_lsh_recall_and_share(spark):
    ids, v = clustered(3000, 24, 7, spread=0.35)
    libs = {"lib": (ids, v)}
    index = index_of(spark, libs).repartition(4)
    rows = [(f"q{j}", "lib", [float(x) for x in v[j * 37] + 0.05], 10) for j in range(40)]
    scored = spark.sparkContext.accumulator(np.zeros(2, np.int64), Pair())
    got = found(L.knn_lsh(L.sign(index), queries_of(spark, rows), scored=scored))
    hits = sum(len(set(got["lib", q]) & {i for i, _ in brute_topk(ids, v, np.asarray(e, dtype=np.float32), k)}) for q, _, e, k in rows)
    assert hits >= 0.9 * 400
    assert scored.value[0] < 0.5 * scored.value[1] and scored.value[1] == 40 * 3000
    # every bucket looked at: the exact answer, hot buckets and zero vectors included
    libs = libraries()
    index = index_of(spark, libs)
    rows = asked(libs)
    assert found(L.knn_lsh(L.sign(index, 2, 3), queries_of(spark, rows), tables=2, bits=3, probes=8)) == found(knn_join(index, queries_of(spark, rows)))


def test_graph_recall(spark):
    ids, v = clustered(600, 16, 8, spread=0.4)
    libs = {"lib": (ids, v), "small": clustered(5, 4, 9), "one": (["x"], np.ones((1, 4), np.float32))}
    index = index_of(spark, libs).repartition(4).checkpoint()
    graph = G.build_graph(index, degree=12)
    assert graph.groupBy("library_id", "node").count().agg(F.max("count")).first()[0] <= 12
    rows = [(f"q{j}", "lib", [float(x) for x in v[j * 17] + 0.05], 10) for j in range(30)] + [("s", "small", [1.0, 0.0, 0.0, 0.0], 9), ("o", "one", [1.0, 0.0, 0.0, 0.0], 2)]
    got = found(G.knn_graph(graph, index, queries_of(spark, rows)))
    hits = sum(len(set(got["lib", q]) & {i for i, _ in brute_topk(ids, v, np.asarray(e, dtype=np.float32), k)}) for q, lib, e, k in rows if lib == "lib")
    assert hits >= 0.9 * 300
    assert len(got["small", "s"]) == 5 and got["one", "o"] == ["x"]


def test_data_source(spark):
    datasource.register(spark)
    root = scratch_root(spark, f"test-source-{uuid.uuid4().hex}")
    rows = spark.range(1000).select("id", F.array(F.col("id").cast("float"), F.lit(1.5).cast("float")).alias("v"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("m"),
                                    F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), "id")).alias("t"))
    rows.repartition(4).write.format("vellum").mode("append").save(root)
    back = lambda v=None: (spark.read.format("vellum").option("version", v) if v else spark.read.format("vellum")).load(root)
    assert back().schema == rows.schema and sorted(map(str, back().collect())) == sorted(map(str, rows.collect()))
    rows.filter("id < 10").write.format("vellum").mode("append").save(root)
    assert back().count() == 1010 and back(1).count() == 1000
    rows.filter("id < 5").write.format("vellum").mode("overwrite").save(root)
    assert back().count() == 5 and datasource.manifests(root) == [1, 2, 3]
    folders = {n for n in os.listdir(root.removeprefix("file:")) if n.startswith("v-")}
    broken = rows.select(F.when(F.col("id") == 700, F.raise_error(F.lit("task failed"))).otherwise(F.col("id")).cast("long").alias("id"), "v", "m", "t")
    with pytest.raises(Exception, match="task failed"):
        broken.repartition(4, "id").write.format("vellum").mode("append").save(root)
    assert back().count() == 5 and datasource.manifests(root) == [1, 2, 3]
    assert {n for n in os.listdir(root.removeprefix("file:")) if n.startswith("v-")} == folders      # what the other tasks wrote is gone
    with pytest.raises(Exception, match="schema"):
        rows.select("id").write.format("vellum").mode("append").save(root)
    rows.limit(0).write.format("vellum").mode("overwrite").save(root)
    assert back().count() == 0


def test_graph_hands_on_only_what_reaches_the_floor():
    import pyarrow as pa

    v = np.array([[1, 0], [0.8, 0.6], [0, 1]], dtype=np.float32)
    run = pa.RecordBatch.from_arrays([pa.array(["l"] * 3), pa.array(["hub"] * 3), pa.array(["a", "b", "c"]), pa.array(list(v), pa.list_(pa.float32())),
                                      pa.array([1.0] * 3), pa.array([0.7, -np.inf, 0.9])], ["library_id", "hub", "chunk_id", "vector", "inv_norm", "floor"])
    [met] = G._meet("hub", 2)([run])
    assert sorted(zip(met["node"].to_pylist(), met["neighbour"].to_pylist())) == [("a", "b"), ("b", "a"), ("b", "c")]
    near = [[{"_id": i, "vector": x, "inv_norm": 1.0} for i, x in zip("abc", v.tolist())], [{"_id": "d", "vector": [1.0, 0.0, 0.0], "inv_norm": 1.0}]]
    kind = pa.list_(pa.struct([("_id", pa.string()), ("vector", pa.list_(pa.float32())), ("inv_norm", pa.float64())]))
    asked = pa.RecordBatch.from_arrays([pa.array(["l", "m"]), pa.array(["q", "r"]), pa.array([[1.0, 0.0], [0.0, 1.0]], pa.list_(pa.float32())), pa.array([1.0, 1.0]),
                                        pa.array([0.75, -np.inf]), pa.array(near, kind)], ["library_id", "query_id", "embedding", "_q_inv", "floor", "near"])
    [found] = G._scores([asked])        # vectors of another dimension are not compared
    assert found["query_id"].to_pylist() == ["q", "q"] and found["chunk_id"].to_pylist() == ["a", "b"]
    assert np.allclose(found["score"].to_pylist(), [1.0, 0.8])


def test_graph_search_reads_a_node_once_a_round(spark, monkeypatch):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("_id", pa.string()), ("vector", pa.list_(pa.float32())), ("inv_norm", pa.float64())]))
    one = lambda *ids: [{"_id": i, "vector": [float(i == "a"), float(i != "a")], "inv_norm": 1.0} for i in ids]
    rows = [("l", "x", one("a", "b"), None), ("l", "x", None, "q1"), ("l", "x", None, "q2"), ("l", "y", None, "q3"), ("m", "x", None, "q4"), ("m", "z", one("c"), None), ("m", "z", None, "q5")]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], kind), pa.array([r[3] for r in rows]),
         pa.array([None if r[3] is None else [1.0, 0.5] for r in rows], pa.list_(pa.float32())), pa.array([None if r[3] is None else 1.0 for r in rows]),
         pa.array([None if r[3] is None else -9.0 for r in rows])], ["library_id", "chunk_id", "near", "query_id", "embedding", "_q_inv", "floor"])
    want = {("q1", "a"), ("q1", "b"), ("q2", "a"), ("q2", "b"), ("q5", "c")}       # y has no neighbours, m's x neither
    for size in (7, 3, 2, 1):       # a node's queries may come in later batches
        got = [(q, c) for f in G._at_nodes(batch.slice(s, size) for s in range(0, 7, size)) for q, c in zip(f["query_id"].to_pylist(), f["chunk_id"].to_pylist())]
        assert sorted(got) == sorted(want), size
    # rows with neighbours that are scored: every asked node of a round once, not once a query
    seen = spark.sparkContext.accumulator(np.zeros(2, np.int64), Pair())
    plain = G._at_nodes

    def counted(batches):
        held = []
        for b in batches:
            held.append(b)
            seen.add(np.array([b.num_rows - b.column("near").null_count, b.column("near").null_count]))
        yield from plain(held)

    monkeypatch.setattr(G, "_at_nodes", counted)
    ids, v = clustered(300, 8, 3)
    index = index_of(spark, {"lib": (ids, v), "one": (["x"], np.ones((1, 4), np.float32))}).checkpoint()
    queries = [(f"q{j}", "lib", [float(x) for x in v[j]], 5) for j in range(300)] + [("o", "one", [1.0] * 4, 2)]
    got = found(G.knn_graph(G.build_graph(index, degree=8), index, queries_of(spark, queries)))
    assert got["one", "o"] == ["x"] and len(got) == 301
    assert seen.value[0] * 3 < seen.value[1]
