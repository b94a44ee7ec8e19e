"""Predicates as data against a Python evaluation; file skipping; pre-filtered search against brute force."""

import math
import random
import re
import uuid

import numpy as np
from pyspark.sql import functions as F

from vellum.functions import predicates as P
from vellum.plans import where
from vellum.sources.snapshot import scratch_root


def number(md, key):
    try:
        v = float(md.get(key, ""))
        return None if math.isnan(v) else v
    except (TypeError, ValueError):
        return None


def holds(tree, md):
    out = []
    for n in tree:
        v, kind = number(md, n["key"]) if n["key"] else None, n["kind"]
        if kind == "eq":
            r = md.get(n["key"]) is not None and md.get(n["key"]) == n["text"]
        elif kind == "regex":
            r = md.get(n["key"]) is not None and re.search(n["text"], md[n["key"]]) is not None
        elif kind == "range":
            r = v is not None and (n["low"] is None or v >= n["low"]) and (n["high"] is None or v <= n["high"])
        elif kind == "near":
            lon = number(md, n["text"])
            r = False
            if v is not None and lon is not None:
                a, b = math.radians(n["lat"]), math.radians(v)
                h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon - n["lon"]) / 2) ** 2
                r = 2 * P.EARTH_KM * math.asin(min(1.0, math.sqrt(h))) <= n["km"]
        else:
            some = [out[i] for i in n["of"]]
            r = all(some) if kind == "and" else any(some) if kind == "or" else not some[0]
        out.append(r)
    return out[-1] if out else True


def random_tree(r, depth=3):
    if depth == 0 or r.random() < 0.3:
        return r.choice([P.eq("lang", r.choice(["en", "de", ""])), P.regex("lang", r.choice(["^e", "n$", "[dx]"])),
                         P.between("size", r.choice([None, 3, 20.5]), r.choice([None, 10, 50])), P.near("lat", "lon", r.uniform(-80, 80), r.uniform(-170, 170), r.uniform(100, 9000))])
    return r.choice([P.all_of, P.any_of, P.none_of])(*[random_tree(r, depth - 1) for _ in range(r.randint(1, 3))])


def metadata(r):
    md = {"lang": r.choice(["en", "de", "xn", ""]), "size": r.choice([str(r.randint(0, 60)), "many", "NaN", "1e1"]), "lat": str(r.uniform(-90, 90)), "lon": str(r.uniform(-180, 180))}
    return {k: v for k, v in md.items() if r.random() < 0.85}


def test_predicates_equal_python(spark):
    r = random.Random(3)
    rows = [(i, metadata(r), random_tree(r)) for i in range(400)] + [(400, {}, []), (401, None, []), (402, {"size": None}, P.between("size"))]
    schema = f"id int, metadata map<string,string>, predicate {P.PREDICATE}"
    df = spark.createDataFrame([(i, m, [tuple(n[f] for f in P.FIELDS) for n in t]) for i, m, t in rows], schema)
    got = {x["id"]: x["ok"] for x in df.select("id", P.matches(F.col("metadata"), F.col("predicate")).alias("ok")).collect()}
    assert got == {i: holds(t, m or {}) for i, m, t in rows}
    assert {True, False} == set(got.values())
    one = df.limit(1)
    for _, m, t in rows[:25]:
        assert one.select(P.matches(F.lit(None).cast("map<string,string>") if m is None else F.from_json(F.lit(__import__("json").dumps(m)), "map<string,string>"),
                                    P.literal(t)).alias("x")).first()["x"] == holds(t, m or {})


def test_files_are_skipped_but_never_wrongly(spark):
    r = random.Random(4)
    data = [("l", f"c{i}", [1.0, float(i)], 1.0, metadata(r)) for i in range(600)]
    df = spark.createDataFrame(data, "library_id string, chunk_id string, vector array<float>, inv_norm double, metadata map<string,string>")
    root = scratch_root(spark, f"test-where-{uuid.uuid4().hex}")
    where.write_filterable(df, root, ["size", "lat"], "size", file_rows=60)
    every = len(where.read_filterable(spark, root).inputFiles())
    assert every >= 8
    fewer = 0
    for _ in range(25):
        tree = random_tree(r)
        some = where.read_filterable(spark, root, [tree])
        fewer += len(some.inputFiles()) < every
        assert {x["chunk_id"] for x in some.collect()} >= {c for _, c, _, _, m in data if holds(tree, m)}
    assert len(where.read_filterable(spark, root, [P.between("size", 55, 60)]).inputFiles()) <= 3 and fewer > 2
    assert where.read_filterable(spark, root, []).count() == 0


def test_search_before_equals_brute_force(spark, monkeypatch):
    r, g = random.Random(5), np.random.default_rng(5)
    v = g.standard_normal((300, 6)).astype(np.float32)
    data = [(("a", "b")[i % 3 == 0], f"c{i:03d}", v[i], metadata(r)) for i in range(300)]
    rows = spark.createDataFrame([(lib, c, [float(x) for x in x_], float(1 / np.linalg.norm(x_.astype(float))), m) for lib, c, x_, m in data],
                                 "library_id string, chunk_id string, vector array<float>, inv_norm double, metadata map<string,string>").repartition(4)
    trees = [random_tree(r) for _ in range(12)] + [[]]
    asked = [(f"q{j}", r.choice(["a", "b", "none"]), g.standard_normal(6).astype(np.float32), r.randint(1, 12), r.choice(trees)) for j in range(40)]
    q = spark.createDataFrame([(i, lib, [float(x) for x in e], k, [tuple(n[f] for f in P.FIELDS) for n in t]) for i, lib, e, k, t in asked],
                              f"query_id string, library_id string, embedding array<float>, k int, predicate {P.PREDICATE}")
    want = {}
    for i, lib, e, k, t in asked:
        e = e.astype(float)
        scored = sorted((-float(x.astype(float) @ e / np.linalg.norm(x.astype(float)) / np.linalg.norm(e)), c) for ml, c, x, m in data if ml == lib and holds(t, m))
        if scored:
            want[i] = [c for _, c in scored[:k]]
    for limit in (256, 2):
        monkeypatch.setattr(where, "PASS_PREDICATES", limit)
        got = {}
        for x in where.knn_where(rows, q).orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append(x["chunk_id"])
        assert got == want


def test_queries_are_made_once_and_tasks_do_not_grow_with_the_rows(spark, monkeypatch):
    made, tasks, real = spark.sparkContext.accumulator(0), [], where.merge_topk

    def watched(cands, *more):
        tasks.append(cands.rdd.getNumPartitions())
        return real(cands, *more)

    @F.udf("string")
    def counted(x):
        made.add(1)
        return x

    monkeypatch.setattr(where, "merge_topk", watched)
    monkeypatch.setattr(where, "PASS_QUERIES", 10)
    rows = spark.createDataFrame([("l", f"c{i:02d}", [1.0, float(i)], 1.0, {"n": str(i)}) for i in range(40)],
                                 "library_id string, chunk_id string, vector array<float>, inv_norm double, metadata map<string,string>").repartition(40)
    q = spark.createDataFrame([(f"q{i:02d}", "l", [1.0, 0.0]) for i in range(30)], "query_id string, library_id string, embedding array<float>")
    q = q.select(counted("query_id").alias("query_id"), "library_id", "embedding", P.literal(P.between("n", 5)).alias("predicate"))
    hits = where.knn_where(rows, q, k=2).collect()
    assert len(hits) == 60 and made.value == 30
    assert len(tasks) >= 3 and max(tasks) <= spark.sparkContext.defaultParallelism
