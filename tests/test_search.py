"""The reference's search service tests on FX1, plus filtering (FX10) and
degenerate vectors (FX11), which the reference does not test."""

from pyspark.sql import functions as F

from vellum.plans.index import build_index
from vellum.plans.search import search

from vellum.schema import QUERIES

from .helpers import FX1, corpus, queries


def _run(spark, qrows, chunks_rows=FX1, mode="strict"):
    libs, docs, chunks = corpus(spark, chunks_rows)
    b = build_index(chunks, libs, mode=mode)
    r = search(b.index, b.meta, chunks, queries(spark, qrows))
    hits = sorted((x["query_id"], x["rank"], x["chunk_id"], round(x["score"], 6)) for x in r.hits.collect())
    rej = sorted((x["query_id"], x["reason"]) for x in r.rejects.collect())
    return hits, rej


def test_fx1_scores_and_order(spark):
    hits, rej = _run(spark, [("a", "lib", [1, .1, .1], 3, None), ("b", "lib", [.1, 0, 1], 3, None),
                             ("c", "lib", [.9, .1, 0], 1, None)])
    assert rej == []
    a = [h for h in hits if h[0] == "a"]
    assert a == [("a", 1, "1", 0.990148), ("a", 2, "2", 0.099015), ("a", 3, "3", 0.099015)]  # tie by id
    b = [h for h in hits if h[0] == "b"]
    assert [h[2] for h in b] == ["3", "1", "2"] and b[0][3] == 0.995037 and b[2][3] == 0.0
    assert [h for h in hits if h[0] == "c"] == [("c", 1, "1", 0.993884)]


def test_fx1_rebuild_with_new_chunk(spark):
    rows = FX1 + [("4", "new", [.95, .05, 0], {})]
    hits, _ = _run(spark, [("c", "lib", [.9, .1, 0], 1, None)], rows)
    assert hits == [("c", 1, "4", 0.998314)]


def test_dimension_mismatch_and_not_indexed(spark):
    libs, docs, chunks = corpus(spark, FX1)
    b = build_index(chunks, libs)
    q = queries(spark, [("d", "lib", [1, 0, 0, 0, 0], 3, None), ("n", "nolib", [1, 0, 0], 3, None),
                        ("k0", "lib", [1, 0, 0], 0, None), ("k101", "lib", [1, 0, 0], 101, None),
                        ("kdef", "lib", [1, 0, 0], None, None)])
    r = search(b.index, b.meta, chunks, q)
    assert sorted((x["query_id"], x["reason"]) for x in r.rejects.collect()) == [
        ("d", "dimension_mismatch"), ("k0", "k_out_of_range"), ("k101", "k_out_of_range"), ("n", "not_indexed")]
    # default k is 5; the library has 3 chunks, so all 3 (k >= n returns everything)
    assert r.hits.filter("query_id = 'kdef'").count() == 3


def test_fx10_post_filter(spark):
    hits, _ = _run(spark, [("p1", "lib", [1, .1, .1], 3, {"page": "1"}), ("p2", "lib", [1, .1, .1], 1, {"page": "2"}),
                           ("miss", "lib", [1, .1, .1], 3, {"page": "1", "lang": "en"}),
                           ("none", "lib", [1, .1, .1], 3, {})])
    assert [h[2] for h in hits if h[0] == "p1"] == ["1"]
    assert [h for h in hits if h[0] == "p2"] == []          # filtered after the top-1 cut
    assert [h for h in hits if h[0] == "miss"] == []        # missing key never matches
    assert len([h for h in hits if h[0] == "none"]) == 3    # empty filter = no filter


def test_fx11_degenerate_vectors(spark):
    rows = FX1 + [("z", "zero", [0, 0, 0], {})]
    hits, _ = _run(spark, [("q", "lib", [1, 0, 0], 4, None), ("zq", "lib", [0, 0, 0], 2, None)], rows)
    assert ("q", 4, "z", 0.0) in hits or ("q", 3, "z", 0.0) in hits   # zero vector scores 0, no error
    assert all(h[3] == 0.0 for h in hits if h[0] == "zq")
    # an empty vector: strict build refuses the library and names the chunk
    rows = FX1 + [("e", "empty", [], {})]
    libs, docs, chunks = corpus(spark, rows)
    b = build_index(chunks, libs, mode="strict")
    rep = b.report.first()
    assert rep["status"] == "empty_embeddings" and rep["first_empty"] == "e" and b.meta.count() == 0
    lenient = build_index(chunks, libs, mode="lenient")
    assert lenient.meta.first()["n"] == 3 and lenient.index.count() == 3


def test_empty_library_gives_zero_hits(spark):
    libs, docs, chunks = corpus(spark, FX1)
    empty = chunks.limit(0)
    b = build_index(empty, libs)
    assert b.meta.first()["n"] == 0
    r = search(b.index, b.meta, empty, queries(spark, [("q", "lib", [1, 0, 0], 3, None)]))
    assert r.hits.count() == 0 and r.rejects.count() == 0
    nul = spark.createDataFrame([("qn", "lib", None, 3, None)], QUERIES)
    r = search(b.index, b.meta, empty, nul)
    assert [x["reason"] for x in r.rejects.collect()] == ["missing_embedding"] and r.hits.count() == 0


def test_stale_hits_vanish(spark):
    libs, docs, chunks = corpus(spark, FX1)
    b = build_index(chunks, libs)
    live = chunks.filter(F.col("chunk_id") != "1")
    r = search(b.index, b.meta, live, queries(spark, [("q", "lib", [1, .1, .1], 2, None)]))
    assert sorted(x["chunk_id"] for x in r.hits.collect()) == ["2"]


def test_search_library_single_request(spark):
    import pytest

    from vellum.plans.search import search_library
    libs, docs, chunks = corpus(spark, FX1)
    b = build_index(chunks, libs)
    r = search_library(b.index, b.meta, chunks, "lib", [1, .1, .1], k=3).orderBy("rank").collect()
    assert [(x["chunk_id"], round(x["score"], 6)) for x in r] == [("1", 0.990148), ("2", 0.099015), ("3", 0.099015)]
    r = search_library(b.index, b.meta, chunks, "lib", [1, .1, .1], k=3, metadata_filters={"page": "2"}).collect()
    assert [x["chunk_id"] for x in r] == ["2"]
    with pytest.raises(ValueError, match="dimension"):
        search_library(b.index, b.meta, chunks, "lib", [1, 0, 0, 0, 0], k=3)
    with pytest.raises(LookupError, match="not indexed"):
        search_library(b.index, b.meta, chunks, "other", [1, 0, 0], k=3)


def test_properties_post_filter_subset_and_split_is_partition(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(f"c{i:02d}", "t", rng.standard_normal(4).tolist(), {"g": str(i % 3)}) for i in range(30)]
    libs, docs, chunks = corpus(spark, rows)
    b = build_index(chunks, libs)
    qrows = [(f"q{j}", "lib" if j % 4 else "none", rng.standard_normal(4).tolist(),
              [0, 3, 7, 200][j % 4], {"g": str(j % 3)}) for j in range(12)]
    q = queries(spark, qrows)
    filtered = search(b.index, b.meta, chunks, q)
    unfiltered = search(b.index, b.meta, chunks, q.withColumn("filters", F.create_map().cast("map<string,string>")))
    f = {(r["query_id"], r["chunk_id"], r["rank"]) for r in filtered.hits.collect()}
    u = {(r["query_id"], r["chunk_id"], r["rank"]) for r in unfiltered.hits.collect()}
    assert f <= u                                                    # post-filter keeps a subset
    rejected = {r["query_id"] for r in filtered.rejects.collect()}
    answered_or_empty = {x[0] for x in qrows} - rejected
    assert rejected.isdisjoint({x[0] for x in u})                    # rejects never get hits
    assert len(rejected) + len(answered_or_empty) == len(qrows)       # rejects + accepted = input


def test_index_freshness_states(spark):
    from vellum.plans.index import index_freshness

    libs, docs, chunks = corpus(spark, FX1)
    b = build_index(chunks, libs)
    cur = (chunks.filter(F.col("chunk_id") != "1")                                   # deleted
           .withColumn("embedding", F.when(F.col("chunk_id") == "2", F.array(F.lit(5.0), F.lit(0.0), F.lit(0.0))
                                           .cast("array<float>")).otherwise(F.col("embedding"))))  # changed
    extra = corpus(spark, [("9", "new", [1, 1, 1], {})])[2]                            # not indexed
    got = {(r["chunk_id"], r["state"]) for r in index_freshness(b.index, cur.unionByName(extra)).collect()}
    assert got == {("1", "deleted"), ("2", "changed"), ("9", "not_indexed")}


def test_prefilter_versus_postfilter(spark):
    from vellum.plans.search import search_prefiltered

    libs, docs, chunks = corpus(spark, FX1)
    b = build_index(chunks, libs)
    q = queries(spark, [("q", "lib", [1, .1, .1], 1, None)])
    pre = search_prefiltered(b.index, b.meta, chunks, q, {"page": "2"}).hits.collect()
    assert [r["chunk_id"] for r in pre] == ["2"]          # filter first: still one hit
    post = search(b.index, b.meta, chunks, q.withColumn("filters", F.create_map(F.lit("page"), F.lit("2"))))
    assert post.hits.count() == 0                          # filter after the top-1 cut: none


def test_strict_failure_and_library_not_found(spark):
    import pytest

    from vellum.operators.quality import not_indexed, require_empty

    libs, docs, chunks = corpus(spark, FX1)
    b = build_index(chunks, libs)
    q = queries(spark, [("a", "lib", [1, 0, 0], 3, None), ("b", "ghost", [1, 0, 0], 3, None)])
    rej = not_indexed(q, b.meta, libs)
    assert [(r["query_id"], r["reason"]) for r in rej.collect()] == [("b", "library_not_found")]
    assert require_empty(rej.limit(0), "no rejects").first()["n"] == 0
    with pytest.raises(Exception, match="queries rejected"):
        require_empty(rej, "queries rejected").collect()       # fails on the executors


def test_rebuild_of_some_libraries_keeps_the_others(spark):
    """A build replaces the libraries it decided, removes what it refuses, and leaves the rest."""
    import uuid

    from vellum.plans.index import index_versions, read_index, write_index
    from vellum.sources.snapshot import scratch_root

    libs, docs, chunks = corpus(spark, FX1)
    root = scratch_root(spark, f"index-{uuid.uuid4().hex}")

    def named(name, rows):
        return rows.withColumn("library_id", F.lit(name))

    both = named("A", libs).unionByName(named("B", libs)).unionByName(named("C", libs))
    write_index(build_index(named("A", chunks).unionByName(named("B", chunks)).unionByName(named("C", chunks)), both), root)
    # A is rebuilt with one chunk, C is left with nothing to index
    one = named("A", chunks.filter("chunk_id = '1'"))
    write_index(build_index(one, named("A", libs).unionByName(named("C", libs)), mode="lenient"), root)
    index, meta = read_index(spark, root)
    n = {r["library_id"]: r["count"] for r in index.groupBy("library_id").count().collect()}
    assert n == {"A": 1, "B": chunks.count()}
    assert {r["library_id"]: r["n"] for r in meta.collect()} == n
    assert index_versions(spark, root) == [1, 2]
    old, _ = read_index(spark, root, version=1)
    assert old.count() == 3 * chunks.count()


def test_non_finite_and_repeated(spark):
    """Vectors that are no numbers and ids given twice are refused by name."""
    libs, docs, chunks = corpus(spark, FX1)
    bad = chunks.withColumn("embedding", F.when(F.col("chunk_id") == "1", F.array(F.lit(float("nan")), F.lit(0.0), F.lit(0.0))
                                                .cast("array<float>")).otherwise(F.col("embedding")))
    assert [r["status"] for r in build_index(bad, libs).report.collect()] == ["non_finite"]
    twice = chunks.unionByName(chunks.filter("chunk_id = '1'").withColumn("document_id", F.lit("other")))
    assert [r["status"] for r in build_index(twice, libs).report.collect()] == ["duplicate_ids"]
    hits, rej = _run(spark, [("n", "lib", [float("nan"), 0, 0], 1, None), ("t", "lib", [1, 0, 0], 1, None),
                             ("t", "lib", [0, 1, 0], 1, None), ("ok", "lib", [1, 0, 0], 1, None)])
    assert rej == [("n", "non_finite"), ("t", "duplicate_query"), ("t", "duplicate_query")]
    assert [h[0] for h in hits] == ["ok"]


def test_sql_search_with_text_and_filter(spark):
    """The SQL functions give the search's rows; wrong k and dimensions raise."""
    import pytest

    from vellum.functions.sql import register_search_function

    libs, docs, chunks = corpus(spark, FX1)
    build_index(chunks, libs).index.createOrReplaceTempView("t_index")
    chunks.createOrReplaceTempView("t_chunks")
    register_search_function(spark, "t_index", "t_search", "t_chunks")
    q = "array(1D, 0.1D, 0.1D)"
    got = spark.sql(f"SELECT rank, chunk_id, round(score, 6) AS s, text FROM t_search_text('lib', {q}, 3, NULL) ORDER BY rank").collect()
    assert [(r["rank"], r["chunk_id"], r["s"]) for r in got] == [(1, "1", 0.990148), (2, "2", 0.099015), (3, "3", 0.099015)]
    text = {r["chunk_id"]: r["text"] for r in chunks.collect()}
    assert all(r["text"] == text[r["chunk_id"]] for r in got)
    assert spark.sql(f"SELECT * FROM t_search_text('lib', {q}, 3, map('no such key', 'x'))").count() == 0
    for call in (f"t_search('lib', {q}, 101)", "t_search('lib', array(1D), 2)"):
        with pytest.raises(Exception, match="out of range|another dimension"):
            spark.sql(f"SELECT * FROM {call}").collect()
    plan = spark.sql(f"SELECT * FROM t_search('lib', {q}, 3)")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "TakeOrdered" in plan or "Limit" in plan
