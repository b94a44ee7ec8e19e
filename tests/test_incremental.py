"""The index kept by bucket digests: freshness equals the full comparison, fresh buckets are not opened,
a refresh writes what changed."""

import uuid

from pyspark.sql import functions as F

from vellum.plans import incremental as I
from vellum.plans.index import build_index, index_freshness
from vellum.schema import CHUNKS
from vellum.sources.snapshot import scratch_root


def corpus(spark, n=120, libs=("a", "b/=x", "c")):
    rows = [(lib, f"d{i % 7}", f"c{i:03d}", i, f"t{i}", [float(i), float(len(lib)), 1.0], {}) for lib in libs for i in range(n)]
    return spark.createDataFrame(rows, CHUNKS)


def libraries(spark, libs=("a", "b/=x", "c", "new")):
    return spark.createDataFrame([(x, {}) for x in libs], "library_id string, metadata map<string,string>")


def rows(df):
    return sorted((r["library_id"], r["chunk_id"], tuple(r["vector"])) for r in df.collect())


def changed(chunks):
    """One vector changed, one chunk deleted and one added in library a; a new library."""
    a = chunks.withColumn("embedding", F.when((F.col("library_id") == "a") & (F.col("chunk_id") == "c005"), F.reverse("embedding")).otherwise(F.col("embedding")))
    a = a.filter("NOT (library_id = 'a' AND chunk_id = 'c010')")
    more = chunks.filter("library_id = 'a' AND chunk_id = 'c011'").withColumn("chunk_id", F.lit("c999"))
    new = chunks.filter("library_id = 'c' AND chunk_id < 'c020'").withColumn("library_id", F.lit("new"))
    return a.unionByName(more).unionByName(new)


def test_freshness_and_refresh(spark, monkeypatch):
    chunks = corpus(spark)
    build = build_index(chunks, libraries(spark))
    root = scratch_root(spark, f"test-inc-{uuid.uuid4().hex}")
    I.publish(build, root, bucket_rows=20)
    assert I.freshness(spark, root, chunks).count() == 0
    assert I.refresh(spark, root, chunks, libraries(spark))[0] is None
    now = changed(chunks)
    want = sorted(map(tuple, index_freshness(build.index, now).collect()))
    got = I.freshness(spark, root, now)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 23
    opened = {f.split("/rows/")[1].rsplit("/", 1)[0] for f in got.inputFiles() if "/rows/" in f}
    assert 1 <= len(opened) <= 3 and all("library_id=a" in f for f in opened)       # of 18 buckets in three libraries
    monkeypatch.setattr(I, "NAMED_BUCKETS", 0)
    monkeypatch.setattr(I, "BROADCAST_BUCKETS", 0)
    assert sorted(map(tuple, I.freshness(spark, root, now).collect())) == want
    monkeypatch.undo()
    before = {r["library_id"] + str(r["bucket"]): r["version"] for r in I._lines(spark, root).collect()}
    version, report = I.refresh(spark, root, now, libraries(spark))
    assert {r["library_id"] for r in report.collect()} == {"a", "new"}
    index, meta = I.read(spark, root)
    assert rows(index) == rows(build_index(now, libraries(spark), mode="lenient").index)
    assert {r["library_id"]: r["n"] for r in meta.collect()} == {"a": 120, "b/=x": 120, "c": 120, "new": 20}
    after = {r["library_id"] + str(r["bucket"]): r["version"] for r in I._lines(spark, root).collect()}
    assert sum(after[k] == version for k in before) <= 3 and sum(v == version for v in after.values()) <= 4
    assert I.freshness(spark, root, now).count() == 0
    assert rows(I.read(spark, root, 1)[0]) == rows(build.index)                     # the older version is still there


def test_refused_gone_and_outgrown_libraries(spark):
    chunks = corpus(spark, 40)
    root = scratch_root(spark, f"test-inc-{uuid.uuid4().hex}")
    I.publish(build_index(chunks, libraries(spark)), root, bucket_rows=20)
    bad = chunks.withColumn("embedding", F.when((F.col("library_id") == "a") & (F.col("chunk_id") == "c001"), F.slice("embedding", 1, 2)).otherwise(F.col("embedding")))
    bad = bad.filter("library_id != 'c'")                                            # c is deleted
    many = chunks.filter("library_id = 'b/=x'").select(*[c for c in chunks.columns if c != "chunk_id"], F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat("chunk_id", F.lit("-"), i.cast("string")))).alias("chunk_id")).select(*chunks.columns)
    now = bad.unionByName(many)
    version, report = I.refresh(spark, root, now, libraries(spark))
    assert {r["library_id"]: r["status"] for r in report.collect()} == {"a": "inconsistent_dimensions", "b/=x": "indexed", "c": "nothing_to_index"}
    index, meta = I.read(spark, root)
    assert rows(index) == rows(build_index(now, libraries(spark), mode="lenient").index)
    assert {r["library_id"]: r["n"] for r in meta.collect()} == {"b/=x": 400, "new": 0}
    lines = I._lines(spark, root).collect()
    assert {r["n_buckets"] for r in lines} == {20} and len(lines) == 20              # dealt anew
