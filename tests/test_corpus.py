"""Reshaping, snapshot I/O (FX9), distributed positions and embedding."""

import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import reshape as R
from vellum.operators.embed import HashingProvider, embed_and_insert, embed_column
from vellum.operators.mutate import Corpus3
from vellum.operators.rank import positions
from vellum.sources import snapshot as S
from vellum.sources import tables
from vellum.sources.synthetic import gaussian_vectors

from .conftest import SF


def test_flatten_renest_identity(spark):
    c = tables.corpus(spark, SF)
    nested = R.renest_libraries(c.libraries, c.documents, c.chunks)
    libs, docs, chunks = R.flatten(nested)
    a = sorted((r["library_id"], r["document_id"], r["chunk_id"], r["chunk_pos"], r["text"]) for r in chunks.collect())
    b = sorted((r["library_id"], r["document_id"], r["chunk_id"], r["chunk_pos"], r["text"]) for r in c.chunks.collect())
    assert a == b
    assert docs.count() == c.documents.count()    # documents without chunks survive


def test_reference_snapshot_import(spark, tmp_path):
    lib1, lib2 = str(uuid.UUID(int=1)), str(uuid.UUID(int=2))
    d1 = uuid.UUID(int=11).hex
    snap = {
        lib1: {"id": lib1.replace("-", ""), "metadata": {"name": "one"}, "documents": [
            {"id": d1, "metadata": {"t": "x"}, "chunks": [
                {"id": uuid.UUID(int=101).hex, "document_id": "wrong", "text": "a", "embedding": [1.0, 0.0]},
                {"id": uuid.UUID(int=102).hex, "document_id": d1, "text": "b", "embedding": [0.0, 1.0],
                 "metadata": {"p": "2"}}]},
            {"id": uuid.UUID(int=12).hex}]},
        lib2: {"id": lib2.replace("-", ""), "metadata": {}},
    }
    path = tmp_path / "db.json"
    path.write_text(json.dumps(snap, indent=2))
    libs, docs, chunks = S.read_reference_snapshot(spark, str(path))
    assert sorted(r["library_id"] for r in libs.collect()) == [lib1.replace("-", ""), lib2.replace("-", "")]
    assert [(r["document_id"], r["doc_pos"]) for r in docs.orderBy("doc_pos").collect()] == [
        (d1, 0), (uuid.UUID(int=12).hex, 1)]
    ch = chunks.orderBy("chunk_pos").collect()
    assert [r["document_id"] for r in ch] == [d1, d1]          # parent wins
    assert ch[0]["metadata"] == {} and ch[1]["metadata"] == {"p": "2"}


def test_versioned_snapshot_roundtrip(spark):
    c = tables.corpus(spark, SF)
    root = S.scratch_root(spark, f"t-{uuid.uuid4().hex}")
    S.write_snapshot(c.libraries, c.documents, c.chunks, root, 1)
    S.write_snapshot(c.libraries.limit(3), c.documents, c.chunks, root, 2)
    assert S.latest_version(spark, root).endswith("v000000000002")
    libs, docs, chunks = S.read_snapshot(spark, S.latest_version(spark, root))
    assert libs.count() == 3
    libs1, docs1, chunks1 = S.read_snapshot(spark, f"{root}/v000000000001")
    assert chunks1.count() == c.chunks.count() and docs1.count() == c.documents.count()


def test_positions_skewed_group(spark):
    # one group holds most rows; positions must still be dense 0..n-1 per group
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(
        (F.col("id") % 7).cast("string")).alias("g"), F.col("id"), (F.col("id") * 7919 % 5000).alias("v"))
    p = positions(df, ["v", "id"], ["g"], out="pos", num_partitions=16)
    got = p.groupBy("g").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"),
                             F.countDistinct("pos").alias("d")).collect()
    assert all(r["lo"] == 0 and r["hi"] == r["n"] - 1 and r["d"] == r["n"] for r in got)
    hot = [r["id"] for r in p.filter("g = 'hot'").orderBy("pos").select("id").collect()]
    want = [r["id"] for r in df.filter("g = 'hot'").orderBy("v", "id").collect()]
    assert hot == want


def test_hashing_provider_and_failures(spark):
    d = spark.createDataFrame([("1", "Hello hello world"), ("2", ""), ("3", None)], "id string, text string")
    out = {r["id"]: r["embedding"] for r in embed_column(d, "text").collect()}
    want = HashingProvider(64).embed(["Hello hello world"])[0]
    assert np.allclose(out["1"], want) and len(out["2"]) == 64 and not any(out["2"])

    class Broken:
        dim = 4

        def embed(self, texts):
            raise RuntimeError("service down")

    bad = {r["id"]: r["embedding"] for r in embed_column(d, "text", factory=Broken).collect()}
    assert all(v == [] for v in bad.values())            # a failed batch gives empty vectors


def test_embed_and_insert(spark):
    c = tables.corpus(spark, SF)
    new = spark.createDataFrame([("src0", "0", "n1", "new text", {}, 0), ("src0", "nodoc", "n2", "x", {}, 0)],
                                "library_id string, document_id string, chunk_id string, text string, "
                                "metadata map<string,string>, seq int")
    out, rej = embed_and_insert(Corpus3(c.libraries, c.documents, c.chunks), new)
    row = out.chunks.filter("chunk_id = 'n1'").first()
    assert row["chunk_pos"] == 4 and len(row["embedding"]) == 64
    assert [r["reason"] for r in rej.collect()] == ["not_found:Document"]


def test_gaussian_source_is_partitioning_independent(spark):
    a = {r["id"]: r["embedding"] for r in gaussian_vectors(spark, 50, 8, seed=3, num_partitions=1).collect()}
    b = {r["id"]: r["embedding"] for r in gaussian_vectors(spark, 50, 8, seed=3, num_partitions=7).collect()}
    assert a == b
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in a.values())


def test_snapshot_keeps_chunks_without_a_document(spark):
    c = tables.corpus(spark, SF)
    lost = c.chunks.limit(3).withColumn("document_id", F.lit("no such document")).checkpoint()
    root = S.scratch_root(spark, f"t-{uuid.uuid4().hex}")
    S.write_snapshot(c.libraries, c.documents, c.chunks.unionByName(lost), root, 1)
    _, _, chunks = S.read_snapshot(spark, S.latest_version(spark, root))
    assert chunks.count() == c.chunks.count() + 3
    assert chunks.filter("document_id = 'no such document'").count() == 3


def test_snapshot_version_rewrite_is_idempotent(spark):
    c = tables.corpus(spark, SF)
    root = S.scratch_root(spark, f"t-{uuid.uuid4().hex}")
    S.write_snapshot(c.libraries, c.documents, c.chunks, root, 3)
    S.write_snapshot(c.libraries, c.documents, c.chunks, root, 3)          # a retried write
    assert S.versions(spark, root) == [3]
    libs, docs, chunks = S.read_snapshot(spark, S.latest_version(spark, root))
    assert chunks.count() == c.chunks.count()
    assert S.latest_version(spark, root, before=3) is None


def test_embed_and_insert_without_generation(spark):
    c = tables.corpus(spark, SF)
    new = spark.createDataFrame([("src0", "0", "n1", "text", {}, 0)],
                                "library_id string, document_id string, chunk_id string, text string, "
                                "metadata map<string,string>, seq int")
    out, rej = embed_and_insert(Corpus3(c.libraries, c.documents, c.chunks), new, generate=False)
    row = out.chunks.filter("chunk_id = 'n1'").first()
    assert row["embedding"] == [] and rej.count() == 0     # flag off: added with an empty vector


def test_provider_memory_does_not_grow_with_the_words(spark):
    p = HashingProvider()
    p.embed([" ".join(f"w{i}" for i in range(s, s + 10_000)) for s in range(0, 100_000, 10_000)])
    assert len(p._memo) <= 1 << 16
    d = spark.createDataFrame([(i, None if i == 1 else f"w{i}") for i in range(5)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in embed_column(d, "text", batch_size=2).collect()}
    assert {i: len(v) for i, v in got.items()} == dict.fromkeys(range(5), 64) and sum(got[1]) == 0 and sum(got[2]) == 1
