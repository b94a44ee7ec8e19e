"""Keyed mutation (FX5, FX6, FX8 and ordering rules)."""

from pyspark.sql import functions as F

from vellum.operators import mutate as M
from vellum.operators.mutate import Corpus3
from vellum.schema import CHUNKS, DOCUMENTS, LIBRARIES
from vellum.sources import tables

from .conftest import SF


def _vec(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id string, vector array<float>")


def _map(df, key="id", val="vector"):
    return {r[key]: r[val] for r in df.collect()}


def test_fx6_duplicates_and_overwrite(spark):
    stored = _vec(spark, [("vec1", [1, 0, 0])])
    r = M.upsert_vectors(stored, _vec(spark, [("vec1", [0, 1, 0])]), ["id"], overwrite=False)
    assert _map(r.table) == {"vec1": [1.0, 0.0, 0.0]}
    assert [x["reason"] for x in r.rejects.collect()] == ["duplicate_id"]
    r = M.upsert_vectors(stored, _vec(spark, [("vec1", [0, 1, 0])]), ["id"], overwrite=True)
    assert _map(r.table) == {"vec1": [0.0, 1.0, 0.0]}
    # the same key twice in one batch without an order is refused
    r = M.upsert_vectors(stored, _vec(spark, [("v2", [1, 1, 1]), ("v2", [2, 2, 2])]), ["id"], overwrite=True)
    assert _map(r.table) == {"vec1": [1.0, 0.0, 0.0]} and r.rejects.count() == 2


def test_upsert_is_idempotent(spark):
    stored = _vec(spark, [("a", [1, 0]), ("b", [0, 1])])
    new = _vec(spark, [("b", [1, 1]), ("c", [2, 2])])
    once = M.upsert_vectors(stored, new, ["id"], True).table
    twice = M.upsert_vectors(once, new, ["id"], True).table
    assert _map(once) == _map(twice)


def test_fx5_removal(spark):
    stored = _vec(spark, [("x", [1, 0, 0]), ("y", [0, 1, 0]), ("z", [0, 0, 1])])
    ids = spark.createDataFrame([("y",), ("nope",)], "id string")
    t, flags = M.remove_keys(stored, ids, ["id"])
    assert sorted(_map(t)) == ["x", "z"]
    assert _map(flags, "id", "found") == {"y": True, "nope": False}


def test_append_unseen_keeps_stored(spark):
    stored = _vec(spark, [("a", [1, 0])])
    out = M.append_unseen(stored, _vec(spark, [("a", [9, 9]), ("b", [0, 1])]), ["id"])
    assert _map(out) == {"a": [1.0, 0.0], "b": [0.0, 1.0]}


def _corpus(spark):
    libs = spark.createDataFrame([("L", {"name": "Lib"})], LIBRARIES)
    docs = spark.createDataFrame([("L", "d1", 0, {"t": "1"}), ("L", "d2", 1, {"t": "2"})], DOCUMENTS)
    chunks = spark.createDataFrame([("L", "d1", "c1", 0, "a", [1.0], {}), ("L", "d1", "c2", 1, "b", [2.0], {}),
                                    ("L", "d2", "c3", 0, "c", [3.0], {})], CHUNKS)
    return M.Corpus3(libs, docs, chunks)


def test_fx8_library_crud(spark):
    c = _corpus(spark)
    patched = M.patch_libraries(c.libraries, spark.createDataFrame([("L", None)], "library_id string, metadata map<string,string>"))
    assert patched.first()["metadata"] == {"name": "Lib"}          # NULL keeps the stored field
    patched = M.patch_libraries(c.libraries, spark.createDataFrame([("L", {"name": "Updated Library"})],
                                                                   "library_id string, metadata map<string,string>"))
    assert patched.first()["metadata"] == {"name": "Updated Library"}
    out, idx, _ = M.delete_libraries(c, spark.createDataFrame([("L",)], "library_id string"))
    assert out.libraries.count() == 0 and out.documents.count() == 0 and out.chunks.count() == 0
    new = M.Corpus3(spark.createDataFrame([("X", {})], LIBRARIES), c.documents.limit(0), c.chunks.limit(0))
    _, missing = M.replace_libraries_if_present(c, new)
    assert [(r["resource_type"], r["resource_id"]) for r in missing.collect()] == [("Library", "X")]


def test_add_document_moves_to_end_and_replaces_chunks(spark):
    c = _corpus(spark)
    inc = spark.createDataFrame([("L", "d1", {"t": "new"}, 0), ("L", "d9", {}, 1), ("Q", "dq", {}, 0)],
                                "library_id string, document_id string, metadata map<string,string>, seq int")
    out, bad = M.add_documents(c, inc)
    pos = {r["document_id"]: r["doc_pos"] for r in out.documents.collect()}
    assert pos == {"d2": 1, "d1": 2, "d9": 3}
    assert sorted(r["chunk_id"] for r in out.chunks.collect()) == ["c3"]   # d1 replaced without chunks
    assert [(r["resource_type"], r["resource_id"]) for r in bad.collect()] == [("Library", "Q")]


def test_chunk_add_update_delete(spark):
    c = _corpus(spark)
    inc = spark.createDataFrame([("L", "d1", "c1", "A", [5.0], {}, 0), ("L", "d1", "c9", "Z", [9.0], {}, 1)],
                                "library_id string, document_id string, chunk_id string, text string, "
                                "embedding array<float>, metadata map<string,string>, seq int")
    out, _ = M.add_chunks(c, inc)
    got = {r["chunk_id"]: (r["chunk_pos"], r["text"]) for r in out.chunks.filter("document_id = 'd1'").collect()}
    assert got == {"c2": (1, "b"), "c1": (2, "A"), "c9": (3, "Z")}
    upd = inc.filter("chunk_id = 'c1'").drop("seq").withColumn("text", F.lit("upd"))
    out2, bad = M.update_chunks(c, upd)
    r = out2.chunks.filter("chunk_id = 'c1'").first()
    assert (r["chunk_pos"], r["text"], r["embedding"]) == (0, "upd", [5.0]) and bad.count() == 0
    out3, bad = M.delete_chunks(c, spark.createDataFrame([("L", "d1", "c2"), ("L", "d1", "nope")],
                                                         "library_id string, document_id string, chunk_id string"))
    assert sorted(r["chunk_id"] for r in out3.chunks.collect()) == ["c1", "c3"]
    assert [r["resource_id"] for r in bad.collect()] == ["nope"]


def test_change_feed_tombstones(spark):
    """A delete followed (in a later batch) by an older upsert stays deleted."""
    schema = "k string, ts long, seq long, v string, op string"
    b1 = spark.createDataFrame([("a", 1, 1, "x", "upsert"), ("b", 1, 2, "y", "upsert"), ("b", 5, 3, None, "delete")], schema)
    b2 = spark.createDataFrame([("b", 2, 4, "old", "upsert"), ("a", 6, 5, "x2", "upsert")], schema)
    live, dead = M.apply_changes(b1.limit(0).drop("op"), b1, ["k"])
    live, dead = M.apply_changes(live, b2, ["k"], tombstones=dead)
    assert {r["k"]: r["v"] for r in live.collect()} == {"a": "x2"}
    whole, _ = M.apply_changes(b1.limit(0).drop("op"), b1.unionByName(b2), ["k"])
    assert {r["k"]: r["v"] for r in whole.collect()} == {"a": "x2"}          # stream == batch


def _one_of_each(spark):
    return M.Corpus3(
        spark.createDataFrame([("L", {"name": "l"})], LIBRARIES),
        spark.createDataFrame([{"library_id": "L", "document_id": "d", "doc_pos": 0, "metadata": {}}], DOCUMENTS),
        spark.createDataFrame([{"library_id": "L", "document_id": "d", "chunk_id": "c", "chunk_pos": 0, "text": "old",
                                "embedding": [1.0], "metadata": {}}], CHUNKS))


def test_an_id_given_twice_never_multiplies_rows(spark):
    c = _one_of_each(spark)
    assert M.append_unseen(_vec(spark, [("a", [1])]), _vec(spark, [("b", [1]), ("b", [2])]), ["id"]).count() == 1
    two = c.libraries.unionByName(c.libraries)
    assert M.add_libraries(c, M.Corpus3(two, c.documents, c.chunks)).libraries.count() == 1
    assert M.patch_libraries(c.libraries, two).count() == 1
    docs2, chunks2 = c.documents.unionByName(c.documents), c.chunks.unionByName(c.chunks)
    for out, bad in (M.add_documents(c, docs2), M.update_documents(c, docs2)):
        assert out.documents.count() == 1
        assert [r["resource_type"] for r in bad.collect()] == ["DuplicateDocument"]
    for out, bad in (M.add_chunks(c, chunks2), M.update_chunks(c, chunks2)):
        assert [r["text"] for r in out.chunks.collect()] == ["old"]
        assert [r["resource_type"] for r in bad.collect()] == ["DuplicateChunk"]


def test_the_highest_seq_wins(spark):
    c = _one_of_each(spark)
    batch = c.chunks.withColumn("text", F.lit("first")).withColumn("seq", F.lit(1)).unionByName(
        c.chunks.withColumn("text", F.lit("second")).withColumn("seq", F.lit(2)))
    for out, bad in (M.add_chunks(c, batch), M.update_chunks(c, batch)):
        assert [r["text"] for r in out.chunks.collect()] == ["second"] and bad.count() == 0
    v = _vec(spark, [("a", [1]), ("a", [2])]).withColumn("seq", F.monotonically_increasing_id())
    assert M.upsert_vectors(_vec(spark, [("z", [9])]), v, ["id"], overwrite=True).table.count() == 2


def test_a_chunk_of_an_unknown_library_reports_the_library(spark):
    c = _one_of_each(spark)
    _, bad = M.add_chunks(c, c.chunks.withColumn("library_id", F.lit("nope")))
    assert [tuple(r) for r in bad.collect()] == [("Library", "nope")]


def test_added_documents_take_their_chunks(spark):
    """The named parent wins over a chunk's own document id; a chunk of no added document is reported."""
    c = tables.corpus(spark, SF)
    lib = c.libraries.orderBy("library_id").first()["library_id"]
    docs = spark.createDataFrame([(lib, "new", {})], "library_id string, document_id string, metadata map<string,string>")
    rows = c.chunks.limit(1).withColumn("library_id", F.lit(lib)).withColumn("document_id", F.lit("wrong")).checkpoint()
    chunks = rows.withColumn("chunk_id", F.lit("n1")).withColumn("parent_document_id", F.lit("new")).unionByName(
        rows.withColumn("chunk_id", F.lit("n2")).withColumn("parent_document_id", F.lit(None).cast("string")))
    out, rej = M.add_documents(Corpus3(c.libraries, c.documents, c.chunks), docs, chunks)
    assert [r["document_id"] for r in out.chunks.filter("chunk_id = 'n1'").collect()] == ["new"]
    assert out.chunks.filter("chunk_id = 'n2'").count() == 0
    assert [(r["resource_type"], r["resource_id"]) for r in rej.collect()] == [("Document", "wrong")]


def test_keys_given_twice_are_reported_and_equal_rows_count_once(spark):
    new = _vec(spark, [("b", [1]), ("b", [2]), ("c", [3]), ("c", [3])])
    r = M.append_unseen(_vec(spark, [("a", [1])]), new, ["id"], report=True)
    assert sorted((x["id"], x["vector"][0]) for x in r.table.collect()) == [("a", 1.0), ("c", 3.0)]
    assert sorted((x["id"], x["reason"]) for x in r.rejects.collect()) == [("b", "duplicate_in_batch")] * 2
    c = _one_of_each(spark)
    libs = spark.createDataFrame([("L", {"name": "l", "x": "1"}), ("L", {"x": "1", "name": "l"}), ("M", {"name": "1"}), ("M", {"name": "2"})], LIBRARIES)
    out = M.add_libraries(c, M.Corpus3(libs, c.documents.unionByName(c.documents),
                                       c.chunks.unionByName(c.chunks).unionByName(c.chunks.withColumn("chunk_id", F.lit("e")))
                                       .unionByName(c.chunks.withColumns({"chunk_id": F.lit("e"), "text": F.lit("new")}))))
    assert [x["metadata"] for x in out.libraries.collect()] == [{"name": "l", "x": "1"}]
    assert out.documents.count() == 1 and [x["chunk_id"] for x in out.chunks.collect()] == ["c"]
    assert sorted(tuple(x) for x in out.rejects.collect()) == [("DuplicateChunk", "e"), ("DuplicateLibrary", "M")]
    stored = spark.createDataFrame([("L", {"name": "old"}), ("M", {"name": "old"})], LIBRARIES)
    p = M.patch_libraries(stored, libs, report=True)
    assert {x["library_id"]: x["metadata"]["name"] for x in p.table.collect()} == {"L": "l", "M": "old"}
    assert [tuple(x) for x in p.rejects.collect()] == [("DuplicateLibrary", "M")]


def test_gate_rejects_different_rows_of_one_seq(spark):
    from vellum.operators.mutate import gate

    rows = [("a", 5, "x"), ("a", 5, "y"), ("b", 5, "x"), ("b", 5, "x"), ("c", 1, "x"), ("c", 2, "y"), ("d", 1, "x"), ("d", 1, "y"), ("d", 2, "z"), ("e", None, "x"), ("f", None, "x"), ("f", None, "y")]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "key string, seq int, val string").repartition(3)
        clean, twice = gate(df, ["key"])
        assert sorted(map(tuple, clean.collect()), key=str) == [("b", 5, "x"), ("c", 2, "y"), ("d", 2, "z"), ("e", None, "x")]
        assert sorted(r["key"] for r in twice.collect()) == ["a", "f"]


def test_added_chunks_are_read_twice_at_most(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        made.add(1)
        return x

    libs, docs = spark.createDataFrame([("l", {})], LIBRARIES), spark.createDataFrame([("l", "d", 0, {})], DOCUMENTS)
    stored = spark.createDataFrame([("l", "d", f"c{i}", i, "old", [1.0], {}) for i in range(4)], CHUNKS)
    batch = [("l", "d", "c0", 9, "new", [2.0], {}, 1), ("l", "d", "c0", 9, "new", [2.0], {}, 1), ("l", "d", "c1", 9, "x", [2.0], {}, 1), ("l", "d", "c1", 9, "y", [2.0], {}, 1),
             ("l", "d", "c2", 9, "x", [2.0], {}, 1), ("l", "d", "c2", 9, "y", [2.0], {}, 2), ("l", "gone", "c", 9, "x", [2.0], {}, 1), ("none", "d", "c", 9, "x", [2.0], {}, 1)]
    new = spark.createDataFrame(batch, "library_id string, document_id string, chunk_id string, chunk_pos long, text string, embedding array<float>, metadata map<string,string>, seq int")
    out, bad = M.add_chunks(Corpus3(libs, docs, stored), new.withColumn("text", counted("text")))
    assert sorted(map(tuple, out.chunks.select("chunk_id", "chunk_pos", "text").collect())) == [("c0", 4, "new"), ("c1", 1, "old"), ("c2", 5, "y"), ("c3", 3, "old")]
    assert sorted(map(tuple, bad.collect())) == [("Document", "gone"), ("DuplicateChunk", "c1"), ("Library", "none")]
    assert made.value <= 2 * len(batch)
