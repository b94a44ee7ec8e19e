"""The change-feed stream, micro-batch by micro-batch, ends in the same
table as one batch merge of the whole feed; the listener sees every batch."""

import time
import uuid



from vellum.operators.mutate import apply_changes
from vellum.sources.snapshot import scratch_root
from vellum.streaming.ingest import ProgressLog, current_table, stage_files, upsert_stream


def test_stream_equals_batch(spark):
    rows = []
    for i in range(300):
        key = f"k{i % 37}"
        op = "delete" if i % 11 == 0 else "upsert"
        rows.append((key, (i * 7919) % 1000, i, f"v{i}", op))      # ts not in arrival order
    feed = spark.createDataFrame(rows, "key string, ts long, seq long, val string, op string")
    root = scratch_root(spark, f"test-stream-{uuid.uuid4().hex}")
    src = stage_files(feed, f"{root}/src", 3, "seq")
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        q = upsert_stream(spark, src, feed.schema, f"{root}/table", ["key"], checkpoint=f"{root}/ckpt",
                          buckets=4)
        q.awaitTermination()
        for _ in range(50):                     # listener events arrive asynchronously
            if sum(b["input_rows"] for b in log.batches) >= 300:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    got = {r["key"]: (r["ts"], r["val"]) for r in current_table(spark, f"{root}/table").collect()}
    live, _ = apply_changes(feed.limit(0).drop("op"), feed, ["key"])
    want = {r["key"]: (r["ts"], r["val"]) for r in live.collect()}
    assert got == want and len(got) > 0
    assert len(log.batches) >= 3 and sum(b["input_rows"] for b in log.batches) == 300



def test_query_stream_equals_batch_search(spark):
    """M2: queries arriving on a stream, searched per micro-batch against a
    static index, give the same hits as one batch search."""
    from vellum.plans.index import build_index, read_index, write_index
    from vellum.plans.search import search
    from vellum.schema import QUERIES
    from vellum.sources import tables
    from vellum.streaming.ingest import search_stream

    from .conftest import SF

    c = tables.corpus(spark, SF)
    root = scratch_root(spark, f"test-qstream-{uuid.uuid4().hex}")
    write_index(build_index(c.chunks, c.libraries), f"{root}/idx")
    index, meta = read_index(spark, f"{root}/idx")
    q = tables.queries(spark, SF, k=4, filter_keys=("lang",)).select(*[f.name for f in QUERIES.fields])
    src = stage_files(q, f"{root}/src", 3, "query_id")

    def run(batch):
        return search(index, meta, c.chunks, batch).hits.select("query_id", "rank", "chunk_id", "score")

    s = search_stream(spark, src, spark.read.parquet(src).schema, f"{root}/hits", run, checkpoint=f"{root}/ckpt")
    s.awaitTermination()
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in spark.read.parquet(f"{root}/hits").collect())
    want = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in run(q).collect())
    assert got == want and len(got) > 0


def test_a_new_checkpoint_goes_on_from_the_table(spark):
    """A second stream (new checkpoint) over the same table adds to it; replaying a
    published batch changes nothing; another number of buckets is refused."""
    import pytest

    from vellum.sources.snapshot import versions

    feed = spark.createDataFrame([(f"k{i}", i, i, f"v{i}", "upsert") for i in range(40)],
                                 "key string, ts long, seq long, val string, op string")
    root = scratch_root(spark, f"test-restart-{uuid.uuid4().hex}")

    def play(rows, name, checkpoint, buckets=4):
        src = stage_files(rows, f"{root}/{name}", 2, "seq")
        q = upsert_stream(spark, src, feed.schema, f"{root}/table", ["key"], checkpoint=f"{root}/{checkpoint}", buckets=buckets)
        q.awaitTermination()

    play(feed.filter("ts < 20"), "src1", "ckpt1")
    first = versions(spark, f"{root}/table")
    play(feed.filter("ts >= 10"), "src2", "ckpt2")
    assert {r["key"] for r in current_table(spark, f"{root}/table").collect()} == {f"k{i}" for i in range(40)}
    assert current_table(spark, f"{root}/table").count() == 40
    done = versions(spark, f"{root}/table")
    assert done[:len(first)] == first and len(done) == 4
    q = upsert_stream(spark, f"{root}/src2", feed.schema, f"{root}/table", ["key"], checkpoint=f"{root}/ckpt2", buckets=4)
    q.awaitTermination()
    assert versions(spark, f"{root}/table") == done
    with pytest.raises(Exception, match="4 buckets"):
        play(feed.limit(1), "src3", "ckpt3", buckets=8)
    assert current_table(spark, f"{root}/table").count() == 40


def sizes(spark, root):
    """Bytes of every folder of a table."""
    import os
    from vellum.sources import fs
    base = root.removeprefix("file:")
    return {n: sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(f"{base}/{n}") for f in files) for n in fs.list_names(spark, root) if n.startswith("v")}


def test_log_appends_merges_and_compacts(spark):
    from pyspark.sql import functions as F

    from vellum.streaming import log

    root = scratch_root(spark, f"test-log-{uuid.uuid4().hex}")
    rows = spark.range(20_000).select(F.col("id").alias("key"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("v"), "id").alias("val"), F.lit("upsert").alias("op"))
    assert log.append(spark, root, rows, ["key"], ["seq"], buckets=8, stream="s", batch=0)
    assert not log.append(spark, root, rows, ["key"], ["seq"], buckets=8, stream="s", batch=0)       # published before
    assert log.compact(spark, root, force=True) and not log.compact(spark, root, force=True)
    large = max(sizes(spark, root).values())
    change = rows.filter("key < 200").withColumn("seq", F.lit(2).cast("long")).withColumn("op", F.when(F.col("key") % 2 == 0, "delete").otherwise("upsert")) \
        .withColumn("val", F.lit("new"))
    log.append(spark, root, change, ["key"], ["seq"], buckets=8, stream="s", batch=1)
    late = rows.filter("key < 300").withColumn("seq", F.lit(1).cast("long")).withColumn("val", F.lit("late"))
    before = set(sizes(spark, root))
    log.append(spark, root, late, ["key"], ["seq"], buckets=8, stream="s", batch=2)
    small = {n: b for n, b in sizes(spark, root).items() if n not in before}
    assert len(small) == 1 and sum(small.values()) < large / 10                  # a batch costs what its own rows cost

    def state():
        return {r["key"]: r["val"] for r in log.read(spark, root).collect()}

    want = {k: "new" if k < 200 else "late" if k < 300 else f"v{k}" for k in range(20_000) if k >= 200 or k % 2}
    assert state() == want
    assert log.compact(spark, root, force=True) and state() == want
    one = spark.createDataFrame([(7, 3, "only", "upsert")], rows.schema)
    log.append(spark, root, one, ["key"], ["seq"], buckets=8, stream="s", batch=3)
    held = {b: d for b, d in log.manifest(spark, root)["base"].items()}
    log.compact(spark, root, force=True)
    now = log.manifest(spark, root)["base"]
    assert sum(held[b] != now[b] for b in held) == 1                             # untouched buckets stay
    assert state() == {**want, 7: "only"}
    log.vacuum(spark, root, keep=1)
    assert state() == {**want, 7: "only"}


def test_log_ties_do_not_hang_on_arrival(spark):
    from vellum.streaming import log

    rows = [("k", 1, "a", "upsert"), ("k", 1, "b", "upsert"), ("k", 1, "b", "upsert"), ("m", 1, "x", "delete"), ("m", 1, "y", "upsert")]
    found = set()
    for order in (rows, rows[::-1]):
        root = scratch_root(spark, f"test-ties-{uuid.uuid4().hex}")
        for i, r in enumerate(order):
            log.append(spark, root, spark.createDataFrame([r], "key string, seq long, val string, op string"), ["key"], ["seq"], buckets=2, stream="s", batch=i)
        found.add(tuple(sorted(map(tuple, log.read(spark, root).collect()))))
    assert len(found) == 1


def brute_corpus(events):
    docs, chunks = {}, {}
    for e in sorted(events, key=lambda e: e["seq"]):
        d = (e["library_id"], e["document_id"])
        c = (*d, e["chunk_id"])
        if e["kind"] == "document":
            if e["op"] == "update":
                if d in docs:
                    docs[d] = e["metadata"]
            else:
                docs.pop(d, None)
                for x in [x for x in chunks if x[:2] == d]:
                    del chunks[x]
                if e["op"] == "add":
                    docs[d] = e["metadata"]
        elif d in docs:
            if e["op"] == "add":
                chunks[c] = (e["text"], e["metadata"])
            elif e["op"] == "delete":
                chunks.pop(c, None)
            elif c in chunks:
                chunks[c] = (e["text"], e["metadata"])
    return docs, chunks


def test_corpus_stream_in_any_order_and_over_a_restart(spark):
    import random

    from vellum.streaming.corpus import EVENTS, corpus, corpus_stream

    r = random.Random(7)
    events = []
    for seq in range(700):
        doc, kind = f"d{r.randint(0, 12)}", r.choice(["document", "chunk", "chunk", "chunk"])
        op = r.choice(["add", "add", "update", "delete"]) if kind == "chunk" else r.choice(["add", "update", "delete"])
        events.append({"seq": seq, "kind": kind, "op": op, "library_id": "l", "document_id": doc, "chunk_id": f"c{r.randint(0, 6)}" if kind == "chunk" else None,
                       "text": f"t{seq}" if kind == "chunk" else None, "embedding": [0.1, float(seq)] if kind == "chunk" else None, "metadata": {"n": str(seq), "x": None}})
    events += [dict(e, seq=1000 + i, document_id="never", kind="chunk", op="add", chunk_id="c") for i, e in enumerate(events[:3])]
    events += [dict(events[0], seq=None), dict(events[0], library_id=None)]
    want = brute_corpus([e for e in events if e["seq"] is not None and e["library_id"] is not None])
    root = scratch_root(spark, f"test-corpus-{uuid.uuid4().hex}")
    r.shuffle(events)
    half = len(events) // 2

    def stage(some):
        spark.createDataFrame([tuple(e[f.name] for f in EVENTS.fields) for e in some], EVENTS).repartition(3).write.mode("append").parquet(f"{root}/src")

    def play():
        corpus_stream(spark, f"{root}/src", f"{root}/corpus", checkpoint=f"{root}/ckpt", max_files_per_trigger=2, buckets=3).awaitTermination()
        documents, chunks = corpus(spark, f"{root}/corpus")
        return ({(d["library_id"], d["document_id"]): d["metadata"] for d in documents.collect()},
                {(c["library_id"], c["document_id"], c["chunk_id"]): (c["text"], c["metadata"]) for c in chunks.collect()})

    stage(events[:half])
    play()                                  # the stream stops, and goes on from its checkpoint
    stage(events[half:])
    assert play() == want
    assert play() == want and len(want[0]) > 2 and len(want[1]) > 5


def test_a_document_costs_one_frame_and_few_calls_to_the_state():
    import pandas as pd

    from vellum.streaming import corpus as C

    calls = []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            return lambda *a: calls.append((self.name, call)) or (False if call == "exists" else None)

    hold = C.HoldChunks()
    hold.doc, hold.waiting = State("doc"), State("waiting")
    events = pd.DataFrame({"seq": [3, 1, 2, 9], "kind": ["chunk", "document", "chunk", "document"], "op": ["add", "add", "add", "update"], "body": list("abcd")})
    out = pd.concat(hold.handleInputRows(("l", "d"), iter([events]), None))
    assert sorted(out["body"]) == list("abcd") and set(out["document_id"]) == {"d"} and out["seq"].dtype == "int64"
    assert calls == [("doc", "get"), ("doc", "update"), ("waiting", "exists")]
