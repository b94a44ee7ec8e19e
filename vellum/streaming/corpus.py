"""The corpus as a change feed (M1 over U9-U14), in whatever order changes arrive.

An event is one change of a document or a chunk, with a ``seq`` that gives the order of the
changes:

=========  ========  ==================================================================
kind       op        effect
=========  ========  ==================================================================
document   add       U9: the document, new; an older one of the id goes with its chunks
document   update    U10: metadata replaced, chunks kept
document   delete    U11: the document goes, with its chunks
chunk      add       U12: the chunk, new; an older one of the id goes
chunk      update    U13: text, vector and metadata replaced
chunk      delete    U14: the chunk goes
=========  ========  ==================================================================

Chunks may arrive before their document.  A stateful operator (``transformWithState``) keyed by document holds a
document's chunk events in a list state until the document is there, and then lets them go; the list is
appended to and streamed, never loaded whole.  Chunk events older than the
document's last add or delete belong to a document that is gone, and are dropped.  What is let go is appended
to two logs (:mod:`vellum.streaming.log`).  ``corpus`` reads the logs: an add or delete decides whether a key
lives, a later update its content; a chunk older than its document's last add is gone (the cascade).
The result depends on the events alone, not on their arrival, batching or restarts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import STR_MAP, VECTOR
from . import log
from .ingest import started, stream_id

DOC = ["library_id", "document_id"]
CHUNK = [*DOC, "chunk_id"]

#: An event of the feed.
EVENTS = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("op", T.StringType()),
    T.StructField("library_id", T.StringType()), T.StructField("document_id", T.StringType()), T.StructField("chunk_id", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("embedding", VECTOR), T.StructField("metadata", STR_MAP)])

#: What the stateful operator passes on: order and kind in the open, the rest as one JSON text.
_HELD = T.StructType([T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("body", T.StringType())])
_PASSED = T.StructType([*[T.StructField(c, T.StringType()) for c in DOC], *_HELD.fields])
#: Events of one frame handed on.
_FRAME = 4_096


class HoldChunks(StatefulProcessor):
    """Per document: the seq of its last add or delete, whether it lives, and the chunk events that wait for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.doc = handle.getValueState("doc", "seq long, lives boolean")
        self.waiting = handle.getListState("waiting", _HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = self.doc.get() or (None, False)
        epoch, lives = now[0], now[1]
        docs: list[tuple] = []
        held: list[tuple] = []
        for pdf in rows:
            # plain lists: most documents have a handful of events, and a frame costs more than they do
            for seq, kind, op, body in zip(*(pdf[c].tolist() for c in ("seq", "kind", "op", "body"))):
                if kind == "document":
                    if op != "update" and (epoch is None or seq > epoch):
                        epoch, lives = int(seq), op == "add"
                    docs.append((seq, kind, body))
                elif kind == "chunk":
                    held.append((int(seq), kind, body))
            if len(docs) >= _FRAME:
                yield self._out(key, docs)
                docs = []
            if len(held) >= _FRAME:
                yield from self._settle(key, held, epoch, lives)
                held = []
        if docs:
            yield self._out(key, docs)
        yield from self._settle(key, held, epoch, lives)
        if (epoch, lives) != (now[0], now[1]):
            self.doc.update((epoch, lives))
            if lives and self.waiting.exists():
                yield from self._let_go(key, epoch)

    def _settle(self, key, events: list[tuple], epoch, lives):
        """Lets chunk events pass where their document lives, holds the others; older ones are dropped."""
        events = [e for e in events if epoch is None or e[0] > epoch]
        if not events:
            return
        if lives:
            yield self._out(key, events)
        else:
            self.waiting.appendList(events)

    def _let_go(self, key, epoch):
        some = []
        for e in self.waiting.get():
            if e[0] > epoch:
                some.append(tuple(e))
            if len(some) >= _FRAME:
                yield self._out(key, some)
                some = []
        if some:
            yield self._out(key, some)
        self.waiting.clear()

    def _out(self, key, events: list[tuple]) -> pd.DataFrame:
        seq, kind, body = zip(*events)
        return pd.DataFrame({"library_id": key[0], "document_id": key[1], "seq": np.array(seq, np.int64), "kind": kind, "body": body})

    def close(self) -> None:
        pass


def corpus_stream(spark: SparkSession, source: str, root: str, *, checkpoint: str, processing_time: str | None = None,
                  max_files_per_trigger: int = 1, buckets: int = 64):
    """Starts the stream of ``EVENTS`` files under ``source`` into the logs ``root/documents`` and ``root/chunks``.
    Needs the RocksDB state store (set for the session where another is configured)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # the process that sets up the stream's state does not see files added to the session: it gets the class itself
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    feed = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
    # events without a seq or a key have no place in the order
    whole = feed.filter("seq IS NOT NULL AND library_id IS NOT NULL AND document_id IS NOT NULL AND (kind = 'document' OR chunk_id IS NOT NULL)")
    packed = whole.select(*DOC, "seq", "kind", "op", F.to_json(F.struct("op", "chunk_id", "text", "embedding", "metadata")).alias("body"))
    passed = packed.groupBy(*DOC).transformWithStateInPandas(HoldChunks(), _PASSED, outputMode="Append", timeMode="None")
    body = T.StructType([f for f in EVENTS.fields if f.name in ("op", "chunk_id", "text", "embedding", "metadata")])

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("b", F.from_json("body", body)).select(*DOC, "seq", "kind", "b.*")
        # an add or delete and an update of one key are kept side by side
        rows = rows.withColumn("later", F.col("op") == "update")
        sid = stream_id(spark, checkpoint)
        for kind, keys, more in (("document", DOC, []), ("chunk", CHUNK, ["text", "embedding"])):
            some = rows.filter(F.col("kind") == kind).select(*keys, "later", "seq", "op", *more, "metadata")
            where = f"{root.rstrip('/')}/{kind}s"
            log.append(spark, where, some, [*keys, "later"], ["seq"], buckets=buckets, stream=sid, batch=batch_id)
            log.compact(spark, where)

    return started(passed, apply, checkpoint, processing_time)


def _living(rows: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """One row per key that lives: ``epoch`` (seq of its add) and its content, of the update where one is later."""
    old = rows.filter(~F.col("later") & (F.col("op") == "add")).select(*keys, F.col("seq").alias("epoch"), F.struct(*content).alias("_a"))
    new = rows.filter("later").select(*keys, F.col("seq").alias("_seq"), F.struct(*content).alias("_u"))
    j = old.join(new, keys, "left")
    best = F.when(F.col("_seq") > F.col("epoch"), F.col("_u")).otherwise(F.col("_a"))
    return j.withColumn("_c", best).select(*keys, "epoch", *[F.col("_c")[c].alias(c) for c in content])


def corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) as the events so far leave them; ``epoch`` gives the order within the parent."""
    documents = _living(log.read(spark, f"{root.rstrip('/')}/documents", deletes=True), DOC, ["metadata"])
    chunks = _living(log.read(spark, f"{root.rstrip('/')}/chunks", deletes=True), CHUNK, ["text", "embedding", "metadata"])
    alive = documents.select(*DOC, F.col("epoch").alias("_since"))
    chunks = chunks.join(alive, DOC).filter(F.col("epoch") > F.col("_since")).drop("_since")
    return documents, chunks
