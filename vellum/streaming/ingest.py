"""Continuous ingest with versioned publishing (M1) and a query stream
against a static index (M2).

M1 replaces the reference's "save every 300 s" loop: a change feed is read
with ``readStream``; each micro-batch (``trigger(processingTime=...)`` in
production, ``availableNow`` for catch-up and tests) appends its changes to
a table kept as a log (:mod:`vellum.streaming.log`): the newest change per key, deletes
kept (a late, older change cannot revive a key), published as a new
version and compacted when changes have outgrown the base.

A batch that was published is not applied again, a batch that failed
before its manifest overwrites only its own directory, and a stream with a new
checkpoint adds versions and touches no older one.  One stream writes at a time.
The streaming checkpoint lives under the shared checkpoint folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import fs
from . import log


def stage_files(df: DataFrame, folder: str, n_files: int, spread_col: str) -> str:
    """Write ``df`` as ``n_files`` Parquet files (rows spread by a hash of
    ``spread_col``, so each file mixes old and new changes), to be replayed
    as a stream one file per trigger."""
    (df.repartition(n_files, F.pmod(F.xxhash64(spread_col), F.lit(n_files)))
     .write.mode("overwrite").parquet(folder))
    return folder


class ProgressLog(StreamingQueryListener):
    """N1 for streams: input rows and durations per micro-batch."""

    def __init__(self):
        self.batches: list[dict] = []

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.batches.append({"batch_id": p.batchId, "input_rows": p.numInputRows,
                             "duration_ms": dict(p.durationMs)})

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gives a stream, kept in its checkpoint across restarts."""
    return json.loads(fs.read_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


def started(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, processing_time: str | None):
    """The running query that hands every micro-batch, read once, to ``apply``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()          # feeds several jobs; recomputed where lost
        try:
            apply(batch, batch_id)
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    return w.start()


def upsert_stream(spark: SparkSession, source: str, schema, root: str, keys: list[str], *,
                  op_col: str = "op", order_cols: tuple[str, ...] = ("ts", "seq"),
                  checkpoint: str, to_changes: Callable[[DataFrame], DataFrame] | None = None,
                  processing_time: str | None = None, max_files_per_trigger: int = 1,
                  buckets: int = 64):
    """M1: start the ingest stream; returns the StreamingQuery.  With
    ``processing_time=None`` it runs ``availableNow`` (all pending files,
    one or more micro-batches, then stops).  ``buckets`` is a property of the table:
    a stream that asks for another number than the table has fails."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source))

    def apply(batch: DataFrame, batch_id: int) -> None:
        changes = to_changes(batch) if to_changes else batch
        log.append(spark, root, changes, keys, list(order_cols), op_col=op_col, buckets=buckets,
                   stream=stream_id(spark, checkpoint), batch=batch_id)
        log.compact(spark, root)

    return started(stream, apply, checkpoint, processing_time)


def current_table(spark: SparkSession, root: str) -> DataFrame:
    """The newest published version of a table kept by :func:`upsert_stream`."""
    return log.read(spark, root)


def search_stream(spark: SparkSession, source: str, schema, out: str, run_batch: Callable[[DataFrame], DataFrame], *,
                  checkpoint: str, processing_time: str | None = None, max_files_per_trigger: int = 1):
    """M2: run ``run_batch`` (e.g. a T3 search against a static index) on
    every micro-batch of a query stream; each batch's hits are written to
    ``out/batch=<id>`` (a retry overwrites its own output)."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source))

    def apply(batch: DataFrame, batch_id: int) -> None:
        run_batch(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    return started(stream, apply, checkpoint, processing_time)
