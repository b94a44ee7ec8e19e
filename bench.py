"""Benchmark: headline queries on the driver tables plus the reference's
benchmark workload regenerated from the seeded Gaussian source.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line.  Every query runs to completion through the ``noop``
sink (all rows produced, none collected), three times; the median is
reported.  ``value`` is the sum over the driver-table queries.  The workload entries (``wl_*``) are the reference's
10,000 unit Gaussian vectors x 100 queries, k=10, per dimension: index
build seconds (checks, build and published write) and seconds for the whole query
batch, exact kernel and cells; ``fraction_scored`` counts every score computed.
``wl_skew*`` is a skewed case: one library holds a third of 300,000 vectors.
"""

from __future__ import annotations

import glob
import json
import os
import re
import statistics
import sys
import tempfile
import time
import uuid
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
from pyspark.accumulators import AccumulatorParam  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from vellum.catalog import QUERIES, load_all  # noqa: E402
from vellum.operators.cells import build_cells  # noqa: E402
from vellum.operators.knn import knn_join  # noqa: E402
from vellum.operators.tree import build_blocks, knn_tree  # noqa: E402
from vellum.plans.index import build_index, read_index, write_index  # noqa: E402
from vellum.session import local_session  # noqa: E402
from vellum.sources.snapshot import scratch_root  # noqa: E402
from vellum.sources.synthetic import gaussian_vectors  # noqa: E402

HEADLINE = ["search_filtered", "search_topk", "knn_join", "knn_join_grid", "knn_per_query_k", "topk_one",
            "full_ranking", "index_build", "index_freshness", "renest_documents", "flatten", "default_ids",
            "upsert_overwrite", "add_chunks", "delete_libraries", "query_rejects", "empty_report",
            "embed_hash", "knn_cells", "cells_build", "median_split", "snapshot_roundtrip", "stream_upsert"]

WORKLOAD_DIMS = [3, 10, 50, 100, 300, 768]   # the reference's dims, plus 3-d where cells prune
CELL_DIMS = [3, 10, 50]


class Pair(AccumulatorParam):
    def zero(self, value):
        return np.zeros(2)

    def addInPlace(self, a, b):
        return a + b


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return round(time.perf_counter() - t0, 3)


def workload(spark, out: dict) -> None:
    for d in WORKLOAD_DIMS:
        base = gaussian_vectors(spark, 10_000, d, seed=42, num_partitions=8).select(
            F.lit("bench").alias("library_id"), F.col("id").cast("string").alias("chunk_id"),
            F.col("embedding").alias("vector"), F.lit(1.0).alias("inv_norm"), F.lit(0).cast("long").alias("build_id"))
        qs = gaussian_vectors(spark, 100, d, seed=43).select(
            F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"), F.lit("bench").alias("library_id"),
            "embedding", F.lit(10).alias("k"))
        idx = base.checkpoint(eager=True)
        chunks = idx.select("library_id", F.lit("d").alias("document_id"), "chunk_id", F.col("vector").alias("embedding"))
        root = scratch_root(spark, f"bench-{uuid.uuid4().hex}")
        out[f"wl_exact_d{d}_build"] = timed(
            lambda: write_index(build_index(chunks, chunks.select("library_id").distinct()), root))
        idx = read_index(spark, root)[0]
        out[f"wl_exact_d{d}_query100"] = timed(lambda: run(knn_join(idx, qs, k=10)))
        # vectors scored per second (10,000 vectors x 100 queries per batch)
        out[f"wl_exact_d{d}_vectors_per_sec"] = round(1_000_000 / max(out[f"wl_exact_d{d}_query100"], 1e-9))
        if d in CELL_DIMS:
            holder = {}

            def build():
                holder["blocks"] = build_blocks(idx)

            out[f"wl_cells_d{d}_build"] = timed(build)
            out[f"wl_cells_d{d}_query100"] = timed(lambda: run(knn_tree(holder["blocks"], qs, k=10)))
            # fraction of the (query, vector) pairs whose score is computed
            scored = spark.sparkContext.accumulator(np.zeros(2), Pair())
            run(knn_tree(holder["blocks"], qs, k=10, scored=scored))
            out[f"wl_cells_d{d}_fraction_scored"] = round(float(scored.value[0] / max(scored.value[1], 1)), 4)
            out[f"wl_cells_approx_d{d}_build"] = timed(
                lambda: [x.checkpoint(eager=True) for x in build_cells(idx, leaf_size=40, split="approx")])


def _event_lines(path: str):
    """Lines of one event-log file (Spark 4 compresses them with zstd)."""
    if path.endswith(".zstd"):
        import io

        import zstandard
        with open(path, "rb") as raw:
            reader = zstandard.ZstdDecompressor().stream_reader(raw)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path) as f:
            yield from f


def stage_summary(log_dir: str) -> dict:
    """Per query (job description), stage count, summed and longest stage
    seconds, read from Spark's event log."""
    stage_query, stage_secs = {}, {}
    for path in glob.glob(os.path.join(log_dir, "**", "events_*"), recursive=True):
        for line in _event_lines(path):
            ev = json.loads(line)
            kind = ev.get("Event", "")
            if kind.endswith("SparkListenerJobStart"):
                desc = (ev.get("Properties") or {}).get("spark.job.description")
                for sid in ev.get("Stage IDs", []):
                    stage_query[sid] = desc
            elif kind.endswith("SparkListenerStageCompleted"):
                info = ev["Stage Info"]
                if info.get("Submission Time") and info.get("Completion Time"):
                    stage_secs[info["Stage ID"]] = (info["Completion Time"] - info["Submission Time"]) / 1000
    out: dict = defaultdict(lambda: {"stages": 0, "stage_sec": 0.0, "max_stage_sec": 0.0})
    for sid, secs in stage_secs.items():
        q = stage_query.get(sid) or "other"
        out[q]["stages"] += 1
        out[q]["stage_sec"] = round(out[q]["stage_sec"] + secs, 3)
        out[q]["max_stage_sec"] = max(out[q]["max_stage_sec"], secs)
    return dict(out)


def skew_workload(spark, out: dict) -> None:
    """300,000 vectors (64-d) where one library holds a third of them and the
    rest are spread over 200 libraries; 3,000 queries in the same mix, k=10,
    through both exact kernels."""
    lib = (F.when(F.col("id") % 3 == 0, F.lit("hot"))
           .otherwise(F.concat(F.lit("lib"), (F.col("id") % 200).cast("string"))))
    base = gaussian_vectors(spark, 300_000, 64, seed=42, num_partitions=16).select(
        lib.alias("library_id"), F.col("id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"),
        F.lit(1.0).alias("inv_norm"), F.lit(0).cast("long").alias("build_id")).checkpoint(eager=True)
    qs = gaussian_vectors(spark, 3_000, 64, seed=43).select(
        F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"), lib.alias("library_id"),
        "embedding", F.lit(10).alias("k")).checkpoint(eager=True)
    for kernel in ("scan", "grid"):
        out[f"wl_skew300k_{kernel}_query3000"] = timed(lambda: run(knn_join(base, qs, k=10, kernel=kernel)))


def large_workload(spark, out: dict) -> None:
    """1,000,000 3-d vectors of one library, 100 queries: exact scan against the tree."""
    base = gaussian_vectors(spark, 1_000_000, 3, seed=42, num_partitions=16).select(
        F.lit("bench").alias("library_id"), F.col("id").cast("string").alias("chunk_id"),
        F.col("embedding").alias("vector"), F.lit(1.0).alias("inv_norm"), F.lit(0).cast("long").alias("build_id")).checkpoint(eager=True)
    qs = gaussian_vectors(spark, 100, 3, seed=43).select(
        F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"), F.lit("bench").alias("library_id"), "embedding", F.lit(10).alias("k"))
    holder = {}

    def build():
        holder["blocks"] = build_blocks(base)

    out["wl_cells_1m_d3_build"] = timed(build)
    out["wl_cells_1m_d3_query100"] = timed(lambda: run(knn_tree(holder["blocks"], qs, k=10)))
    out["wl_exact_1m_d3_query100"] = timed(lambda: run(knn_join(base, qs, k=10)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # the checkpoint folder comes from spark.checkpoint.dir; local_session
    # sets a scratch one only when it is unset
    extra = {}
    log_dir = None
    if os.environ.get("BENCH_EVENTLOG"):
        log_dir = tempfile.mkdtemp(prefix="vellum-eventlog-")
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}"}
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="vellum-bench", extra_conf=extra)
    load_all()
    run(QUERIES["vec_norm"](spark, sf_dir))                 # warm-up: JVM, Python workers
    queries: dict[str, float] = {}
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    for name in HEADLINE:
        spark.sparkContext.setJobDescription(name)
        queries[name] = statistics.median(timed(lambda: run(QUERIES[name](spark, sf_dir))) for _ in range(repeats))
    spark.sparkContext.setJobDescription(None)
    total = round(sum(queries.values()), 3)
    if os.environ.get("BENCH_WORKLOAD", "1") != "0":
        workload(spark, queries)
        skew_workload(spark, queries)
        large_workload(spark, queries)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": queries, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}))
    spark.stop()
    if log_dir:
        print(json.dumps({"stages": stage_summary(log_dir)}), file=sys.stderr)


if __name__ == "__main__":
    main()
