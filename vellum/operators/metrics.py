"""Metrics of the table operations (N1) and summaries of timings."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, op: str, **metrics: Column) -> tuple[DataFrame, Callable[[], dict]]:
    """``df`` with its rows (and ``metrics``, aggregate expressions) counted
    while the one action that writes or reads it runs: no second pass.  Returns the
    frame to run and a function that gives ``op``, the counts and ``millis`` since
    this call, once the action has ended (before, it waits)."""
    seen = Observation(op)
    start = time.perf_counter()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in metrics.items()])

    def result() -> dict:
        got = dict(seen.get)
        return {"op": op, **got, "millis": round(1000 * (time.perf_counter() - start))}

    return out, result


def timing_summary(timings: DataFrame, config: list[str], value: str) -> DataFrame:
    """Per configuration, number, mean, least and largest of ``value`` (nulls
    left out; a configuration with none has a null mean).  One partial aggregate."""
    v = F.col(value).cast("double")
    return timings.groupBy(*config).agg(F.count(v).alias("n"), F.avg(v).alias("mean"),
                                        F.min(v).alias("least"), F.max(v).alias("largest"))
