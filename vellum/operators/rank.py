"""Exact row positions without a single-task sort.

``row_number()`` over a window with no (or a skewed) partition key sorts a
whole group in one task.  :func:`positions` gives the same numbers the way
``zipWithIndex`` does: a range-partitioned global sort (sampled bounds, so
every task gets a balanced slice even when one group holds a third of the
rows), a per-(task, group) count, prefix sums over those small counts, and a
streaming per-task counter.  The sorted data is checkpointed once so the
counting pass and the numbering pass see the same partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, stored


def positions(df: DataFrame, order_cols: list, group_cols: list[str] | None = None,
              out: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row within its group (all rows
    when ``group_cols`` is empty) by ``order_cols``.  ``order_cols`` must give
    a total order (end it with a unique key)."""
    group_cols = list(group_cols or [])
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sort_keys = [F.col(g) for g in group_cols] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    x = (df.repartitionByRange(n, *sort_keys).sortWithinPartitions(*sort_keys)
         .withColumn("_pid", F.spark_partition_id()))
    x = x.checkpoint(eager=True)

    gkey = "_gkey"
    xg = x.withColumn(gkey, F.to_json(F.struct(*group_cols)) if group_cols else F.lit(""))
    counts = xg.groupBy("_pid", gkey).agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(gkey).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", gkey, F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))

    schema = T.StructType(xg.schema.fields + [T.StructField("_local", T.LongType(), False)])

    def number(batches):
        last_key, carry = None, 0
        for pdf in batches:
            if pdf.empty:
                continue
            keys = pdf[gkey].to_numpy()
            local = pdf.groupby(gkey, sort=False).cumcount().to_numpy().astype(np.int64)
            if last_key is not None:
                local = local + np.where(keys == last_key, carry, 0)
            last_key = keys[-1]
            carry = int(local[-1]) + 1
            pdf["_local"] = local
            yield pdf

    numbered = xg.mapInPandas(number, schema)
    res = numbered.join(offsets, ["_pid", gkey])
    return res.withColumn(out, (F.col("_off") + F.col("_local")).cast("long")) \
              .drop("_pid", gkey, "_local", "_off")


def at_rank(rows: DataFrame, group_cols: list[str], value: str, key: str, targets: DataFrame,
            small: int = 4_096, bins: int = 1_024) -> DataFrame:
    """The row at position ``target`` (from 0, in order of ``value``, then ``key``) of every group of
    ``targets`` (``group_cols, target``): ``group_cols, _t, _id``, its value and key.

    Selection, not sorting: a histogram of the interval that holds the position (one
    partial aggregate over all groups) names the bin it falls in, whose own least and greatest value are the next
    interval.  Equal values are told apart the same way by longer and longer beginnings of
    ``key`` (a string, unique in its group).  An interval of at most ``small`` rows is ranked.  Groups of any size go together, and none is sorted whole."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    g = list(group_cols)
    # the three columns that every round reads, written once
    x = stored(rows.select(*g, F.col(value).alias("_v"), F.col(key).alias("_k")))
    state = stored(x.groupBy(*g).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("cnt"))
             .join(targets.select(*g, "target"), g)
             .select(*g, "lo", "hi", "cnt", "target", F.lit(0).cast("long").alias("before"), F.lit("").alias("pre"), F.lit(False).alias("one")))

    def inside(some: DataFrame) -> DataFrame:
        return x.join(some, g).filter(F.col("_v").between(F.col("lo"), F.col("hi")) & F.when(F.col("one"), F.col("_k") == F.col("pre")).otherwise(F.col("_k").startswith(F.col("pre"))))

    def narrowed(some: DataFrame, bin_, **new) -> DataFrame:
        h = inside(some).withColumn("_b", bin_).groupBy(*g, "_b", "target", "before", "pre").agg(
            F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        past = F.col("before") + F.sum("c").over(Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        h = h.withColumn("past", F.coalesce(past, F.col("before")))
        h = h.filter((F.col("past") <= F.col("target")) & (F.col("target") < F.col("past") + F.col("c")))
        return h.select(*g, "lo", "hi", F.col("c").alias("cnt"), "target", F.col("past").alias("before"),
                        new.get("pre", F.col("pre")).alias("pre"), new.get("one", F.lit(False)).alias("one"))

    large = (F.col("cnt") > small) & ~F.col("one")
    spread_ = F.col("lo") < F.col("hi")
    while (open_ := state.filter(large).agg(F.count(F.when(spread_, 1)).alias("v"), F.count(F.when(~spread_, 1)).alias("k")).first()) and (open_["v"] or open_["k"]):
        parts = [state.filter(~large)]
        if open_["v"]:
            place = F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
            parts.append(narrowed(state.filter(large & spread_), F.least(place, F.lit(bins - 1))))
        if open_["k"]:
            longer = F.substring(F.col("_k"), F.lit(1), F.length("pre") + 2)
            parts.append(narrowed(state.filter(large & ~spread_), longer, pre=F.col("_b"), one=F.length("_b") < F.length("pre") + 2))
        for more in parts[1:]:
            parts[0] = parts[0].unionByName(more)
        state = stored(parts[0])
    last = inside(state).withColumn("_p", F.row_number().over(Window.partitionBy(*g).orderBy("_v", "_k")) - 1 + F.col("before"))
    return last.filter(F.col("_p") == F.col("target")).select(*g, F.col("_v").alias("_t"), F.col("_k").alias("_id"))
