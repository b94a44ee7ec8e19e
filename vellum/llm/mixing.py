"""Mixing sources to target weights.

A source's size is the words of its documents.  Sources share the total size by
their weights; a target stops at ``MAX_REPEAT`` times its source's size, and
what is over goes to the others by weight until none is above.  A source's rate
is target / size, and each of its documents is taken floor(rate) times plus once
more with the probability of the fraction, decided by a hash: the same rows give
the same mix.  :func:`plan` hashes the id, so rows of one id draw alike; the pipeline
hashes id, text, the other columns and the number among equal rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import positions
from .common import cut, word_count

MAX_REPEAT = 3
#: Weights of the sources in code-point order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: A table of sources up to this many rows is broadcast; beyond, joins shuffle.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sizes`` (source, source_size; one row per source, a null one sorts
    last) with ``target``.  The share per unit of weight is found by passes over
    the sources that send three sums to the driver each; every pass but the last
    stops at least one more source at its cap."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_pos") % len(weights) + 1).cast("int"))
    ranked = positions(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], out="_pos")
    s = cut(ranked.select("source", "source_size", w.cast("long").alias("weight"),
                          (max_repeat * F.col("source_size")).alias("cap")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    share = None
    while True:
        capped = F.lit(False) if share is None else F.col("cap") <= F.lit(share) * F.col("weight")
        caps, heavy = s.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0)),
                            F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        if not heavy:
            break
        new = (total - caps) / heavy
        if new == share:
            break
        share = new
    target = F.least(F.col("cap").cast("double"), F.lit(share or 0.0) * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def copies(target: Column, size: Column, key: Column) -> Column:
    """How often a document is taken; ``key``: text that decides the extra copy."""
    rate = F.when(size > 0, target / size).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def draw_key(seed: str = "mix") -> Column:
    return F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def plan(docs: DataFrame, size: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target,
    copies and the columns of ``keep``.  Null sources are one source, last in order; null
    and empty texts have size 0; a source of size 0 has target 0 and is not taken.
    Rows with equal ids draw alike.  An empty table gives none."""
    sized = cut(docs.select("doc_id", "source", *keep, (word_count(F.col("text")) if size is None else size).alias("size")))
    by = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    few = by.count() <= BROADCAST_SOURCES
    by = by.withColumnRenamed("source", "_source")
    j = sized.join(F.broadcast(by) if few else by, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return j.withColumn("copies", copies(F.col("target"), F.col("source_size"), draw_key()))
