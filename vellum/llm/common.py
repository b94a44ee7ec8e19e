"""Helpers shared by the operators of this subpackage."""

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, prepare
from ..sources import fs

#: Words are runs of anything but ASCII blanks (space, tab to carriage return).
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch handed to a Python worker; texts may be very long.
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20


_HELD: dict[str, dict] = {}


def held(operator: str) -> dict:
    """What this Python worker keeps for later tasks of an operator.  Workers outlive a stage: what it kept
    for other operators is let go."""
    for other in [o for o in _HELD if o != operator]:
        del _HELD[other]
    return _HELD.setdefault(operator, {})


def ready(spark: SparkSession) -> None:
    """Ship the package, make sure a checkpoint folder is set, and keep Arrow
    batches small enough for long texts."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: later
    steps neither recompute it nor lose it with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Intermediate tables of one job, as Parquet in the shared checkpoint folder: each is computed once
    and read where it is, and one that is superseded can be removed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}", []

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Removes tables that nothing reads any more."""
        for i, (df, path) in enumerate(self.paths):
            if df is not None and any(df is t for t in tables):
                fs.remove(self.spark, path)
                self.paths[i] = (None, path)


def words(text) -> "F.Column":
    """The words of ``text`` (null: none) as an array column."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def word_count(text):
    return F.size(words(text)).cast("long")


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo ``n`` (null ids: crc32 of '')."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(df: DataFrame, rows: int, total: int | None = None, seed: int = 17) -> DataFrame:
    """About ``rows`` rows chosen at random over the whole of ``df`` (all of
    them when there are fewer), never more than twice as many."""
    n = df.count() if total is None else total
    if n <= rows:
        return df
    return df.sample(fraction=min(1.0, rows / n), seed=seed).limit(2 * rows)


def sampled(df: DataFrame, rows: int, seed: int = 17) -> DataFrame:
    """About ``rows`` different rows of ``df``, drawn by a hash of all columns (all, when there are no
    more): the same ones whatever the partitioning and order of the rows, and after a retry.  A row that repeats
    counts once."""
    n = df.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1 << 30))
    return (df if n <= rows else df.filter(draw < math.ceil(rows / n * (1 << 30)))).distinct()


def blocks_for(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))
