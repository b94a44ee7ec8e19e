"""Seeded Gaussian unit vectors, as a Spark source.

Each component is a function of ``(seed, row id, component index)`` only
(two xxhash64 uniforms through Box-Muller), so the data is the same for any
number of partitions, on any retry, and needs no driver-side generator.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import vec_normalize

_TWO53 = float(2 ** 53)


def _uniform(seed: int, row: Column, i: Column, salt: int) -> Column:
    h = F.xxhash64(F.lit(seed), row, i, F.lit(salt))
    return (F.pmod(h, F.lit(2 ** 53)).cast("double") + 0.5) / F.lit(_TWO53)


def gaussian_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42,
                     num_partitions: int | None = None, unit: bool = True) -> DataFrame:
    """``n`` rows ``(id, embedding array<float>)`` of standard normal
    components, normalised to unit length when ``unit``."""
    df = spark.range(0, n, numPartitions=num_partitions) if num_partitions else spark.range(0, n)
    return gaussian_like(df, "id", dim, seed, unit)


def gaussian_like(df: DataFrame, id_col: str, dim: int | Column, seed: int = 42, unit: bool = True) -> DataFrame:
    """Add ``embedding`` (seeded Gaussian) to each row of ``df`` keyed by
    ``id_col``; ``dim`` may be a column (e.g. the size of another vector)."""
    d = F.lit(dim) if isinstance(dim, int) else dim
    row = F.col(id_col)

    def comp(i):
        u1 = _uniform(seed, row, i, 1)
        u2 = _uniform(seed, row, i, 2)
        return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)

    # the raw draw gets its own column so normalising does not re-draw it
    raw = df.withColumn("_raw", F.transform(F.sequence(F.lit(0), d - 1), comp))
    emb = vec_normalize("_raw") if unit else F.col("_raw")
    return raw.withColumn("embedding", emb.cast("array<float>")).drop("_raw")
