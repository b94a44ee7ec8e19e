"""Vector scalar functions as Catalyst expressions.

All arithmetic is in double.  Every function is a pure Column expression built
from higher-order functions, so it stays inside whole-stage codegen, works in
SQL (see :mod:`vellum.functions.sql`) and never calls Python.

Zero vectors are guarded explicitly: with ANSI mode on, a division by zero
raises instead of returning NULL.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal_vector(values: Sequence[float]) -> Column:
    """A constant array<double> (e.g. one query vector)."""
    return F.array(*[F.lit(float(v)) for v in values])


def vec_size(v: ColumnOrName) -> Column:
    """Number of components (NULL for a NULL vector)."""
    return F.size(_c(v))


def sum_squares(v: ColumnOrName) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def vec_norm(v: ColumnOrName) -> Column:
    """Euclidean length in double."""
    return F.sqrt(sum_squares(v))


def inv_norm(v: ColumnOrName) -> Column:
    """1/|v|, and 0 for the zero or empty vector (so its scores come out 0)."""
    n = vec_norm(v)
    return F.when(n > 0, F.lit(1.0) / n).otherwise(F.lit(0.0))


def vec_normalize(v: ColumnOrName) -> Column:
    """v/|v| as array<double>; the zero vector stays zero.

    The norm is computed once per row: ``aggregate``'s finish function gets
    the sum of squares as a bound variable, so the division inside
    ``transform`` does not recompute it per component (an O(d^2) trap)."""
    col = _c(v)

    def finish(ssq):
        return F.transform(col, lambda x: F.when(ssq > 0, x.cast("double") / F.sqrt(ssq))
                           .otherwise(x.cast("double")))

    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"), finish)


def vec_dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Dot product in double.  Vectors must have equal length (checked by
    the dimension validators); unequal lengths give NULL, not a wrong number."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine_sim(a: ColumnOrName, b: ColumnOrName) -> Column:
    """C4: cosine similarity; 0 when either side is a zero vector."""
    return vec_dot(a, b) * inv_norm(a) * inv_norm(b)


def cosine_dist(a: ColumnOrName, b: ColumnOrName) -> Column:
    """1 - cosine similarity."""
    return F.lit(1.0) - cosine_sim(a, b)


def has_non_finite(vec: Column | str) -> Column:
    """Whether a vector holds a null, NaN or infinite component (false for a null vector)."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
