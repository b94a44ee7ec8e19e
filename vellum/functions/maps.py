"""Map and metadata predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def metadata_matches(metadata: Column | str, filters: Column | str) -> Column:
    """every (key, value) of ``filters`` is present in ``metadata`` with
    an equal value.  A missing key gives NULL from ``element_at``, and the
    null-safe ``<=>`` turns that into false; an empty or NULL filter map
    matches everything (``forall`` over an empty array is true)."""
    f = F.coalesce(_c(filters), F.create_map().cast("map<string,string>"))
    m = _c(metadata)
    return F.forall(F.map_entries(f), lambda e: F.element_at(m, e["key"]).eqNullSafe(e["value"]))


def metadata_equals(metadata: Column | str, key: str, value: str) -> Column:
    """F1 for one constant pair (pushes down like any constant predicate)."""
    return F.element_at(_c(metadata), key).eqNullSafe(F.lit(value))


def map_has(metadata: Column | str, key: str) -> Column:
    """Key presence."""
    return F.map_contains_key(_c(metadata), F.lit(key))
