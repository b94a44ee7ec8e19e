"""Typed metadata predicates as data (one per row of queries).

A predicate is an array of nodes, children before parents, the last one the root; so it is a column like any
other, can differ from query to query, and is evaluated by built-in expressions.  Leaves look at one
key of a ``map<string,string>``: ``eq``, ``regex`` (a search, as ``rlike``), ``range`` (numbers, both ends included, a
null end open) and ``near`` (great-circle kilometres from a point, latitude and longitude in two keys).
A key that is missing, or no number where one is needed, does not match.  ``and``, ``or`` and ``not`` combine.
An empty or null predicate matches everything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE = ("struct<kind:string,key:string,text:string,low:double,high:double,lat:double,lon:double,km:double,of:array<int>>")
PREDICATE = f"array<{NODE}>"
FIELDS = ("kind", "key", "text", "low", "high", "lat", "lon", "km", "of")
EARTH_KM = 6371.0


def _node(kind: str, **given) -> list[dict]:
    return [{**dict.fromkeys(FIELDS), "kind": kind, **given}]


def eq(key: str, value: str) -> list[dict]:
    return _node("eq", key=key, text=value)


def regex(key: str, pattern: str) -> list[dict]:
    return _node("regex", key=key, text=pattern)


def between(key: str, low: float | None = None, high: float | None = None) -> list[dict]:
    return _node("range", key=key, low=None if low is None else float(low), high=None if high is None else float(high))


def near(lat_key: str, lon_key: str, lat: float, lon: float, km: float) -> list[dict]:
    return _node("near", key=lat_key, text=lon_key, lat=float(lat), lon=float(lon), km=float(km))


def _join(kind: str, parts: tuple[list[dict], ...]) -> list[dict]:
    out, roots = [], []
    for p in parts:
        out += [{**n, "of": None if n["of"] is None else [i + len(out) for i in n["of"]]} for n in p]
        roots.append(len(out) - 1)
    return out + _node(kind, of=roots)


def all_of(*parts: list[dict]) -> list[dict]:
    return _join("and", parts)


def any_of(*parts: list[dict]) -> list[dict]:
    return _join("or", parts)


def none_of(*parts: list[dict]) -> list[dict]:
    return _join("not", (any_of(*parts),))


def literal(predicate: list[dict]) -> Column:
    """A predicate as a constant column."""
    nodes = [F.struct(*[(F.array(*map(F.lit, n[f])) if f == "of" and n[f] else F.lit(None) if f == "of" else F.lit(n[f])).alias(f) for f in FIELDS]) for n in predicate]
    return (F.array(*[n.cast(NODE) for n in nodes]) if nodes else F.array()).cast(PREDICATE)


def distance_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance (haversine) of two points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def matches(metadata: Column, predicate: Column) -> Column:
    """Whether a metadata map satisfies a predicate column."""
    value = lambda key: F.element_at(metadata, key)
    number = lambda key: value(key).try_cast("double")

    def one(acc: Column, n: Column) -> Column:
        v = number(n["key"])
        found = (F.when(n["kind"] == "eq", value(n["key"]) == n["text"])
                 .when(n["kind"] == "regex", F.regexp_like(value(n["key"]), n["text"]))
                 .when(n["kind"] == "range", v.isNotNull() & ~F.isnan(v) & (n["low"].isNull() | (v >= n["low"])) & (n["high"].isNull() | (v <= n["high"])))
                 .when(n["kind"] == "near", distance_km(n["lat"], n["lon"], v, number(n["text"])) <= n["km"])
                 .when(n["kind"] == "and", F.forall(n["of"], lambda i: F.get(acc, i)))
                 .when(n["kind"] == "or", F.exists(n["of"], lambda i: F.get(acc, i)))
                 .when(n["kind"] == "not", ~F.get(acc, F.get(n["of"], F.lit(0)))))
        return F.array_append(acc, F.coalesce(found, F.lit(False)))

    root = F.aggregate(predicate, F.array().cast("array<boolean>"), one, lambda acc: F.element_at(acc, -1))
    return F.when(F.coalesce(F.size(predicate), F.lit(0)) > 0, root).otherwise(F.lit(True))


def may_match(predicate: list[dict], stats: dict) -> bool:
    """Whether rows with these statistics can satisfy a predicate: ``stats[key]`` is (least, largest, rows
    with a number, rows) of a numeric key; keys without statistics may hold anything."""
    out: list[tuple[bool, bool]] = []                     # can be true, can be false
    for n in predicate:
        kind = n["kind"]
        if kind in ("and", "or"):
            some = [out[i] for i in n["of"]]
            fold, other = (all, any) if kind == "and" else (any, all)
            out.append((fold(t for t, _ in some), other(f for _, f in some)))
        elif kind == "not":
            t, f = out[n["of"][0]]
            out.append((f, t))
        elif kind == "range" and n["key"] in stats:
            least, most, numbers, rows = stats[n["key"]]
            if not numbers:
                out.append((False, True))
                continue
            low, high = -math.inf if n["low"] is None else n["low"], math.inf if n["high"] is None else n["high"]
            out.append((least <= high and most >= low, numbers < rows or least < low or most > high))
        elif kind == "near" and n["key"] in stats:
            least, most, numbers, _ = stats[n["key"]]
            # kilometres from the circle of latitude: longitudes are left alone
            apart = max(0.0, least - n["lat"], n["lat"] - most) if numbers else math.inf
            out.append((math.radians(apart) * EARTH_KM <= n["km"] + 1e-6, True))
        else:
            out.append((True, True))
    return out[-1][0] if out else True
