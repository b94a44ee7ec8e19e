"""Search under typed metadata predicates: regular expressions, numeric ranges, distances."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..plans import where
from ..plans.index import build_index
from ..plans.search import search
from ..session import stored
from ..sources import tables
from ..sources.snapshot import scratch_root
from . import register
from .common import r6, sql_cos, with_chunks

#: By the label of the query: what its hits have to satisfy.
TREES = {
    0: P.all_of(P.regex("lang", "^(en|de)$"), P.between("size", 20, 400)),
    1: P.any_of(P.near("lat", "lon", 0.0, 0.0, 3000.0), P.between("size", None, 30)),
    2: P.all_of(P.none_of(P.regex("lang", "^e")), P.near("lat", "lon", 5.0, -10.0, 9000.0)),
    3: P.all_of(P.any_of(P.eq("lang", "fr"), P.between("size", 50)), P.none_of(P.near("lat", "lon", 0.0, 0.0, 500.0))),
}
_OTHER = P.between("size", 10)


def _inputs(spark, sf):
    """Chunks with the size of their text, and two components of their vector as a place, in the metadata; and every chunk as a query
    whose predicate goes by its label."""
    c = tables.corpus(spark, sf)
    more = F.map_from_arrays(F.array(*map(F.lit, ("size", "lat", "lon"))), F.array(
        F.char_length(F.coalesce("text", F.lit(""))).cast("string"), (F.col("embedding")[0].cast("double") * 90).cast("string"),
        (F.col("embedding")[1].cast("double") * 180).cast("string")))
    chunks = c.chunks.withColumn("metadata", F.map_concat("metadata", more))
    label = F.element_at("metadata", "label").cast("int")
    tree = F
    for value, t in TREES.items():
        tree = tree.when(label == value, P.literal(t))
    q = chunks.select(F.col("chunk_id").alias("query_id"), "library_id", "embedding", F.lit(10).alias("k"), tree.otherwise(P.literal(_OTHER)).alias("predicate"))
    return c, chunks, q


_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(c.lat - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(c.lat)) * pow(sin(radians(c.lon - {lon}) / 2), 2))))"
_MATCH = f"""CASE q.label
    WHEN '0' THEN c.lang IN ('en', 'de') AND c.size BETWEEN 20 AND 400
    WHEN '1' THEN {_KM.format(lat='0.0', lon='0.0')} <= 3000 OR c.size <= 30
    WHEN '2' THEN c.lang NOT LIKE 'e%' AND {_KM.format(lat='5.0', lon='(-10.0)')} <= 9000
    WHEN '3' THEN (c.lang = 'fr' OR c.size >= 50) AND NOT {_KM.format(lat='0.0', lon='0.0')} <= 500
    ELSE c.size >= 10 END"""
_PLACES = """m AS (SELECT *, length(coalesce(text, '')) AS size, embedding[1] * 90 AS lat, embedding[2] * 180 AS lon FROM chunks),
pairs AS (SELECT q.chunk_id AS query_id, c.chunk_id, """ + sql_cos("q.embedding", "c.embedding") + f""" AS score, coalesce({_MATCH}, false) AS ok
          FROM m q JOIN m c ON q.library_id = c.library_id)"""


@register("search_where_after", with_chunks(
    "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pairs) "
    "WHERE rank <= 10 AND ok", _PLACES))
def search_where_after(spark, sf):
    """Post-filter: the top 10 of every query, and of those what its own predicate lets stand."""
    c, chunks, q = _inputs(spark, sf)
    b = build_index(c.chunks, c.libraries)
    return where.keep_matching(search(b.index, b.meta, chunks, q.drop("predicate")).hits, q).select("query_id", "rank", "chunk_id", r6())


@register("search_where_before", with_chunks(
    "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pairs WHERE ok) "
    "WHERE rank <= 10", _PLACES))
def search_where_before(spark, sf):
    """Pre-filter: the 10 best of the rows that satisfy each query's own predicate, read from files whose statistics
    allow a match."""
    c, chunks, q = _inputs(spark, sf)
    q = stored(q)
    b = build_index(c.chunks, c.libraries)
    root = scratch_root(spark, f"filterable-{uuid.uuid4().hex}")
    rows = b.index.drop("build_id").join(chunks.select("library_id", "chunk_id", "metadata"), ["library_id", "chunk_id"])
    where.write_filterable(rows, root, ["size", "lat", "lon"], "size", file_rows=50_000)
    some = where.read_filterable(spark, root, where.batch_predicates(q))
    return where.knn_where(some, q).select("query_id", "rank", "chunk_id", r6())
