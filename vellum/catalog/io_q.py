"""Snapshot and source queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.vector import vec_norm
from ..sources import snapshot as S
from ..sources import tables
from ..sources.synthetic import gaussian_like
from . import register
from .common import with_chunks


@register("snapshot_roundtrip", with_chunks(
    "SELECT c.library_id, c.document_id, c.chunk_id, c.chunk_pos, d.doc_pos, c.text, "
    "CAST(len(c.embedding) AS BIGINT) AS dim, round(list_sum(c.embedding), 6) AS vsum, c.label, c.lang "
    "FROM chunks c JOIN docs d ON d.document_id = c.document_id AND d.library_id = c.library_id"))
def snapshot_roundtrip(spark, sf):
    """S2 then S1: write the corpus as a published snapshot version under the
    shared checkpoint folder, resolve the newest manifest, read it back and
    flatten; rows, order positions, texts and vectors must survive."""
    c = tables.corpus(spark, sf)
    root = S.scratch_root(spark, f"snapshots-{uuid.uuid4().hex}")
    S.write_snapshot(c.libraries, c.documents, c.chunks, root, version=1)
    libs, docs, chunks = S.read_snapshot(spark, S.latest_version(spark, root))
    j = chunks.join(docs.select("library_id", "document_id", "doc_pos"), ["library_id", "document_id"])
    return j.select("library_id", "document_id", "chunk_id", "chunk_pos", "doc_pos", "text",
                    F.size("embedding").cast("bigint").alias("dim"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
                    .alias("vsum"),
                    F.element_at("metadata", "label").alias("label"),
                    F.element_at("metadata", "lang").alias("lang"))


@register("snapshot_libraries", """
SELECT l.library_id, l.library_id AS name, CAST(count(d.doc_id) AS BIGINT) AS n_documents
FROM (SELECT DISTINCT source AS library_id FROM documents) l JOIN documents d ON d.source = l.library_id
GROUP BY l.library_id""")
def snapshot_libraries(spark, sf):
    """Libraries and their document counts after a snapshot round trip."""
    c = tables.corpus(spark, sf)
    root = S.scratch_root(spark, f"snapshots-{uuid.uuid4().hex}")
    S.write_snapshot(c.libraries, c.documents, c.chunks, root, version=7)
    libs, docs, _ = S.read_snapshot(spark, S.latest_version(spark, root))
    n = docs.groupBy("library_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_documents"))
    return libs.join(n, "library_id").select("library_id", F.element_at("metadata", "name").alias("name"),
                                             "n_documents")


@register("serialize_documents", """
SELECT CAST(doc_id AS VARCHAR) AS document_id,
       json_object('document_id', md5(text), 'lang', lang, 'source', source) :: VARCHAR AS json
FROM documents""")
def serialize_documents(spark, sf):
    """S3: records with ids in canonical (undashed lower-case) form: the id
    is each text's md5 written dashed and upper-case, undashed on output."""
    d = tables.read_table(spark, sf, "documents")
    h = F.md5("text")
    dashed = F.upper(F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                                 F.substring(h, 17, 4), F.substring(h, 21, 12)))
    rows = d.select(F.col("doc_id").cast("string").alias("doc_key"), dashed.alias("document_id"), "lang", "source")
    rec = S.serialize_record(rows, ["document_id"], keep=["doc_key"])
    return rec.select(F.col("doc_key").alias("document_id"), "json")


@register("serialize_events", """
SELECT event_id, json_object('event_id', event_id, 'ts', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'),
                             'user_id', user_id, 'event_type', event_type, 'value', value, 'props', props) :: VARCHAR AS json
FROM events""")
def serialize_events(spark, sf):
    """S3: timestamps as ISO-8601 text inside JSON records."""
    e = tables.read_table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    rec = S.serialize_record(e.withColumn("_k", F.col("event_id")), [], ["ts"], keep=["_k"])
    return rec.select(F.col("_k").alias("event_id"), "json")


@register("synthetic_vectors", """
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, 1.0::DOUBLE AS norm FROM embeddings""")
def synthetic_vectors(spark, sf):
    """A seeded Gaussian unit vector for every embedding row, of the
    same dimension; norms are 1 (a stand-in workload shaped like the table)."""
    e = tables.read_table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("_d"))
    g = gaussian_like(e, "vec_id", F.col("_d"), seed=42)
    return g.select("vec_id", F.size("embedding").cast("bigint").alias("dim"),
                    F.round(vec_norm("embedding"), 5).alias("norm"))
