"""Streaming, metrics and SQL-surface queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.sql import register_search_function
from ..operators.metrics import observed, timing_summary
from ..plans.index import build_index, read_index, write_index
from ..plans.search import search
from ..schema import QUERIES
from ..sources import tables
from ..sources.snapshot import scratch_root
from ..streaming import log
from ..streaming.corpus import EVENTS, corpus as stream_corpus_tables, corpus_stream
from ..streaming.ingest import ProgressLog, current_table, search_stream, stage_files, upsert_stream
from . import register
from .common import r6, sql_cos, with_chunks
from .knn_q import mean_vector


def _events_changes(df):
    return df.select("user_id", "ts", F.col("event_id").alias("seq"), "event_type", "value",
                     F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("upsert")).alias("op"))


_UPSERT_SQL = """
SELECT user_id, seq AS event_id, event_type, value FROM (
  SELECT user_id, event_id AS seq, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1 AND event_type <> 'error'"""


def _replayed(spark, sf) -> str:
    """The events table replayed as a change feed of per-user records (``error`` deletes the user), four
    files in mixed order, one file per micro-batch; the folder of the table after the stream drains."""
    root = scratch_root(spark, f"stream-{uuid.uuid4().hex}")
    ev = tables.read_table(spark, sf, "events")
    src = stage_files(ev, f"{root}/source", 4, "event_id")
    listener = ProgressLog()
    spark.streams.addListener(listener)
    try:
        q = upsert_stream(spark, src, ev.schema, f"{root}/table", ["user_id"], order_cols=("ts", "seq"),
                          checkpoint=f"{root}/checkpoint", to_changes=_events_changes, buckets=16)
        q.awaitTermination()
    finally:
        spark.streams.removeListener(listener)
    return f"{root}/table"


@register("stream_upsert", _UPSERT_SQL)
def stream_upsert(spark, sf):
    """M1: the change feed of the events; the newest version, merged on read from the batches' change files."""
    return current_table(spark, _replayed(spark, sf)).select("user_id", F.col("seq").alias("event_id"), "event_type", "value")


@register("stream_compacted", _UPSERT_SQL)
def stream_compacted(spark, sf):
    """M1: the same feed after the change files were folded into the base."""
    root = _replayed(spark, sf)
    log.compact(spark, root, force=True)
    return current_table(spark, root).select("user_id", F.col("seq").alias("event_id"), "event_type", "value")


def corpus_events(spark, sf):
    """A feed of documents and chunks.  Every labelled document is added; good ones are updated, toxic ones
    deleted, and added again when good; every chunk is added, of any document, and some are updated or deleted.  Changes of a
    document have numbers within a hundred of their own."""
    c = tables.corpus(spark, sf)
    lab = tables.read_table(spark, sf, "labels").groupBy(F.col("doc_id").cast("string").alias("document_id")).agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    own = F.col("document_id").cast("long") * 100
    renamed = F.transform_values("metadata", lambda k, v: F.concat(F.lit("upd-"), v))

    def doc(rows, op, at, metadata="metadata"):
        return rows.select((own + at).alias("seq"), F.lit("document").alias("kind"), F.lit(op).alias("op"), "library_id", "document_id",
                           F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("text"),
                           F.lit(None).cast("array<float>").alias("embedding"), (F.col(metadata) if isinstance(metadata, str) else metadata).alias("metadata"))

    def chunk(rows, op, at, text="text"):
        return rows.select((own + at).alias("seq"), F.lit("chunk").alias("kind"), F.lit(op).alias("op"), "library_id", "document_id", "chunk_id",
                           (F.col(text) if isinstance(text, str) else text).alias("text"), "embedding", "metadata")

    d = c.documents.join(lab, "document_id")
    label = F.element_at("metadata", "label").cast("int")
    parts = [doc(d, "add", 0), doc(d.filter("toxic = 1"), "delete", 50), doc(d.filter("toxic = 1 AND quality = 1"), "add", 55),
             doc(d.filter("quality = 1"), "update", 60, renamed), chunk(c.chunks, "add", F.col("chunk_pos") * 20 + 11),
             chunk(c.chunks.filter(label % 3 == 0), "update", 75, F.concat("text", F.lit(" [edited]"))), chunk(c.chunks.filter(label % 5 == 0), "delete", 80)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*[f.name for f in EVENTS.fields])


@register("stream_corpus", with_chunks("""
SELECT 'document' AS kind, document_id, NULL AS chunk_id, CASE WHEN quality = 1 THEN 'upd-' || lang ELSE lang END AS content
FROM d WHERE since IS NOT NULL
UNION ALL
SELECT 'chunk', c.document_id, c.chunk_id, md5(CASE WHEN CAST(c.label AS INTEGER) % 3 = 0 THEN c.text || ' [edited]' ELSE c.text END)
FROM chunks c JOIN d ON d.document_id = c.document_id AND d.library_id = c.library_id
WHERE 11 + 20 * c.chunk_pos > d.since AND CAST(c.label AS INTEGER) % 5 <> 0""", """lab AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
d AS (SELECT docs.*, quality, CASE WHEN toxic = 0 THEN 0 WHEN quality = 1 THEN 55 END AS since FROM docs JOIN lab USING (document_id))"""))
def stream_corpus(spark, sf):
    """M1 over U9-U14: a feed of document and chunk changes in shuffled order, four files, one per
    micro-batch; chunks wait in the stream's state for their document, deletes cascade; the corpus after it drains."""
    root = scratch_root(spark, f"corpus-{uuid.uuid4().hex}")
    src = stage_files(corpus_events(spark, sf), f"{root}/source", 4, "seq")
    corpus_stream(spark, src, f"{root}/corpus", checkpoint=f"{root}/checkpoint", buckets=16).awaitTermination()
    documents, chunks = stream_corpus_tables(spark, f"{root}/corpus")
    none = F.lit(None).cast("string")
    return documents.select(F.lit("document").alias("kind"), "document_id", none.alias("chunk_id"), F.element_at("metadata", "lang").alias("content")).unionByName(
        chunks.select(F.lit("chunk").alias("kind"), "document_id", "chunk_id", F.md5(F.col("text").cast("binary")).alias("content")))


@register("stream_search", with_chunks(
    "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 10 AND label = q_label",
    f"""ranked AS (
  SELECT q.chunk_id AS query_id, q.label AS q_label, c.chunk_id, c.label,
         {sql_cos('q.embedding', 'c.embedding')} AS score,
         row_number() OVER (PARTITION BY q.chunk_id ORDER BY {sql_cos('q.embedding', 'c.embedding')} DESC,
                            c.chunk_id) AS rank
  FROM chunks q JOIN chunks c ON c.library_id = q.library_id)"""))
def stream_search(spark, sf):
    """M2: every query arrives on a stream (four files, one per trigger) and
    each micro-batch runs the flagship search against the static index."""
    root = scratch_root(spark, f"qstream-{uuid.uuid4().hex}")
    c = tables.corpus(spark, sf)
    b = build_index(c.chunks, c.libraries)
    write_index(b, f"{root}/built")
    index, meta = read_index(spark, f"{root}/built")
    q = tables.queries(spark, sf, k=10, filter_keys=("label",)).select(*[f.name for f in QUERIES.fields])
    src = stage_files(q, f"{root}/source", 4, "query_id")
    qs = spark.read.parquet(src).schema

    def run(batch):
        return search(index, meta, c.chunks, batch).hits.select("query_id", "rank", "chunk_id", "score")

    s = search_stream(spark, src, qs, f"{root}/hits", run, checkpoint=f"{root}/checkpoint")
    s.awaitTermination()
    return spark.read.parquet(f"{root}/hits").select("query_id", "rank", "chunk_id", r6())


@register("observed_index_build", with_chunks(
    "SELECT CAST(count(*) AS BIGINT) AS n_indexed, "
    "CAST(min(len(embedding)) AS INTEGER) AS min_dim, CAST(max(len(embedding)) AS INTEGER) AS max_dim FROM chunks"))
def observed_index_build(spark, sf):
    """Metrics observed while the index is written (``df.observe``: the
    counts ride along the write, no second pass), returned as one row."""
    c = tables.corpus(spark, sf)
    b = build_index(c.chunks, c.libraries)
    rows, result = observed(b.index, "index_build", min_dim=F.min(F.size("vector")), max_dim=F.max(F.size("vector")))
    rows.write.mode("overwrite").parquet(scratch_root(spark, f"observed-{uuid.uuid4().hex}"))
    m = result()
    return spark.createDataFrame([(int(m["rows"]), int(m["min_dim"]), int(m["max_dim"]))],
                                 "n_indexed bigint, min_dim int, max_dim int")


@register("timing_summary", """
SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean,
       round(min(value), 6) AS least, round(max(value), 6) AS largest
FROM events GROUP BY event_type""")
def timing_summary_q(spark, sf):
    """Mean and range of the measured values of every kind of event."""
    t = timing_summary(tables.read_table(spark, sf, "events"), ["event_type"], "value")
    return t.select("event_type", F.col("n").cast("bigint").alias("n"), *[F.round(c, 6).alias(c) for c in ("mean", "least", "largest")])


@register("sql_search", with_chunks(f"""
SELECT library_id, rank, chunk_id, round(score, 6) AS score FROM (
  SELECT library_id, chunk_id, score,
         row_number() OVER (PARTITION BY library_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
WHERE rank <= 3""", """mean AS (
  SELECT list(m ORDER BY pos) AS mv FROM (
    SELECT pos, avg(x) AS m FROM (
      SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY pos)),
scored AS (SELECT c.chunk_id, c.library_id, """ + sql_cos("c.embedding", "mean.mv") + """ AS score
           FROM chunks c, mean)"""))
def sql_search(spark, sf):
    """The search as a SQL table function, called for every library with
    one query vector (the mean of all embeddings), k = 3."""
    c = tables.corpus(spark, sf)
    b = build_index(c.chunks, c.libraries)
    b.index.createOrReplaceTempView("vellum_index")
    c.libraries.createOrReplaceTempView("vellum_libraries")
    register_search_function(spark, "vellum_index")
    mv = mean_vector(spark, sf)
    arr = "array(" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in mv) + ")"
    return spark.sql(f"""
        SELECT l.library_id, CAST(s.rank AS BIGINT) AS rank, s.chunk_id, round(s.score, 6) AS score
        FROM vellum_libraries l, LATERAL search_library(l.library_id, {arr}, 3) s""")
