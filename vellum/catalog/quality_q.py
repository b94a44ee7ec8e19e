"""Validation and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as L
from ..operators import quality as Q
from ..operators.knn import knn_join
from ..plans.index import build_index, library_report
from ..sources import tables
from . import register
from .common import degenerate_chunks, degenerate_sql, r6, sql_cos, with_chunks

_LIBS = "libs AS (SELECT DISTINCT library_id FROM docs)"


@register("empty_report", with_chunks("""
SELECT l.library_id,
       CAST(coalesce(x.n_chunks, 0) AS BIGINT) AS n_chunks,
       CAST(coalesce(x.n_empty, 0) AS BIGINT) AS n_empty,
       coalesce(x.first_empty, '') AS first_empty,
       coalesce(x.dims, '') AS dims
FROM libs l LEFT JOIN (
  SELECT library_id, count(*) AS n_chunks,
         sum(CASE WHEN len(embedding) = 0 THEN 1 ELSE 0 END) AS n_empty,
         array_to_string(list_slice(list_sort(list(chunk_id) FILTER (WHERE len(embedding) = 0)), 1, 5), ', ')
           AS first_empty,
         array_to_string(list_sort(list(DISTINCT len(embedding)) FILTER (WHERE len(embedding) > 0)), ',') AS dims
  FROM deg GROUP BY library_id) x ON x.library_id = l.library_id""",
    f"{_LIBS}, deg AS ({degenerate_sql(True, True)})"))
def empty_report(spark, sf):
    """V1 + V2 + A1 + A2: per library, chunk count, empty vectors and the
    first five of their ids, and the distinct dimensions."""
    c = tables.corpus(spark, sf)
    r = library_report(degenerate_chunks(spark, sf), c.libraries)
    return r.select("library_id", "n_chunks", "n_empty",
                    F.coalesce(F.col("first_empty"), F.lit("")).alias("first_empty"),
                    F.array_join("dims", ",").alias("dims"))


@register("dim_census", with_chunks("""
SELECT library_id, array_to_string(list_sort(list(DISTINCT len(embedding))), ',') AS dims,
       CAST(count(DISTINCT len(embedding)) AS BIGINT) AS n_dims,
       count(DISTINCT len(embedding)) > 1 AS inconsistent
FROM deg WHERE len(embedding) > 0 GROUP BY library_id""", f"deg AS ({degenerate_sql(False, True)})"))
def dim_census(spark, sf):
    """V2/A2: distinct dimensions per library; more than one is an error."""
    r = library_report(degenerate_chunks(spark, sf, toxic=False, short=True))
    return r.select("library_id", F.array_join("dims", ",").alias("dims"),
                    F.size("dims").cast("bigint").alias("n_dims"),
                    (F.size("dims") > 1).alias("inconsistent"))


@register("dim_mismatch", with_chunks(
    "SELECT chunk_id, 64 AS expected_dim, CAST(len(embedding) AS INTEGER) AS actual_dim "
    "FROM deg WHERE len(embedding) <> 64", f"deg AS ({degenerate_sql(True, True)})"))
def dim_mismatch(spark, sf):
    """V3: vectors whose length is not the declared 64."""
    r = Q.dimension_mismatch(degenerate_chunks(spark, sf), 64)
    return r.select("chunk_id", "expected_dim", "actual_dim")


@register("k_rejects", with_chunks(
    "SELECT chunk_id AS query_id, CAST(CAST(label AS INTEGER) * 15 - 10 AS INTEGER) AS k FROM chunks "
    "WHERE CAST(label AS INTEGER) * 15 - 10 NOT BETWEEN 1 AND 100"))
def k_rejects(spark, sf):
    """V5: k outside 1..100 (k = 15*label - 10)."""
    q = tables.queries(spark, sf, k=10, filter_keys=("label",))
    q = q.withColumn("k", (F.element_at("filters", "label").cast("int") * 15 - 10).cast("int"))
    return Q.k_rejects(q).select("query_id", "k")


@register("null_report", with_chunks(
    "SELECT c.chunk_id, 'null_vector' AS problem FROM chunks c "
    "JOIN labels l ON CAST(l.doc_id AS VARCHAR) = c.document_id WHERE l.toxic = 1"))
def null_report(spark, sf):
    """V6: vectors withheld (NULL) for toxic-labelled documents are reported."""
    c = tables.chunks(spark, sf)
    lab = tables.read_table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("document_id"), "toxic")
    v = c.join(lab, "document_id", "left").select(
        "chunk_id", F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("embedding")).alias("vec"))
    return Q.null_report(v, "chunk_id", "vec").select("chunk_id", "problem")


def _labelled_documents(spark, sf):
    docs = tables.documents(spark, sf)
    lab = tables.read_table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    return docs.join(lab, "document_id", "left_semi")


@register("orphans", with_chunks(
    "SELECT 'Document' AS resource_type, c.document_id AS resource_id, c.chunk_id FROM chunks c "
    "WHERE c.document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"))
def orphans(spark, sf):
    """V7: chunks whose document is missing (the parent set is the labelled
    documents), reported as resource_type/resource_id."""
    r = Q.orphans(tables.chunks(spark, sf), _labelled_documents(spark, sf),
                  ["library_id", "document_id"], "Document", "document_id")
    return r.select("resource_type", "resource_id", "chunk_id")


@register("with_parent", with_chunks(
    "SELECT c.chunk_id, c.document_id FROM chunks c "
    "WHERE c.document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"))
def with_parent(spark, sf):
    """V7 accepted side: chunks whose parent document exists."""
    r = Q.with_parent(tables.chunks(spark, sf), _labelled_documents(spark, sf), ["library_id", "document_id"])
    return r.select("chunk_id", "document_id")


@register("duplicates", with_chunks("""
SELECT library_id, document_id, 'in_batch' AS reason FROM chunks GROUP BY library_id, document_id
HAVING count(*) > 1
UNION ALL
SELECT DISTINCT c.library_id, c.document_id, 'exists' AS reason FROM chunks c
WHERE c.document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"""))
def duplicates(spark, sf):
    """V8: a batch keyed by (library_id, document_id) built from the chunks:
    keys repeated in the batch, and keys already stored (labelled documents)."""
    batch = tables.chunks(spark, sf).select("library_id", "document_id")
    return Q.duplicate_keys(batch, ["library_id", "document_id"], _labelled_documents(spark, sf)) \
        .select("library_id", "document_id", "reason")


@register("not_indexed", with_chunks("""
SELECT q.chunk_id AS query_id, q.library_id, 'not_indexed' AS reason
FROM chunks q WHERE q.library_id IN (
  SELECT library_id FROM deg GROUP BY library_id HAVING sum(CASE WHEN len(embedding) = 0 THEN 1 ELSE 0 END) > 0)""",
    f"deg AS ({degenerate_sql(True, False)})"))
def not_indexed(spark, sf):
    """V9: queries against libraries that have no index (their strict build
    was refused because of empty vectors)."""
    c = tables.corpus(spark, sf)
    b = build_index(degenerate_chunks(spark, sf, toxic=True, short=False), c.libraries, mode="strict")
    q = tables.queries(spark, sf)
    return Q.not_indexed(q, b.meta, c.libraries).select("query_id", "library_id", "reason")


@register("non_empty_vectors", with_chunks(
    "SELECT chunk_id FROM deg WHERE len(embedding) > 0", f"deg AS ({degenerate_sql(True, False)})"))
def non_empty_vectors(spark, sf):
    """rows with a non-empty vector."""
    return Q.non_empty_vectors(degenerate_chunks(spark, sf, toxic=True, short=False)).select("chunk_id")


@register("lookup_chunks", with_chunks(
    "SELECT c.chunk_id, c.document_id, c.text FROM chunks c "
    "WHERE c.document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"))
def lookup_chunks(spark, sf):
    """F5 for a table of keys: chunks of the labelled documents."""
    keys = tables.read_table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    return L.lookup(tables.chunks(spark, sf), keys, ["document_id"]).select("chunk_id", "document_id", "text")


@register("found_flags", with_chunks(
    "SELECT DISTINCT CAST(l.doc_id AS VARCHAR) AS chunk_id, "
    "CAST(l.doc_id AS VARCHAR) IN (SELECT chunk_id FROM chunks) AS found FROM labels l"))
def found_flags(spark, sf):
    """Existence flags for requested chunk ids (the labelled doc ids used
    as chunk ids; some exist, some do not)."""
    keys = tables.read_table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"))
    return L.found_flags(keys, tables.chunks(spark, sf), ["chunk_id"])


@register("list_documents", with_chunks("SELECT library_id, document_id, doc_pos FROM docs"))
def list_documents(spark, sf):
    """documents of every library in position order."""
    return L.list_documents(tables.documents(spark, sf)).select("library_id", "document_id", "doc_pos")


@register("list_chunks", with_chunks("SELECT library_id, document_id, chunk_pos, chunk_id FROM chunks"))
def list_chunks(spark, sf):
    """chunks of every document in position order."""
    return L.list_chunks(tables.chunks(spark, sf)).select("library_id", "document_id", "chunk_pos", "chunk_id")


@register("drop_stale", with_chunks(f"""
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (
  SELECT q.chunk_id AS query_id, c.chunk_id, c.document_id,
         {sql_cos('q.embedding', 'c.embedding')} AS score,
         row_number() OVER (PARTITION BY q.chunk_id ORDER BY {sql_cos('q.embedding', 'c.embedding')} DESC,
                            c.chunk_id) AS rank
  FROM chunks q JOIN chunks c ON c.library_id = q.library_id) r
WHERE rank <= 10 AND document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"""))
def drop_stale(spark, sf):
    """top 10 from an index built before the chunks of toxic-labelled
    documents were deleted; hits on deleted chunks vanish."""
    c = tables.corpus(spark, sf)
    b = build_index(c.chunks, c.libraries)
    hits = knn_join(b.index, tables.queries(spark, sf), k=10)
    toxic = tables.read_table(spark, sf, "labels").filter("toxic = 1").select(
        F.col("doc_id").cast("string").alias("document_id"))
    live = c.chunks.join(toxic, "document_id", "left_anti")
    return L.drop_stale(hits, live).select("query_id", "rank", "chunk_id", r6())
