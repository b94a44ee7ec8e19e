"""Projection and reshaping of the corpus.

Nested form (one row per library, as in a snapshot)::

    library_id, metadata, documents: array<struct<id, metadata,
        chunks: array<struct<id, document_id, text, embedding, metadata>>>>

Flat form: the three tables of :mod:`vellum.schema`.  Order inside nested
lists is carried by explicit positions (``doc_pos``, ``chunk_pos``) and
restored with ``array_sort`` on ``(pos, ...)`` structs, never by trusting
``collect_list`` order.

Re-nesting is done at *document* granularity: a document row carries its
chunks.  The library level stays keyed (one row per document with its
library's id and metadata), so no single row or task ever holds a whole
library; :func:`renest_libraries` builds the one-row-per-library form for
export of libraries known to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh


def _empty_map():
    return F.create_map().cast("map<string,string>")


def _sort_by_pos(arr):
    """Sort an array of structs by ``(pos, id)`` (structs holding maps have no
    natural order, so the comparator names the keys)."""
    def cmp(a, b):
        return (F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1)
                .when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    return F.array_sort(arr, cmp)


# ---------------------------------------------------------------------------
# ids (R9, R10, C8)
# ---------------------------------------------------------------------------

def canonical_id(col) -> "F.Column":
    """UUID text in any case, dashed or not, as 32 lower-case hex."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_replace(c, "-", ""))


def dashed_id(col) -> "F.Column":
    """32-hex id back to the 8-4-4-4-12 dashed form."""
    c = canonical_id(col)
    return F.concat_ws("-", F.substring(c, 1, 8), F.substring(c, 9, 4), F.substring(c, 13, 4),
                       F.substring(c, 17, 4), F.substring(c, 21, 12))


def stable_id(*cols) -> "F.Column":
    """An id for a new row derived from its natural key (md5 hex, the
    UUID width), so a re-run or a retried task yields the same id; ``uuid()``
    would change on recomputation."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


# ---------------------------------------------------------------------------
# flatten (R1) and re-nest (R2)
# ---------------------------------------------------------------------------

def flatten(nested: DataFrame, keep_empty_documents: bool = True):
    """R1 (+R8): nested libraries to the three flat tables.

    Document positions come from ``posexplode``; a chunk's ``document_id`` is
    always its parent's (the parent wins, Q13).  Documents without chunks stay
    in ``documents`` (``explode_outer`` for counts), and give no chunk rows."""
    libs = nested.select("library_id", F.coalesce("metadata", _empty_map()).alias("metadata"))
    docs_x = nested.select("library_id", F.posexplode(F.coalesce(
        "documents", F.array().cast(nested.schema["documents"].dataType))).alias("doc_pos", "d"))
    docs = docs_x.select("library_id", F.col("d.id").alias("document_id"),
                         F.col("doc_pos").cast("long").alias("doc_pos"),
                         F.coalesce("d.metadata", _empty_map()).alias("metadata"))
    chunk_type = nested.schema["documents"].dataType.elementType["chunks"].dataType
    ch_x = docs_x.select("library_id", F.col("d.id").alias("document_id"),
                         F.posexplode(F.coalesce("d.chunks", F.array().cast(chunk_type)))
                         .alias("chunk_pos", "c"))
    chunks = ch_x.select("library_id", "document_id",
                         F.col("c.id").alias("chunk_id"),
                         F.col("chunk_pos").cast("long").alias("chunk_pos"),
                         F.col("c.text").alias("text"),
                         F.col("c.embedding").alias("embedding"),
                         F.coalesce("c.metadata", _empty_map()).alias("metadata"))
    return libs, docs, chunks


def renest_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """R2: one row per document with its chunks in ``chunk_pos`` order; a
    document without chunks keeps an empty list (left join from documents).
    The row is one document."""
    packed = (chunks.groupBy("library_id", "document_id").agg(
        _sort_by_pos(F.collect_list(F.struct(
            F.col("chunk_pos").alias("pos"), F.col("chunk_id").alias("id"),
            "document_id", "text", "embedding", "metadata"))).alias("_c")))
    chunk_list = F.transform(F.col("_c"), lambda s: F.struct(
        s["id"].alias("id"), s["document_id"].alias("document_id"), s["text"].alias("text"),
        s["embedding"].alias("embedding"), s["metadata"].alias("metadata")))
    out = documents.join(packed, ["library_id", "document_id"], "left")
    empty = F.array().cast(out.select(chunk_list.alias("x")).schema["x"].dataType)
    return out.select("library_id", "document_id", "doc_pos", "metadata",
                      F.coalesce(chunk_list, empty).alias("chunks"))


def library_documents(libraries: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """R5 at document granularity: each nested document with its library's
    id and metadata, in ``doc_pos`` order within the library."""
    docs = renest_documents(documents, chunks)
    return (libraries.select("library_id", F.col("metadata").alias("library_metadata"))
            .join(docs, "library_id", "left")
            .select("library_id", "library_metadata", "doc_pos", "document_id",
                    F.col("metadata").alias("document_metadata"), "chunks"))


def renest_libraries(libraries: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per library holding all its documents in order (the
    snapshot shape), for export of a library that fits one row; no registered
    query uses it.  :func:`library_documents` is the scalable form."""
    docs = renest_documents(documents, chunks)
    packed = docs.groupBy("library_id").agg(_sort_by_pos(F.collect_list(F.struct(
        F.col("doc_pos").alias("pos"), F.col("document_id").alias("id"),
        "chunks", "metadata"))).alias("_d"))
    doc_list = F.transform(F.col("_d"), lambda s: F.struct(
        s["id"].alias("id"), s["chunks"].alias("chunks"), s["metadata"].alias("metadata")))
    out = libraries.join(packed, "library_id", "left")
    empty = F.array().cast(out.select(doc_list.alias("x")).schema["x"].dataType)
    return out.select("library_id", F.coalesce(doc_list, empty).alias("documents"), "metadata")


# ---------------------------------------------------------------------------
# projections (R3, R4, R6/R7 live in plans.search)
# ---------------------------------------------------------------------------

def project_chunk(chunks: DataFrame) -> DataFrame:
    """The chunk read form, without ``document_id``."""
    return chunks.select(F.col("chunk_id").alias("id"), "text", "embedding", "metadata")


def project_document(documents: DataFrame) -> DataFrame:
    """The document read form, without chunks."""
    return documents.select(F.col("document_id").alias("id"), "metadata")


def attach_parent(children: DataFrame, parent_col: str, parent_value) -> DataFrame:
    """Force the parent id of incoming rows (add, update and load)."""
    v = F.col(parent_value) if isinstance(parent_value, str) and parent_value in children.columns \
        else F.lit(parent_value)
    return children.withColumn(parent_col, v)


def conform(df: DataFrame, schema) -> DataFrame:
    """Select and cast to a declared schema (missing columns become NULL)."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType.simpleString()).alias(f.name))   # by name: nulls inside stay allowed
    return df.select(*cols)


def join_corpus(libraries: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Library ⋈ document ⋈ chunk on keys, one row per chunk with the
    metadata of its parents.  ``libraries`` is one row per library; Catalyst
    broadcasts it when its measured size allows and sort-merges otherwise."""
    d = documents.select("library_id", "document_id", "doc_pos",
                         F.col("metadata").alias("document_metadata"))
    l = libraries.select("library_id", F.col("metadata").alias("library_metadata"))
    return chunks.join(d, ["library_id", "document_id"]).join(l, "library_id")


def next_positions(existing: DataFrame, incoming: DataFrame, parent_cols: list[str],
                   pos_col: str, order_col: str) -> DataFrame:
    """Positions for appended rows: ``max(pos)`` of the parent among
    ``existing`` plus the incoming row's rank (by ``order_col``, then the
    row's id columns) among the parent's incoming rows.  The distributed
    ranking numbers keys alone; the rows' other columns join their number after."""
    from .rank import positions

    mx = existing.groupBy(*parent_cols).agg(F.max(pos_col).alias("_max"))
    ties = [c for c in ("document_id", "chunk_id") if c in incoming.columns and c not in parent_cols]
    keys = [*parent_cols, *ties]
    ranks = positions(incoming.select(*keys, order_col), [order_col, *ties], parent_cols, out="_rank")
    ranked = fresh(incoming).join(fresh(ranks.select(*keys, "_rank")), keys)
    return (ranked.join(mx, parent_cols, "left")
            .withColumn(pos_col, (F.coalesce("_max", F.lit(-1)) + F.col("_rank") + 1).cast("long"))
            .drop("_max", "_rank"))
