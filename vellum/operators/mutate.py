"""Keyed mutation as pure functions.

The reference mutates dictionaries one request at a time.  Here a change is a
*table* of requests and each operator maps ``(current tables, changes)`` to
new tables, which a caller publishes as a new version (see
:mod:`vellum.sources.snapshot`).  Every operator is joins and unions on keys:
``left_anti`` removes replaced or deleted keys, ``left_semi`` gates on
existence, ``unionByName`` adds.  No operator collects a key group.

Requests inside one batch that touch the same key: the one with the highest
``seq`` wins when a ``seq`` column is present (a change feed).  Without one, or where
different rows share the highest, such keys are rejected (V8), since a batch has no order of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh, stored
from .reshape import next_positions

LIB = ["library_id"]
DOC = ["library_id", "document_id"]
CHUNK = ["library_id", "document_id", "chunk_id"]


@dataclass
class Corpus3:
    libraries: DataFrame
    documents: DataFrame
    chunks: DataFrame
    #: Keys that :func:`add_libraries` left out, as report rows.
    rejects: DataFrame | None = None


@dataclass
class Applied:
    table: DataFrame
    rejects: DataFrame


def latest_per_key(changes: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """Keep the last change per key by ``order_cols`` (``max_by`` over a
    struct: a partial aggregate, so a hot key costs one row per task)."""
    payload = [c for c in changes.columns if c not in keys]
    agg = changes.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*order_cols)).alias("_p"))
    return agg.select(*keys, *[F.col("_p")[c].alias(c) for c in payload])


def _digest(batch: DataFrame, payload: list[str]):
    """Equal for rows equal in ``payload``; maps count by their sorted entries."""
    kinds = dict(batch.dtypes)
    flat = [(F.array_sort(F.map_entries(c)) if kinds[c].startswith("map") else F.col(c)).alias(c) for c in payload]
    return F.md5(F.to_json(F.struct(*flat)).cast("binary")) if payload else F.lit("")


def content_hash(batch: DataFrame, payload: list[str]):
    """64 bits, equal for rows equal in ``payload``."""
    return F.xxhash64(_digest(batch, payload))


def gate(batch: DataFrame, keys: list[str], equal_once: bool = False) -> tuple[DataFrame, DataFrame]:
    """The shared check of every batch: one row per key goes on.  With a ``seq``
    column the highest wins; rows that share it count as one where they are equal, and are
    ambiguous where they differ: none of the key's rows goes on.  Without ``seq``, a key given twice is
    ambiguous, or with ``equal_once`` only where its rows differ.  Returns
    (rows, keys rejected).  One aggregation, whose partial step leaves a repeated
    key one row per task."""
    payload = [c for c in batch.columns if c not in keys]
    if "seq" in batch.columns:
        # the greatest and the least content among the rows of the highest seq
        hashed = batch.withColumn("_h", content_hash(batch, payload)).withColumn("_not_h", F.bitwise_not("_h"))
        one = hashed.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct("seq", "_h")).alias("_p"),
                                        F.max(F.struct("seq", "_h"))["_h"].alias("_high"), F.max(F.struct("seq", "_not_h"))["_not_h"].alias("_low"))
        fine = F.col("_high") == F.bitwise_not("_low")
        clean = one.filter(fine).select(*keys, *[F.col("_p")[c].alias(c) for c in payload])
        return clean.select(*batch.columns), one.filter(~fine).select(*keys)
    digest = _digest(batch, payload)
    same = [F.min(digest).alias("_low"), F.max(digest).alias("_high")] if equal_once else []
    one = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *same, *([F.first(F.struct(*payload)).alias("_p")] if payload else []))
    fine = F.col("_low") == F.col("_high") if equal_once else F.col("_n") == 1
    clean = one.filter(fine).select(*keys, *[F.col("_p")[c].alias(c) for c in payload])
    return clean.select(*batch.columns), one.filter(~fine).select(*keys)


def _gated_keys(batch: DataFrame, keys: list[str], order_col: str) -> tuple[DataFrame, DataFrame]:
    """:func:`gate` by keys and hashes alone, written once: (keys that go on with ``order_col`` and, where there is a
    ``seq``, what tells their row: ``_seq``, ``_h``; keys rejected)."""
    payload = [c for c in batch.columns if c not in keys]
    order = F.col(order_col) if order_col in batch.columns else F.lit(0)
    if "seq" in batch.columns:
        x = batch.select(*keys, F.col("seq").alias("_seq"), content_hash(batch, payload).alias("_h"), order.alias("_o")).withColumn("_not_h", F.bitwise_not("_h"))
        top = F.struct("_seq", "_h")
        one = x.groupBy(*keys).agg(F.max(top).alias("_top"), F.max_by("_o", top).alias(order_col), F.max(F.struct("_seq", "_not_h"))["_not_h"].alias("_low"))
        one = one.select(*keys, order_col, F.col("_top._seq").alias("_seq"), F.col("_top._h").alias("_h"),
                         (F.col("_top._h") == F.bitwise_not("_low")).alias("_fine"))
    else:
        one = batch.select(*keys, order.alias("_o")).groupBy(*keys).agg(F.first("_o").alias(order_col), (F.count(F.lit(1)) == 1).alias("_fine"))
    one = stored(one)
    return one.filter("_fine").drop("_fine"), one.filter("NOT _fine").select(*keys)


def _twice(rejected: DataFrame, rtype: str, id_col: str) -> DataFrame:
    """Keys that :func:`gate` rejected, as report rows (``Duplicate...``)."""
    return rejected.select(F.lit(f"Duplicate{rtype}").alias("resource_type"), F.col(id_col).alias("resource_id"))


# ---------------------------------------------------------------------------
# vectors (U1-U4, J4)
# ---------------------------------------------------------------------------

def upsert_vectors(existing: DataFrame, new: DataFrame, keys: list[str], overwrite: bool) -> Applied:
    """Add vectors by key.  ``overwrite=True`` replaces stored keys;
    ``False`` rejects keys already stored (DuplicateVector)."""
    clean, twice = gate(new, keys)
    clean = clean.select(*existing.columns)
    rejects = new.select(*existing.columns).join(twice, keys, "left_semi").withColumn("reason", F.lit("duplicate_in_batch"))
    new = clean
    if overwrite:
        out = existing.join(new.select(*keys), keys, "left_anti").unionByName(new)
        return Applied(out, rejects)
    clash = new.join(existing.select(*keys), keys, "left_semi").withColumn("reason", F.lit("duplicate_id"))
    fresh = new.join(existing.select(*keys), keys, "left_anti")
    return Applied(existing.unionByName(fresh), rejects.unionByName(clash))


def append_unseen(existing: DataFrame, new: DataFrame, keys: list[str], report: bool = False) -> DataFrame | Applied:
    """Bulk build appends only ids not stored yet (stored rows win); an id
    given twice in ``new`` with different rows is not appended (:func:`gate`), equal rows
    count as one.  ``report=True`` returns the rows not appended for that as well."""
    clean, twice = gate(new, keys, equal_once=True)
    fresh = clean.select(*existing.columns).join(existing.select(*keys), keys, "left_anti")
    out = existing.unionByName(fresh)
    if not report:
        return out
    rejects = new.select(*existing.columns).join(twice, keys, "left_semi").withColumn("reason", F.lit("duplicate_in_batch"))
    return Applied(out, rejects)


def replace_partitions(existing: DataFrame, new: DataFrame, part_keys: list[str]) -> DataFrame:
    """Full replace of every partition (e.g. library) present in ``new``;
    partitions absent from ``new`` keep their rows, so an empty input leaves
    the old table.  Written with dynamic partition overwrite."""
    return existing.join(new.select(*part_keys).distinct(), part_keys, "left_anti").unionByName(new)


def remove_keys(existing: DataFrame, ids: DataFrame, keys: list[str]):
    """U4: delete by key; returns the new table and ``found`` flags."""
    req = ids.select(*keys).distinct()
    flags = (req.join(existing.select(*keys).distinct().withColumn("found", F.lit(True)), keys, "left")
             .withColumn("found", F.coalesce("found", F.lit(False))))
    return existing.join(req, keys, "left_anti"), flags


# ---------------------------------------------------------------------------
# libraries
# ---------------------------------------------------------------------------

def add_libraries(c: Corpus3, new: Corpus3) -> Corpus3:
    """Add libraries; a library id already present is replaced with all
    its documents and chunks.  A library, document or chunk given twice with different
    rows is ambiguous (:func:`gate`): it is left out, a library with all it holds, and
    reported in ``rejects`` of the result; equal rows count as one."""
    libraries, twice = gate(new.libraries, LIB, equal_once=True)
    libraries = libraries.select(*c.libraries.columns)
    ids = libraries.select(*LIB)
    rejects = _twice(twice, "Library", "library_id")
    parts = []
    for rows, keys, old, rtype in ((new.documents, DOC, c.documents, "Document"), (new.chunks, CHUNK, c.chunks, "Chunk")):
        clean, twice = gate(rows.join(ids, LIB, "left_semi"), keys, equal_once=True)
        parts.append(clean.select(*old.columns))
        rejects = rejects.unionByName(_twice(twice, rtype, keys[-1]))
    documents, chunks = parts
    return Corpus3(
        c.libraries.join(ids, LIB, "left_anti").unionByName(libraries),
        c.documents.join(ids, LIB, "left_anti").unionByName(documents),
        c.chunks.join(ids, LIB, "left_anti").unionByName(chunks),
        rejects,
    )


def replace_libraries_if_present(c: Corpus3, new: Corpus3):
    """Replace only libraries that exist; others are reported not found."""
    present = new.libraries.join(c.libraries.select(*LIB), LIB, "left_semi").select(*LIB)
    missing = (new.libraries.join(c.libraries.select(*LIB), LIB, "left_anti")
               .select(F.lit("Library").alias("resource_type"), F.col("library_id").alias("resource_id")))
    gate = Corpus3(new.libraries.join(present, LIB, "left_semi"),
                   new.documents.join(present, LIB, "left_semi"),
                   new.chunks.join(present, LIB, "left_semi"))
    return add_libraries(c, gate), missing


def patch_libraries(libraries: DataFrame, patch: DataFrame, report: bool = False) -> DataFrame | Applied:
    """Partial update; a NULL field keeps the stored value.  Patches for
    unknown libraries change nothing, nor do several different patches of one library
    without a ``seq`` (:func:`gate`); equal ones count as one.  ``report=True`` returns
    the libraries of such patches as well."""
    clean, twice = gate(patch, LIB, equal_once=True)
    p = clean.select("library_id", F.col("metadata").alias("_new_md"))
    out = (libraries.join(p, "library_id", "left")
           .select("library_id", F.coalesce("_new_md", "metadata").alias("metadata")))
    return Applied(out, _twice(twice, "Library", "library_id")) if report else out


def delete_libraries(c: Corpus3, ids: DataFrame, index: DataFrame | None = None,
                     meta: DataFrame | None = None):
    """U8: delete libraries with their documents and chunks, and their index
    (the reference leaves the index behind; Q9)."""
    k = ids.select(*LIB).distinct()
    out = Corpus3(c.libraries.join(k, LIB, "left_anti"),
                  c.documents.join(k, LIB, "left_anti"),
                  c.chunks.join(k, LIB, "left_anti"))
    idx = index.join(k, LIB, "left_anti") if index is not None else None
    mt = meta.join(k, LIB, "left_anti") if meta is not None else None
    return out, idx, mt


# ---------------------------------------------------------------------------
# documents
# ---------------------------------------------------------------------------

def _parent_check(rows: DataFrame, parents: DataFrame, keys: list[str], rtype: str, id_col: str):
    ok = rows.join(parents.select(*keys), keys, "left_semi")
    bad = (rows.join(parents.select(*keys), keys, "left_anti")
           .select(F.lit(rtype).alias("resource_type"), F.col(id_col).alias("resource_id")))
    return ok, bad


def add_documents(c: Corpus3, docs: DataFrame, chunks: DataFrame | None = None,
                  order_col: str = "seq") -> tuple[Corpus3, DataFrame]:
    """Add documents to existing libraries (V7).  A document id already
    in the library is replaced (with its chunks) and moves to the end; new
    positions follow ``max(doc_pos)`` of the library in ``order_col`` order.

    ``chunks`` come with their documents.  A ``parent_document_id`` column, where
    given, names the document a chunk is added to and wins over the
    ``document_id`` it carries (R8).  A chunk whose document is not added by this
    call is reported, and so is a chunk id given twice in one document."""
    docs, twice = gate(docs, DOC)
    bad_chunks = None
    if order_col not in docs.columns:
        docs = docs.withColumn(order_col, F.lit(0))
    ok, bad = _parent_check(docs, c.libraries, LIB, "Library", "library_id")
    keep = c.documents.join(ok.select(*DOC), DOC, "left_anti")
    placed = next_positions(keep, ok.select(*DOC, "metadata", order_col), LIB, "doc_pos", order_col)
    documents = keep.unionByName(placed.select(*c.documents.columns))
    new_chunks = c.chunks.join(ok.select(*DOC), DOC, "left_anti")
    if chunks is not None:
        if "parent_document_id" in chunks.columns:
            chunks = chunks.withColumn("document_id", F.coalesce("parent_document_id", "document_id"))
        chunks, twice_chunks = gate(chunks, CHUNK)
        inc, lost = _parent_check(chunks, ok, DOC, "Document", "document_id")
        bad_chunks = lost.unionByName(_twice(twice_chunks, "Chunk", "chunk_id"))
        new_chunks = new_chunks.unionByName(inc.select(*c.chunks.columns))
    bad = bad.unionByName(_twice(twice, "Document", "document_id"))
    return Corpus3(c.libraries, documents, new_chunks), bad if bad_chunks is None else bad.unionByName(bad_chunks)


def update_documents(c: Corpus3, docs: DataFrame) -> tuple[Corpus3, DataFrame]:
    """Replace metadata of existing documents in place (position, id and
    chunks kept; Q10).  Unknown documents are reported."""
    docs, twice = gate(docs, DOC)
    ok, bad = _parent_check(docs, c.documents, DOC, "Document", "document_id")
    bad = bad.unionByName(_twice(twice, "Document", "document_id"))
    upd = ok.select(*DOC, F.col("metadata").alias("_md"))
    documents = (c.documents.join(upd, DOC, "left")
                 .withColumn("metadata", F.coalesce("_md", "metadata")).drop("_md"))
    return Corpus3(c.libraries, documents.select(*c.documents.columns), c.chunks), bad


def delete_documents(c: Corpus3, ids: DataFrame) -> tuple[Corpus3, DataFrame]:
    """Delete documents and their chunks; unknown ids are reported."""
    k = ids.select(*DOC).distinct()
    _, bad = _parent_check(k, c.documents, DOC, "Document", "document_id")
    return Corpus3(c.libraries, c.documents.join(k, DOC, "left_anti"),
                   c.chunks.join(k, DOC, "left_anti")), bad


# ---------------------------------------------------------------------------
# chunks (U12-U14)
# ---------------------------------------------------------------------------

def add_chunks(c: Corpus3, chunks: DataFrame, order_col: str = "seq") -> tuple[Corpus3, DataFrame]:
    """Add chunks to existing documents (V7: library and document).  A
    chunk id already in the document is replaced and moves to the end.  Keys and hashes alone
    are checked and numbered; texts and vectors meet the keys that are added once."""
    one, twice = _gated_keys(chunks, CHUNK, order_col)
    # the library is checked first: a chunk of an unknown one reports the library
    known, no_library = _parent_check(one, c.libraries, LIB, "Library", "library_id")
    ok, bad = _parent_check(known, c.documents, DOC, "Document", "document_id")
    bad = bad.unionByName(no_library).unionByName(_twice(twice, "Chunk", "chunk_id"))
    keep = c.chunks.join(ok.select(*CHUNK), CHUNK, "left_anti")
    at = next_positions(keep, ok, DOC, "chunk_pos", order_col)
    if "seq" not in chunks.columns:
        placed = chunks.drop("chunk_pos").join(fresh(at.select(*CHUNK, "chunk_pos")), CHUNK)
    else:
        at = at.select(*CHUNK, "chunk_pos", F.col("_seq").alias("_at_seq"), F.col("_h").alias("_at_h"))
        hashed = chunks.withColumn("_h", content_hash(chunks, [x for x in chunks.columns if x not in CHUNK])).drop("chunk_pos")
        same = hashed.join(fresh(at), CHUNK).filter(F.col("seq").eqNullSafe(F.col("_at_seq")) & (F.col("_h") == F.col("_at_h")))
        more = [x for x in c.chunks.columns if x not in CHUNK]
        placed = same.groupBy(*CHUNK).agg(F.first(F.struct(*more)).alias("_p")).select(*CHUNK, *[F.col("_p")[x].alias(x) for x in more])
    return Corpus3(c.libraries, c.documents,
                   keep.unionByName(placed.select(*c.chunks.columns))), bad


def update_chunks(c: Corpus3, chunks: DataFrame) -> tuple[Corpus3, DataFrame]:
    """Replace text, vector and metadata of existing chunks in place
    (id and position kept)."""
    chunks, twice = gate(chunks, CHUNK)
    ok, bad = _parent_check(chunks, c.chunks, CHUNK, "Chunk", "chunk_id")
    bad = bad.unionByName(_twice(twice, "Chunk", "chunk_id"))
    u = ok.select(*CHUNK, F.col("text").alias("_t"), F.col("embedding").alias("_e"),
                  F.col("metadata").alias("_m"), F.lit(True).alias("_hit"))
    j = c.chunks.join(u, CHUNK, "left")
    out = j.select(*CHUNK, "chunk_pos",
                   F.when(F.col("_hit"), F.col("_t")).otherwise(F.col("text")).alias("text"),
                   F.when(F.col("_hit"), F.col("_e")).otherwise(F.col("embedding")).alias("embedding"),
                   F.when(F.col("_hit"), F.col("_m")).otherwise(F.col("metadata")).alias("metadata"))
    return Corpus3(c.libraries, c.documents, out.select(*c.chunks.columns)), bad


def delete_chunks(c: Corpus3, ids: DataFrame) -> tuple[Corpus3, DataFrame]:
    """Delete chunks; unknown ids are reported."""
    k = ids.select(*CHUNK).distinct()
    _, bad = _parent_check(k, c.chunks, CHUNK, "Chunk", "chunk_id")
    return Corpus3(c.libraries, c.documents, c.chunks.join(k, CHUNK, "left_anti")), bad


def apply_changes(table: DataFrame, changes: DataFrame, keys: list[str], *,
                  op_col: str = "op", order_cols: tuple[str, ...] = ("ts", "seq"),
                  tombstones: DataFrame | None = None):
    """M1 core: apply a change feed (``op`` in {'upsert','delete'}) to a
    keyed table.  Only the latest change per key counts (by ``order_cols``);
    deletes are kept as tombstones so a late, older upsert cannot revive a
    key.  Returns ``(table, tombstones)``; both carry the winning order
    columns so the next batch compares against them."""
    last = latest_per_key(changes, keys, list(order_cols))
    w_cols = list(order_cols)
    state = table.withColumn(op_col, F.lit("upsert"))
    if tombstones is not None:
        state = state.unionByName(tombstones.withColumn(op_col, F.lit("delete")), allowMissingColumns=True)
    merged = state.unionByName(last, allowMissingColumns=True)
    final = latest_per_key(merged, keys, w_cols)
    live = final.filter(F.col(op_col) == "upsert").drop(op_col)
    dead = final.filter(F.col(op_col) == "delete").select(*keys, *w_cols)
    return live, dead

