"""Keyed mutation queries (U1-U14, J4, W3): each returns the table state
after applying a change batch derived from the given tables (labels mark
documents to touch; toxic ones are removed, low-quality ones rewritten)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutate as M
from ..plans.index import build_index
from ..session import stored
from ..sources import tables
from . import register
from .common import with_chunks

_LAB = "lab AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, toxic, quality FROM labels)"


def _lab(spark, sf):
    return tables.read_table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("document_id"), "toxic", "quality")


def _vectors(spark, sf):
    return tables.chunks(spark, sf).select("library_id", "chunk_id", F.col("embedding").alias("vector"))


def _first(col="vector"):
    return F.round(F.element_at(col, 1).cast("double"), 6).alias("first")


def _new_vectors(spark, sf):
    c = tables.chunks(spark, sf).join(_lab(spark, sf), "document_id")
    upd = c.select("library_id", "chunk_id", F.reverse("embedding").alias("vector"))
    add = c.filter("toxic = 1").select("library_id", F.concat("chunk_id", F.lit("-n")).alias("chunk_id"),
                                      F.col("embedding").alias("vector"))
    return upd.unionByName(add)


_NEW = _LAB + """, new AS (
  SELECT c.library_id, c.chunk_id, list_reverse(c.embedding) AS v FROM chunks c JOIN lab USING (document_id)
  UNION ALL
  SELECT c.library_id, c.chunk_id || '-n', c.embedding FROM chunks c JOIN lab USING (document_id)
  WHERE lab.toxic = 1)"""


@register("upsert_overwrite", with_chunks("""
SELECT library_id, chunk_id, round(v[1], 6) AS first FROM (
  SELECT c.library_id, c.chunk_id, c.embedding AS v FROM chunks c
  WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.library_id = c.library_id AND n.chunk_id = c.chunk_id)
  UNION ALL SELECT library_id, chunk_id, v FROM new)""", _NEW))
def upsert_overwrite(spark, sf):
    """U1 with overwrite: stored keys are replaced, new keys added."""
    r = M.upsert_vectors(_vectors(spark, sf), _new_vectors(spark, sf), ["library_id", "chunk_id"], True)
    return r.table.select("library_id", "chunk_id", _first())


_KEEP_SQL = with_chunks("""
SELECT library_id, chunk_id, round(v[1], 6) AS first FROM (
  SELECT c.library_id, c.chunk_id, c.embedding AS v FROM chunks c
  UNION ALL SELECT library_id, chunk_id, v FROM new n
  WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE n.library_id = c.library_id AND n.chunk_id = c.chunk_id))""", _NEW)


@register("upsert_reject", _KEEP_SQL)
def upsert_reject(spark, sf):
    """U1 without overwrite: stored keys are kept, only new keys are added."""
    r = M.upsert_vectors(_vectors(spark, sf), _new_vectors(spark, sf), ["library_id", "chunk_id"], False)
    return r.table.select("library_id", "chunk_id", _first())


@register("upsert_rejects", with_chunks("""
SELECT library_id, chunk_id, 'duplicate_id' AS reason FROM new n
WHERE EXISTS (SELECT 1 FROM chunks c WHERE n.library_id = c.library_id AND n.chunk_id = c.chunk_id)""", _NEW))
def upsert_rejects(spark, sf):
    """The rejected half of an add without overwrite."""
    r = M.upsert_vectors(_vectors(spark, sf), _new_vectors(spark, sf), ["library_id", "chunk_id"], False)
    return r.rejects.select("library_id", "chunk_id", "reason")


@register("append_unseen", _KEEP_SQL)
def append_unseen(spark, sf):
    """Bulk build appends only unseen ids."""
    t = M.append_unseen(_vectors(spark, sf), _new_vectors(spark, sf), ["library_id", "chunk_id"])
    return t.select("library_id", "chunk_id", _first())


@register("replace_partitions", with_chunks("""
SELECT library_id, chunk_id, round(v[1], 6) AS first FROM (
  SELECT c.library_id, c.chunk_id, c.embedding AS v FROM chunks c
  WHERE c.library_id NOT IN (SELECT library_id FROM chunks WHERE lang = 'en')
  UNION ALL
  SELECT library_id, chunk_id, list_reverse(embedding) FROM chunks WHERE lang = 'en')"""))
def replace_partitions(spark, sf):
    """A rebuild of every library that has English chunks from those
    chunks only (new vectors); other libraries keep their rows."""
    c = tables.chunks(spark, sf)
    new = c.filter(F.element_at("metadata", "lang") == "en").select(
        "library_id", "chunk_id", F.reverse("embedding").alias("vector"))
    t = M.replace_partitions(_vectors(spark, sf), new, ["library_id"])
    return t.select("library_id", "chunk_id", _first())


@register("remove_vectors", with_chunks(
    "SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"))
def remove_vectors(spark, sf):
    """U4: remove by id (the labelled doc ids used as chunk ids)."""
    ids = tables.read_table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"))
    t, _flags = M.remove_keys(_vectors(spark, sf), ids, ["chunk_id"])
    return t.select("chunk_id")


def _corpus3(spark, sf):
    c = tables.corpus(spark, sf)
    return M.Corpus3(c.libraries, c.documents, c.chunks)


_COUNTS = """
SELECT l.library_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_documents, CAST(coalesce(c.n, 0) AS BIGINT) AS n_chunks
FROM flibs l
LEFT JOIN (SELECT library_id, count(*) AS n FROM fdocs GROUP BY library_id) d ON d.library_id = l.library_id
LEFT JOIN (SELECT library_id, count(*) AS n FROM fchunks GROUP BY library_id) c ON c.library_id = l.library_id"""


def _counts(c3: M.Corpus3):
    d = c3.documents.groupBy("library_id").agg(F.count(F.lit(1)).alias("n_documents"))
    ch = c3.chunks.groupBy("library_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    out = c3.libraries.select("library_id").join(d, "library_id", "left").join(ch, "library_id", "left")
    return out.select("library_id", F.coalesce("n_documents", F.lit(0)).cast("bigint").alias("n_documents"),
                      F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"))


@register("add_libraries", with_chunks(_COUNTS, """
flibs AS (SELECT DISTINCT library_id FROM docs UNION SELECT DISTINCT 'lang-' || lang FROM docs),
fdocs AS (SELECT library_id, document_id FROM docs UNION ALL SELECT 'lang-' || lang, document_id FROM docs),
fchunks AS (SELECT library_id, chunk_id FROM chunks UNION ALL SELECT 'lang-' || lang, chunk_id FROM chunks)"""))
def add_libraries(spark, sf):
    """Add one library per language holding copies of its documents and
    chunks."""
    c3 = _corpus3(spark, sf)
    lang = F.concat(F.lit("lang-"), F.element_at("metadata", "lang"))
    docs = c3.documents.withColumn("library_id", lang)
    chunks = c3.chunks.withColumn("library_id", lang)
    libs = docs.select("library_id").distinct().select(
        "library_id", F.create_map(F.lit("name"), F.col("library_id")).alias("metadata"))
    return _counts(M.add_libraries(c3, M.Corpus3(libs, docs, chunks)))


@register("replace_if_present", with_chunks("""
SELECT 'Library' AS resource_type, 'lang-' || lang AS resource_id FROM docs GROUP BY lang
UNION ALL
SELECT 'replaced' AS resource_type, upper(library_id) AS resource_id FROM docs GROUP BY library_id"""))
def replace_if_present(spark, sf):
    """Replace libraries that exist (renamed to upper case); language
    libraries do not exist and are reported not found."""
    c3 = _corpus3(spark, sf)
    up = c3.libraries.select("library_id", F.create_map(F.lit("name"), F.upper("library_id")).alias("metadata"))
    langs = c3.documents.select(F.concat(F.lit("lang-"), F.element_at("metadata", "lang")).alias("library_id")) \
        .distinct().withColumn("metadata", F.create_map(F.lit("name"), F.col("library_id")))
    new = M.Corpus3(up.unionByName(langs), c3.documents, c3.chunks)
    out, missing = M.replace_libraries_if_present(c3, new)
    replaced = out.libraries.select(F.lit("replaced").alias("resource_type"),
                                    F.element_at("metadata", "name").alias("resource_id"))
    return missing.unionByName(replaced)


@register("patch_libraries", with_chunks("""
SELECT d.library_id, CASE WHEN bool_or(l.doc_id IS NOT NULL AND l.toxic = 1) THEN 'flagged-' || d.library_id
                          ELSE d.library_id END AS name
FROM docs d LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = d.document_id GROUP BY d.library_id"""))
def patch_libraries(spark, sf):
    """Partial update; a patch with NULL metadata keeps the stored one
    (libraries with a toxic document get a new name, others a NULL patch)."""
    c3 = _corpus3(spark, sf)
    tox = c3.documents.join(_lab(spark, sf).filter("toxic = 1"), "document_id", "left_semi") \
        .select("library_id").distinct().withColumn("_t", F.lit(True))
    patch = c3.libraries.join(tox, "library_id", "left").select(
        "library_id", F.when(F.col("_t"), F.create_map(F.lit("name"), F.concat(F.lit("flagged-"), "library_id")))
        .alias("metadata"))
    out = M.patch_libraries(c3.libraries, patch)
    return out.select("library_id", F.element_at("metadata", "name").alias("name"))


@register("delete_libraries", with_chunks("""
SELECT l.library_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_documents, CAST(coalesce(c.n, 0) AS BIGINT) AS n_chunks,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_indexed
FROM (SELECT DISTINCT library_id FROM docs WHERE library_id NOT IN (SELECT library_id FROM gone)) l
LEFT JOIN (SELECT library_id, count(*) AS n FROM docs GROUP BY library_id) d ON d.library_id = l.library_id
LEFT JOIN (SELECT library_id, count(*) AS n FROM chunks GROUP BY library_id) c ON c.library_id = l.library_id""",
    "gone AS (SELECT DISTINCT d.library_id FROM docs d JOIN labels l ON CAST(l.doc_id AS VARCHAR) = d.document_id "
    "WHERE l.toxic = 1)"))
def delete_libraries(spark, sf):
    """U8: delete every library holding a toxic document, cascading to its
    documents, chunks and index rows."""
    c3 = _corpus3(spark, sf)
    b = build_index(c3.chunks, c3.libraries)
    gone = c3.documents.join(_lab(spark, sf).filter("toxic = 1"), "document_id", "left_semi").select("library_id")
    out, idx, _meta = M.delete_libraries(c3, gone, b.index, b.meta)
    n_idx = idx.groupBy("library_id").agg(F.count(F.lit(1)).alias("n_indexed"))
    return _counts(out).join(n_idx, "library_id", "left").select(
        "library_id", "n_documents", "n_chunks", F.coalesce("n_indexed", F.lit(0)).cast("bigint").alias("n_indexed"))


_INC_DOCS = _LAB + """, inc AS (
  SELECT d.library_id, d.document_id, CAST(lab.quality AS VARCHAR) AS quality, CAST(d.document_id AS BIGINT) AS seq
  FROM docs d JOIN lab USING (document_id))"""


@register("add_documents", with_chunks("""
SELECT library_id, document_id, CAST(doc_pos AS BIGINT) AS doc_pos, quality FROM kept
UNION ALL
SELECT i.library_id, i.document_id,
       CAST(coalesce(mx.m, -1) + row_number() OVER (PARTITION BY i.library_id ORDER BY i.seq) AS BIGINT),
       i.quality
FROM inc i LEFT JOIN mx ON mx.library_id = i.library_id""", _INC_DOCS + """,
kept AS (SELECT library_id, document_id, doc_pos, CAST(NULL AS VARCHAR) AS quality FROM docs
         WHERE document_id NOT IN (SELECT document_id FROM inc)),
mx AS (SELECT library_id, max(doc_pos) AS m FROM kept GROUP BY library_id)"""))
def add_documents(spark, sf):
    """U9 + W3: re-adding the labelled documents replaces them and moves them
    to the end of their library, in request order."""
    c3 = _corpus3(spark, sf)
    inc = c3.documents.join(_lab(spark, sf), "document_id").select(
        "library_id", "document_id",
        F.create_map(F.lit("quality"), F.col("quality").cast("string")).alias("metadata"),
        F.col("document_id").cast("long").alias("seq"))
    out, _bad = M.add_documents(c3, inc)
    return out.documents.select("library_id", "document_id", "doc_pos",
                                F.element_at("metadata", "quality").alias("quality"))


@register("update_documents", with_chunks("""
SELECT d.library_id, d.document_id, d.doc_pos, coalesce(i.quality, d.lang) AS tag
FROM docs d LEFT JOIN inc i ON i.document_id = d.document_id""", _INC_DOCS))
def update_documents(spark, sf):
    """The labelled documents get new metadata in place (position kept)."""
    c3 = _corpus3(spark, sf)
    inc = c3.documents.join(_lab(spark, sf), "document_id").select(
        "library_id", "document_id", F.create_map(F.lit("quality"), F.col("quality").cast("string")).alias("metadata"))
    out, _bad = M.update_documents(c3, inc)
    return out.documents.select("library_id", "document_id", "doc_pos",
                                F.coalesce(F.element_at("metadata", "quality"),
                                           F.element_at("metadata", "lang")).alias("tag"))


@register("delete_documents", with_chunks("""
SELECT d.library_id, d.document_id, CAST(count(c.chunk_id) AS BIGINT) AS n_chunks
FROM docs d LEFT JOIN chunks c ON c.document_id = d.document_id AND c.library_id = d.library_id
WHERE d.document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)
GROUP BY d.library_id, d.document_id"""))
def delete_documents(spark, sf):
    """Delete toxic documents with their chunks."""
    c3 = _corpus3(spark, sf)
    ids = c3.documents.join(_lab(spark, sf).filter("toxic = 1"), "document_id", "left_semi")
    out, _bad = M.delete_documents(c3, ids)
    n = out.chunks.groupBy("library_id", "document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return out.documents.join(n, ["library_id", "document_id"], "left").select(
        "library_id", "document_id", F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"))


_INC_CHUNKS = _LAB + """, inc AS (
  SELECT c.library_id, c.document_id, c.chunk_id, c.chunk_pos AS seq FROM chunks c JOIN lab USING (document_id)
  WHERE lab.quality = 0
  UNION ALL
  SELECT c.library_id, c.document_id, c.chunk_id || '-copy', 100 + c.chunk_pos FROM chunks c JOIN lab USING (document_id)
  WHERE lab.toxic = 1),
kept AS (SELECT library_id, document_id, chunk_id, chunk_pos FROM chunks c
         WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.chunk_id = c.chunk_id AND i.document_id = c.document_id)),
mx AS (SELECT library_id, document_id, max(chunk_pos) AS m FROM kept GROUP BY library_id, document_id)"""


@register("add_chunks", with_chunks("""
SELECT chunk_id, document_id, CAST(chunk_pos AS BIGINT) AS chunk_pos FROM kept
UNION ALL
SELECT i.chunk_id, i.document_id,
       CAST(coalesce(mx.m, -1) + row_number() OVER (PARTITION BY i.library_id, i.document_id ORDER BY i.seq) AS BIGINT)
FROM inc i LEFT JOIN mx ON mx.library_id = i.library_id AND mx.document_id = i.document_id""", _INC_CHUNKS))
def add_chunks(spark, sf):
    """U12 + W3 + R8: re-added chunks of low-quality documents move to the
    end; toxic documents get copies of their chunks appended."""
    c3 = _corpus3(spark, sf)
    c = c3.chunks.join(_lab(spark, sf), "document_id")
    re_add = c.filter("quality = 0").withColumn("seq", F.col("chunk_pos"))
    copies = c.filter("toxic = 1").withColumn("chunk_id", F.concat("chunk_id", F.lit("-copy"))) \
        .withColumn("seq", F.col("chunk_pos") + 100)
    inc = re_add.unionByName(copies).drop("toxic", "quality")
    out, _bad = M.add_chunks(c3, inc)
    return out.chunks.select("chunk_id", "document_id", "chunk_pos")


@register("add_chunks_tied", with_chunks("""
SELECT chunk_id, CASE WHEN CAST(label AS INTEGER) % 3 = 2 THEN text || ' [second]' ELSE text END AS text, 'stored' AS state FROM chunks
UNION ALL
SELECT chunk_id, NULL, 'DuplicateChunk' FROM chunks WHERE CAST(label AS INTEGER) % 3 = 1"""))
def add_chunks_tied(spark, sf):
    """V8 + U12: every chunk is sent twice in one batch.  Equal rows of one ``seq`` count once; different
    rows of one ``seq`` are rejected, and the stored chunk stays; a higher ``seq`` wins."""
    c3 = _corpus3(spark, sf)
    # written once: the batch is made of the stored chunks twice over
    c3 = M.Corpus3(c3.libraries, c3.documents, stored(c3.chunks))
    label = F.element_at("metadata", "label").cast("int") % 3
    first = c3.chunks.withColumn("seq", F.lit(1))
    text = F.when(label == 0, F.col("text")).when(label == 1, F.concat("text", F.lit(" [clash]"))).otherwise(F.concat("text", F.lit(" [second]")))
    again = c3.chunks.withColumn("text", text).withColumn("seq", F.when(label == 2, 2).otherwise(1))
    out, bad = M.add_chunks(c3, first.unionByName(again))
    return out.chunks.select("chunk_id", "text", F.lit("stored").alias("state")).unionByName(
        bad.select(F.col("resource_id").alias("chunk_id"), F.lit(None).cast("string").alias("text"), F.col("resource_type").alias("state")))


@register("update_chunks", with_chunks("""
SELECT c.chunk_id, c.chunk_pos, CASE WHEN lab.quality = 0 THEN c.text || ' [edited]' ELSE c.text END AS text,
       round(CASE WHEN lab.quality = 0 THEN list_reverse(c.embedding) ELSE c.embedding END[1], 6) AS first
FROM chunks c LEFT JOIN lab USING (document_id)""", _LAB))
def update_chunks(spark, sf):
    """Chunks of low-quality documents get new text (marked edited) and
    a new vector in place."""
    c3 = _corpus3(spark, sf)
    upd = c3.chunks.join(_lab(spark, sf).filter("quality = 0"), "document_id", "left_semi").select(
        "library_id", "document_id", "chunk_id", F.concat("text", F.lit(" [edited]")).alias("text"),
        F.reverse("embedding").alias("embedding"), "metadata")
    out, _bad = M.update_chunks(c3, upd)
    return out.chunks.select("chunk_id", "chunk_pos", "text", _first("embedding"))


@register("delete_chunks", with_chunks(
    "SELECT chunk_id FROM chunks WHERE document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"))
def delete_chunks(spark, sf):
    """Delete the chunks of toxic documents."""
    c3 = _corpus3(spark, sf)
    ids = c3.chunks.join(_lab(spark, sf).filter("toxic = 1"), "document_id", "left_semi")
    out, _bad = M.delete_chunks(c3, ids)
    return out.chunks.select("chunk_id")
