"""Snapshot in and out (S1, S2, S3) and versioned publishing.

Two formats:

* **versioned table snapshot** (the scalable one, written and read here):
  a directory per version holding ``libraries``, ``documents`` and ``chunks`` as
  Parquet, flat, vectors as arrays; rows without a parent are kept.
  A version becomes visible only when its manifest file is written, after
  all data files; readers take the newest manifest.  A retried write of the
  same version rewrites the same directory (idempotent).
* **reference snapshot** (read only, for import): one JSON object mapping
  dashed library ids to nested libraries.  A single JSON object is one file
  and so one task; it is an import path, not the scale path.

Corrupt input fails the read (``FAILFAST``) instead of loading nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reshape import canonical_id, conform, stable_id
from ..schema import CHUNKS, DOCUMENTS, LIBRARIES, SNAP_DOCUMENT, SNAPSHOT
from ..session import ensure_checkpoint_dir
from . import fs


def scratch_root(spark: SparkSession, name: str) -> str:
    """A folder for job outputs under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/vellum/{name}"


def manifest_name(version: int) -> str:
    return f"_manifest-{version:012d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions under ``root`` (those with a manifest)."""
    return [int(n[len("_manifest-"):-len(".json")]) for n in fs.list_names(spark, root)
            if n.startswith("_manifest-") and n.endswith(".json")]


def write_snapshot(libraries: DataFrame, documents: DataFrame, chunks: DataFrame, root: str,
                   version: int) -> str:
    """Write one version and publish it.  Returns the version directory.

    The three tables are written as they are, rows without a parent included;
    chunk ids in canonical form.  Nothing is grouped, so no row grows with its
    document or library; positions carry the order."""
    vdir = f"{root.rstrip('/')}/v{version:012d}"
    flat = {"libraries": conform(libraries, LIBRARIES), "documents": conform(documents, DOCUMENTS),
            "chunks": conform(chunks, CHUNKS).withColumn("chunk_id", canonical_id("chunk_id"))}
    for name, rows in flat.items():
        rows.write.mode("overwrite").parquet(f"{vdir}/{name}")
    _publish(libraries.sparkSession, root, version, vdir)
    return vdir


def _publish(spark: SparkSession, root: str, version: int, vdir: str) -> None:
    """Write the manifest last: a version without one does not exist."""
    body = json.dumps({"version": version, "path": vdir})
    fs.write_text(spark, f"{root.rstrip('/')}/{manifest_name(version)}", body)


def latest_version(spark: SparkSession, root: str, before: int | None = None) -> str | None:
    """Directory of the newest published version (older than ``before``
    when given), or None."""
    vs = [v for v in versions(spark, root) if before is None or v < before]
    if not vs:
        return None
    return json.loads(fs.read_text(spark, f"{root.rstrip('/')}/{manifest_name(vs[-1])}"))["path"]


def read_snapshot(spark: SparkSession, vdir: str):
    """S1 (versioned form): the three flat tables.  Absent metadata becomes empty,
    an absent chunk id a stable one from the chunk's place."""
    libraries, documents, chunks = (
        spark.read.schema(schema).parquet(f"{vdir}/{name}").withColumn(
            "metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
        for name, schema in (("libraries", LIBRARIES), ("documents", DOCUMENTS), ("chunks", CHUNKS)))
    return libraries, documents, chunks.withColumn(
        "chunk_id", F.coalesce("chunk_id", stable_id("library_id", "document_id", "chunk_pos")))


def read_reference_snapshot(spark: SparkSession, path: str):
    """S1 (reference form): one JSON object ``{dashed library id: library}``.

    Library ids come from the map keys, a chunk's document id is rewritten to
    its parent's, absent lists and metadata become empty, absent ids get a
    stable id from their position.  Ids are canonicalised (undashed)."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", SNAPSHOT, {"mode": "FAILFAST"}).alias("m"))
    libs = parsed.select(F.explode("m").alias("key", "lib"))
    empty = F.create_map().cast("map<string,string>")
    libraries = libs.select(canonical_id("key").alias("library_id"),
                            F.coalesce("lib.metadata", empty).alias("metadata"))
    dx = libs.select(canonical_id("key").alias("library_id"),
                     F.posexplode(F.coalesce("lib.documents", F.array().cast(T.ArrayType(SNAP_DOCUMENT))))
                     .alias("doc_pos", "d"))
    dx = dx.withColumn("document_id", F.coalesce(canonical_id("d.id"), stable_id("library_id", "doc_pos")))
    documents = dx.select("library_id", "document_id", F.col("doc_pos").cast("long").alias("doc_pos"),
                          F.coalesce("d.metadata", empty).alias("metadata"))
    cx = dx.select("library_id", "document_id",
                   F.posexplode(F.coalesce("d.chunks", F.array().cast(SNAP_DOCUMENT["chunks"].dataType)))
                   .alias("chunk_pos", "c"))
    chunks = cx.select("library_id", "document_id",
                       F.coalesce(canonical_id("c.id"), stable_id("library_id", "document_id", "chunk_pos"))
                       .alias("chunk_id"),
                       F.col("chunk_pos").cast("long").alias("chunk_pos"), F.col("c.text").alias("text"),
                       F.coalesce("c.embedding", F.array().cast("array<float>")).alias("embedding"),
                       F.coalesce("c.metadata", empty).alias("metadata"))
    return libraries, documents, chunks


def serialize_record(df: DataFrame, id_cols: list[str], ts_cols: list[str] = (),
                     keep: list[str] = ()) -> DataFrame:
    """S3: a row as its JSON record: ids undashed lower-case, timestamps as
    ISO-8601 text, everything else as JSON values.  ``keep`` columns stay
    beside the record (and out of it)."""
    cols = []
    for name in [c for c in df.columns if c not in keep]:
        c = F.col(name)
        if name in id_cols:
            c = canonical_id(c)
        elif name in ts_cols:
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        cols.append(c.alias(name))
    return df.select(*keep, F.to_json(F.struct(*cols)).alias("json"))
