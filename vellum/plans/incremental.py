"""An index kept fresh by what changed (X5, X2): digests stored beside the rows.

The rows of a library lie in buckets by a hash of the chunk id, about ``BUCKET_ROWS`` each, one folder a
bucket and version.  With them goes one line per bucket: the version that holds it, the rows in it, and two
sums over hashes of (id, vector) that do not depend on any order.

Freshness takes one aggregate over the current chunks to the same lines; where they agree a bucket is fresh, and its
folder is not opened.  Only stale buckets are compared row by row, and a refresh writes only
those, as folders of a new version whose manifest comes last.  A library whose buckets have outgrown
``GROWTH`` times their size is dealt into new ones as a whole.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import INDEX, INDEX_META
from ..session import ensure_checkpoint_dir, fresh
from ..sources import fs
from .index import IndexBuild, _empty_vec, build_index, index_versions

BUCKET_ROWS = 100_000
GROWTH = 4
#: Stale buckets up to this many are read by the names of their folders.
NAMED_BUCKETS = 10_000
#: Bucket lines up to this many are broadcast (some 60 bytes each).
BROADCAST_BUCKETS = 200_000

_KEY = ["library_id", "bucket"]
_LINES = T.StructType([T.StructField("library_id", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n_buckets", T.IntegerType()),
                       T.StructField("n", T.LongType()), T.StructField("x", T.LongType()), T.StructField("s", T.LongType()), T.StructField("version", T.LongType())])
_ROWS = T.StructType([*INDEX.fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])


def _bucket():
    return F.pmod(F.xxhash64("chunk_id"), F.col("n_buckets")).cast("int").alias("bucket")


def bucket_digests(rows: DataFrame) -> DataFrame:
    """Per (library_id, bucket): n_buckets, n, x, s of rows (library_id, chunk_id, vector, n_buckets)."""
    h = rows.select("library_id", "n_buckets", _bucket(), F.xxhash64("chunk_id", "vector").alias("_h"))
    return h.groupBy(*_KEY).agg(F.max("n_buckets").alias("n_buckets"), F.count(F.lit(1)).alias("n"), F.bit_xor("_h").alias("x"),
                                F.sum(F.pmod(F.xxhash64("_h"), F.lit(1 << 31))).alias("s"))


def _lines(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    versions = index_versions(spark, root)
    if not versions:
        raise LookupError(f"no published index at {root}")
    return spark.read.schema(_LINES).parquet(f"{root}/lines/version={versions[-1] if version is None else version}")


def _write(spark: SparkSession, root: str, rows: DataFrame, old_lines: DataFrame | None, gone: DataFrame | None, meta: DataFrame, bounds: dict) -> int:
    """Publishes ``rows`` (index rows with n_buckets) as the buckets they fall in, beside the old ones not in ``gone``."""
    used = [int(n[len("version="):]) for n in fs.list_names(spark, f"{root}/rows") if n.startswith("version=")]
    version = max([0, *index_versions(spark, root), *used]) + 1
    rows.withColumn("bucket", _bucket()).drop("n_buckets").write.partitionBy("library_id", "bucket").parquet(f"{root}/rows/version={version}")
    lines = bucket_digests(rows).withColumn("version", F.lit(version).cast("long")).select(*_LINES.fieldNames())
    if old_lines is not None:
        lines = fresh(old_lines).join(fresh(gone.select(*_KEY)), _KEY, "left_anti").unionByName(fresh(lines))
    lines.write.parquet(f"{root}/lines/version={version}")
    meta.select(*INDEX_META.fieldNames()).write.parquet(f"{root}/meta/version={version}")
    fs.write_text(spark, f"{root}/_manifest-{version:012d}.json", json.dumps({"version": version, **bounds}))
    return version


def _sized(counts: DataFrame, bucket_rows: int) -> DataFrame:
    return counts.select("library_id", F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_rows)).cast("int").alias("n_buckets"))


def publish(build: IndexBuild, root: str, bucket_rows: int = BUCKET_ROWS) -> int:
    """Writes a whole build as a new version; returns its number."""
    spark, root = build.index.sparkSession, root.rstrip("/")
    rows = build.index.join(fresh(_sized(build.meta, bucket_rows)), "library_id")
    return _write(spark, root, rows, None, None, build.meta, {"bucket_rows": bucket_rows})


def read(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``(index, meta)`` pair of a published version (the newest)."""
    root = root.rstrip("/")
    v = index_versions(spark, root)[-1] if version is None else version
    return _rows_of(spark, root, _lines(spark, root, v)), spark.read.schema(INDEX_META).parquet(f"{root}/meta/version={v}")


def _rows_of(spark: SparkSession, root: str, lines: DataFrame) -> DataFrame:
    """The index rows of bucket lines: by the names of their folders where these are few, else by a join on the partition columns."""
    few = lines.select("version", *_KEY).limit(NAMED_BUCKETS + 1).collect()
    every = spark.read.schema(_ROWS).option("basePath", f"{root}/rows")
    if len(few) > NAMED_BUCKETS:
        rows = every.parquet(f"{root}/rows").join(fresh(lines.select("version", *_KEY)), ["version", *_KEY], "left_semi")
        return rows.select(*INDEX.fieldNames())
    paths = [f"{root}/rows/version={r['version']}/library_id={_escaped(spark, r['library_id'])}/bucket={r['bucket']}" for r in few]
    return every.parquet(*paths).select(*INDEX.fieldNames()) if paths else spark.createDataFrame([], INDEX)


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition value as Spark names its folder."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def _current(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """Chunks with a vector, each with the number of buckets of its library (1 for one that is not indexed)."""
    sizes = fresh(lines.groupBy("library_id").agg(F.max("n_buckets").alias("n_buckets")))
    c = chunks.filter(~_empty_vec()).select("library_id", "chunk_id", F.col("embedding").alias("vector"))
    return c.join(sizes, "library_id", "left").withColumn("n_buckets", F.coalesce("n_buckets", F.lit(1)))


def stale_buckets(spark: SparkSession, root: str, chunks: DataFrame) -> DataFrame:
    """(library_id, bucket, n_buckets, version, n_now) of the buckets whose rows are not those of ``chunks``; version is null for
    one that is not stored, n_now for one without chunks.  One aggregate over the chunks; no index row is read."""
    ensure_checkpoint_dir(spark)
    lines = _lines(spark, root.rstrip("/"))
    now = fresh(bucket_digests(_current(chunks, lines))).select(*_KEY, *[F.col(c).alias(f"{c}_now") for c in ("n_buckets", "n", "x", "s")])
    j = lines.join(now, _KEY, "full_outer")
    same = (F.col("n") == F.col("n_now")) & (F.col("x") == F.col("x_now")) & (F.col("s") == F.col("s_now"))
    return j.filter(~F.coalesce(same, F.lit(False))).select(
        *_KEY, F.coalesce("n_buckets", "n_buckets_now").alias("n_buckets"), "version", "n_now").checkpoint()


def _of_buckets(chunks: DataFrame, lines: DataFrame, stale: DataFrame) -> DataFrame:
    """The current rows that fall in stale buckets."""
    names = fresh(stale.select(*_KEY))
    few = stale.count() <= BROADCAST_BUCKETS
    return _current(chunks, lines).withColumn("bucket", _bucket()).join(F.broadcast(names) if few else names, _KEY, "left_semi")


def freshness(spark: SparkSession, root: str, chunks: DataFrame) -> DataFrame:
    """The keys that are not fresh (library_id, chunk_id, state), as :func:`vellum.plans.index.index_freshness`
    gives them; only stale buckets are opened."""
    root = root.rstrip("/")
    stale = stale_buckets(spark, root, chunks)
    stored = _rows_of(spark, root, stale.filter("version IS NOT NULL"))
    c = _of_buckets(chunks, _lines(spark, root), stale).select("library_id", "chunk_id", F.col("vector").alias("c_vec"))
    j = c.join(stored.select("library_id", "chunk_id", F.col("vector").alias("i_vec")), ["library_id", "chunk_id"], "full_outer")
    state = (F.when(F.col("i_vec").isNull(), F.lit("not_indexed")).when(F.col("c_vec").isNull(), F.lit("deleted"))
             .when(F.col("c_vec") != F.col("i_vec"), F.lit("changed")))
    return j.select("library_id", "chunk_id", state.alias("state")).filter(F.col("state").isNotNull())


def refresh(spark: SparkSession, root: str, chunks: DataFrame, libraries: DataFrame, *, mode: str = "lenient", build_id: int = 0) -> tuple[int | None, DataFrame]:
    """Brings the index to ``chunks``.  Libraries with a stale bucket are decided anew (:func:`build_index` over their chunks); of an
    accepted one only the stale buckets are written, a refused one leaves the index.  Returns the new version (None where all
    was fresh) and the report of the libraries decided."""
    root = root.rstrip("/")
    stale = stale_buckets(spark, root, chunks)
    names = fresh(stale.select("library_id").distinct()).checkpoint()
    few = names.count() <= BROADCAST_BUCKETS
    mine = chunks.join(F.broadcast(names) if few else names, "library_id", "left_semi")
    build = build_index(mine, libraries.join(names, "library_id", "left_semi"), mode=mode, build_id=build_id)
    if stale.isEmpty():
        return None, build.report
    settings = json.loads(fs.read_text(spark, f"{root}/_manifest-{index_versions(spark, root)[-1]:012d}.json"))
    lines = _lines(spark, root)
    meta = build.meta.checkpoint()
    held = lines.groupBy("library_id").agg(F.max("n_buckets").alias("held"))
    sizes = _sized(meta, settings["bucket_rows"]).join(fresh(held), "library_id", "left")
    # a library that is new, or has outgrown its buckets, is written whole; of the others the stale buckets
    whole = F.col("held").isNull() | (F.col("n_buckets") > GROWTH * F.col("held"))
    sizes = sizes.select("library_id", F.when(whole, F.col("n_buckets")).otherwise(F.col("held")).alias("n_buckets"), whole.alias("whole")).checkpoint()
    rows = build.index.join(fresh(sizes), "library_id").withColumn("bucket", _bucket())
    part = rows.filter("NOT whole").join(fresh(stale.select(*_KEY)), _KEY, "left_semi")
    rows = rows.filter("whole").unionByName(part.select(*rows.columns)).drop("whole", "bucket")
    kept = sizes.filter("NOT whole").select("library_id")
    gone = fresh(lines).join(names, "library_id", "left_semi").join(fresh(kept), "library_id", "left_anti").select(*_KEY).unionByName(stale.select(*_KEY)).distinct()
    old_meta = spark.read.schema(INDEX_META).parquet(f"{root}/meta/version={index_versions(spark, root)[-1]}")
    meta = old_meta.join(names, "library_id", "left_anti").unionByName(meta)
    return _write(spark, root, rows, lines, gone, meta, {"bucket_rows": settings["bucket_rows"]}), build.report
