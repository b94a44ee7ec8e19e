"""Index jobs as tables.

One job indexes *every* library at once.  Its outputs:

* ``index``   one row per indexed vector (``library_id, chunk_id, vector,
  inv_norm, build_id``), partitioned by ``library_id`` when written;
* ``meta``    one row per indexed library (``library_id, dim, n, build_id``),
  including libraries whose index is empty;
* ``report``  one row per library with the checks that decided it.

A library is decided by one aggregate pass (partial aggregation map-side, so a
hot library costs no more than its share of rows).  The "first five ids" of
the empty-vector report come from a ranked window limited to 5 per library,
never from collecting a library's ids.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import has_non_finite, inv_norm
from ..schema import INDEX, INDEX_META
from ..session import ensure_checkpoint_dir, fresh
from ..sources import fs

_MANIFEST = "_manifest-"
#: Accepted libraries up to this many are broadcast to the vectors (some 50 bytes each).
BROADCAST_LIBRARIES = 200_000
_VERSIONED_META = T.StructType([*INDEX_META.fields, T.StructField("version", T.LongType())])


@dataclass
class IndexBuild:
    index: DataFrame
    meta: DataFrame
    report: DataFrame
    sample: DataFrame | None = None


def _empty_vec(col: str = "embedding"):
    return F.col(col).isNull() | (F.size(col) == 0)


def first_ids(df: DataFrame, key: str, id_col: str, n: int = 5, out: str = "first_ids") -> DataFrame:
    """The ``n`` smallest ids per key as a comma-joined string, via a window
    limited to ``n`` rows per key (a partial WindowGroupLimit runs before the
    shuffle, so a hot key ships at most ``n`` rows per task)."""
    w = Window.partitionBy(key).orderBy(id_col)
    return (df.select(key, id_col).withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") <= n)
            .groupBy(key)
            .agg(F.array_join(F.array_sort(F.collect_list(id_col)), ", ").alias(out)))


def library_stats(chunks: DataFrame, libraries: DataFrame | None = None) -> DataFrame:
    """V2 + A1 + A2 per library in one partial aggregate: chunk count,
    empty-vector count, distinct dimensions.  ``libraries`` (optional) adds
    libraries without chunks as zero rows."""
    agg = (chunks.groupBy("library_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.when(_empty_vec(), 1).otherwise(0)).cast("long").alias("n_empty"),
        F.array_sort(F.collect_set(F.when(~_empty_vec(), F.size("embedding")))).alias("dims"),
    ))
    if libraries is not None:
        agg = libraries.select("library_id").join(agg, "library_id", "left")
    return agg.select(
        "library_id",
        F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"),
        F.coalesce("n_empty", F.lit(0)).cast("long").alias("n_empty"),
        F.coalesce("dims", F.array().cast("array<int>")).alias("dims"),
    )


def library_report(chunks: DataFrame, libraries: DataFrame | None = None) -> DataFrame:
    """V1 + V2 + A1 + A2 per library: :func:`library_stats` plus the first
    five ids of chunks with an empty vector."""
    empties = first_ids(chunks.filter(_empty_vec()), "library_id", "chunk_id", 5, "first_empty")
    rep = library_stats(chunks, libraries).join(empties, "library_id", "left")
    return rep.select("library_id", "n_chunks", "n_empty",
                      F.coalesce("first_empty", F.lit("")).alias("first_empty"), "dims")


def build_index(chunks: DataFrame, libraries: DataFrame, *, mode: str = "strict",
                build_id: int = 0, sample_fraction: float | None = None, seed: int = 7) -> IndexBuild:
    """X1 (``mode='strict'``): a library with any empty vector or with more
    than one dimension is refused; a library with no chunks gets an empty
    index.  X2 (``mode='lenient'``): empty vectors are skipped first (F4); a
    library left with nothing to index gets no index; mixed dimensions are
    still refused (the reference's build would raise on them).  Both refuse a
    library with a vector holding a null, NaN or infinite component
    (``non_finite``), and one in which two rows carry the same chunk id
    (``duplicate_ids``): a hit could not name its row.

    ``sample_fraction`` also keeps a seeded row sample of the index; searches
    use it to bound the candidates each task emits (see ``knn_join``)."""
    if mode == "strict":
        status = (F.when(F.col("n_empty") > 0, F.lit("empty_embeddings"))
                  .when(F.size("dims") > 1, F.lit("inconsistent_dimensions"))
                  .otherwise(F.lit("indexed")))
    elif mode == "lenient":
        status = (F.when(F.col("n_chunks") - F.col("n_empty") == 0, F.lit("nothing_to_index"))
                  .when(F.size("dims") > 1, F.lit("inconsistent_dimensions"))
                  .otherwise(F.lit("indexed")))
    else:
        raise ValueError(f"mode must be 'strict' or 'lenient', not {mode!r}")
    # one scan decides: per chunk id first, as an id given twice, or a component that is no number, would
    # make wrong rankings; no vector is shuffled
    size = F.when(~_empty_vec(), F.size("embedding"))
    ids = chunks.groupBy("library_id", "chunk_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(_empty_vec(), 1)).alias("e"), F.min(size).alias("low"), F.max(size).alias("high"),
        F.max(F.coalesce(has_non_finite("embedding"), F.lit(False))).alias("bad"))
    per = ids.groupBy("library_id").agg(
        F.sum("n").alias("n_chunks"), F.sum("e").alias("n_empty"), F.array_union(F.collect_set("low"), F.collect_set("high")).alias("dims"),
        F.max("bad").alias("_nonfinite"), (F.max("n") > 1).alias("_twice"))
    per = libraries.select("library_id").join(per, "library_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    decided = per.select("library_id", zero("n_chunks"), zero("n_empty"), F.array_sort(F.coalesce("dims", F.array().cast("array<int>"))).alias("dims"),
                         "_nonfinite", "_twice")
    decided = (decided.withColumn("status", status)
               .withColumn("status", F.when(F.col("status") != "indexed", F.col("status"))
                           .when(F.col("_nonfinite"), F.lit("non_finite"))
                           .when(F.col("_twice"), F.lit("duplicate_ids")).otherwise(F.col("status")))
               .drop("_nonfinite", "_twice"))
    # written once: index, meta and report all read it
    ensure_checkpoint_dir(chunks.sparkSession)
    decided = decided.checkpoint()
    # the report adds the first empty ids; the index and meta need only the decision
    empties = first_ids(chunks.filter(_empty_vec()), "library_id", "chunk_id", 5, "first_empty")
    report = (decided.join(empties, "library_id", "left")
              .select("library_id", "n_chunks", "n_empty",
                      F.coalesce("first_empty", F.lit("")).alias("first_empty"), "dims", "status"))
    ok = decided.filter(F.col("status") == "indexed")
    meta = ok.select(
        "library_id",
        F.element_at(F.when(F.size("dims") > 0, F.col("dims")), 1).cast("int").alias("dim"),
        (F.col("n_chunks") - F.col("n_empty")).cast("long").alias("n"),
        F.lit(build_id).cast("long").alias("build_id"),
    )
    vecs = chunks.filter(~_empty_vec()) if mode == "lenient" else chunks
    names = ok.select("library_id")
    few = names.count() <= BROADCAST_LIBRARIES
    index = (vecs.join(F.broadcast(names) if few else names, "library_id", "left_semi")
             .select("library_id", "chunk_id",
                     F.col("embedding").alias("vector"),
                     inv_norm("embedding").alias("inv_norm"),
                     F.lit(build_id).cast("long").alias("build_id")))
    sample = index.sample(fraction=sample_fraction, seed=seed) if sample_fraction else None
    return IndexBuild(index, meta, report, sample)


def index_freshness(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Compare an index with the current chunks.  One row per key that is
    not fresh: ``not_indexed`` (chunk has a vector but no index row),
    ``deleted`` (index row whose chunk is gone), ``changed`` (vector differs)."""
    c = chunks.filter(~_empty_vec()).select("library_id", "chunk_id", F.col("embedding").alias("c_vec"))
    i = index.select("library_id", "chunk_id", F.col("vector").alias("i_vec"))
    j = c.join(i, ["library_id", "chunk_id"], "full_outer")
    state = (F.when(F.col("i_vec").isNull(), F.lit("not_indexed"))
             .when(F.col("c_vec").isNull(), F.lit("deleted"))
             .when(F.col("c_vec") != F.col("i_vec"), F.lit("changed")))
    return j.select("library_id", "chunk_id", state.alias("state")).filter(F.col("state").isNotNull())


def index_counts(chunks: DataFrame, documents: DataFrame, libraries: DataFrame,
                 meta: DataFrame) -> DataFrame:
    """A1: per library, documents, chunks and index size (zeros kept)."""
    d = documents.groupBy("library_id").agg(F.count(F.lit(1)).alias("n_documents"))
    c = chunks.groupBy("library_id").agg(F.count(F.lit(1)).alias("n_chunks"),
                                         F.countDistinct("document_id").alias("n_documents_with_chunks"))
    m = meta.select("library_id", F.col("n").alias("n_indexed"))
    out = libraries.select("library_id").join(d, "library_id", "left").join(c, "library_id", "left") \
        .join(m, "library_id", "left")
    return out.select(
        "library_id",
        *[F.coalesce(col, F.lit(0)).cast("long").alias(col)
          for col in ("n_documents", "n_chunks", "n_documents_with_chunks", "n_indexed")])


def index_versions(spark, path: str) -> list[int]:
    """Published versions of the index at ``path``, oldest first."""
    return [int(n[len(_MANIFEST):-len(".json")]) for n in fs.list_names(spark, path)
            if n.startswith(_MANIFEST) and n.endswith(".json")]


def write_index(build: IndexBuild, path: str) -> int:
    """Publish a build as a new version of the index at ``path`` (U3) and return
    its number.

    A build replaces the libraries it decided (those of its report): one that
    it refused or left with nothing loses its index, and libraries it does not
    name keep theirs.  ``index`` rows and the ``sample`` go to folders of the new
    version, partitioned by ``library_id``; ``meta`` is written whole, each library
    with the version that holds its rows.  The manifest comes last, so a reader
    sees the old version or the new one, never parts of both.  One writer at a time."""
    spark, root = build.index.sparkSession, path.rstrip("/")
    versions = index_versions(spark, root)
    # a version directory that a failed write left has no manifest: its number is not used again
    used = [int(n[len("version="):]) for n in fs.list_names(spark, f"{root}/index") if n.startswith("version=")]
    version = max([0, *versions, *used]) + 1
    sub = f"version={version}"
    build.index.write.partitionBy("library_id").parquet(f"{root}/index/{sub}")
    if build.sample is not None:
        build.sample.write.partitionBy("library_id").parquet(f"{root}/sample/{sub}")
    meta = build.meta.withColumn("version", F.lit(version).cast("long"))
    if versions:
        old = _read_meta(spark, root, versions[-1])
        meta = old.join(fresh(build.report.select("library_id")), "library_id", "left_anti").unionByName(fresh(meta))
    meta.write.parquet(f"{root}/meta/{sub}")
    fs.write_text(spark, f"{root}/{_MANIFEST}{version:012d}.json", json.dumps({"version": version}))
    return version


def _read_meta(spark, root: str, version: int) -> DataFrame:
    return spark.read.schema(_VERSIONED_META).parquet(f"{root}/meta/version={version}")


def _current(spark, root: str, part: str, meta: DataFrame) -> DataFrame:
    """Rows of ``part`` that the published ``meta`` names; both join columns are
    partition folders, so the small ``meta`` prunes the scan."""
    schema = T.StructType([*INDEX.fields, T.StructField("version", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{root}/{part}")
    return (rows.join(fresh(meta.select("version", "library_id")), ["version", "library_id"], "left_semi")
            .select(*INDEX.fieldNames()))


def read_index(spark, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``(index, meta)`` pair of a published version (the newest)."""
    root = path.rstrip("/")
    versions = index_versions(spark, root)
    if not versions or version is not None and version not in versions:
        raise LookupError(f"no published index{'' if version is None else f' version {version}'} at {root}")
    meta = _read_meta(spark, root, versions[-1] if version is None else version)
    return _current(spark, root, "index", meta), meta.select(*INDEX_META.fieldNames())


def read_sample(spark, path: str) -> DataFrame | None:
    """The stored sample of the newest version, or None where no build kept one.
    Libraries whose build kept none have no rows in it, which only costs speed."""
    root = path.rstrip("/")
    if not fs.list_names(spark, f"{root}/sample"):
        return None
    return _current(spark, root, "sample", _read_meta(spark, root, index_versions(spark, root)[-1]))
