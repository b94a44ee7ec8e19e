"""Search under typed predicates (:mod:`vellum.functions.predicates`), one per query.

*After* the top-k (``search`` of :mod:`vellum.plans.search` with a ``predicate`` column) a query keeps those of its k
hits that match.  *Before* it (:func:`knn_where`) a query gets the k best of the rows that match.

Before: the distinct predicates of the batch, few against its queries, are constants of the plan.  Every row is
asked each of them once, by built-in expressions, and the numbers of those it satisfies travel with its vector;
in a task a query is multiplied with the rows of its predicate only.  No row is copied per query or predicate.

:func:`write_filterable` clusters rows by a numeric key and publishes the least and largest number of chosen keys for every file;
:func:`read_filterable` opens only files in which some predicate can match.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import predicates as P
from ..operators.knn import CAND_SCHEMA, QUERY_KEY, _emit, _reduce_candidates, _salt_for, arrow_matrix, block_topk, inv_norms, merge_topk
from ..schema import DEFAULT_K
from ..session import fresh, stored
from ..sources import fs
from ..sources.snapshot import manifest_name, versions

#: Distinct predicates of one pass over the rows, queries of one pass, and bytes of their vectors.
PASS_PREDICATES = 256
PASS_QUERIES = 20_000
PASS_BYTES = 32 << 20
#: Rows of one file of a filterable table.
FILE_ROWS = 1_000_000


def _numbered(queries: DataFrame) -> tuple[DataFrame, int]:
    """Queries with ``_p``, the number of their predicate, and how many passes answer them."""
    text = F.coalesce(F.to_json("predicate"), F.lit("[]"))
    q = stored(queries.withColumn("_text", text))
    n, size, kinds = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(64) + 8 * F.coalesce(F.size("embedding"), F.lit(0))), F.lit(0)),
                           F.count_distinct("_text")).first()
    passes = max(1, math.ceil(n / PASS_QUERIES), math.ceil(size / PASS_BYTES), math.ceil(kinds / PASS_PREDICATES))
    # queries of one predicate share passes where there are many predicates, and spread where there are many queries
    by = "_text" if kinds > PASS_PREDICATES else "query_id"
    return q.withColumn("_pass", F.pmod(F.xxhash64(by), F.lit(passes))), passes


def knn_where(rows: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """The k best matching rows of each query's library: ``rows`` (``library_id, chunk_id, vector, inv_norm, metadata``), ``queries``
    (``query_id, library_id, embedding, predicate`` and, unless ``k`` is given, ``k``).  Same output as
    :func:`vellum.operators.knn.knn_join`; a query that too few rows match gets fewer."""
    queries = queries.withColumn("k", F.coalesce(F.lit(k) if k is not None else F.col("k"), F.lit(DEFAULT_K)).cast("int"))
    q, passes = _numbered(queries.select("query_id", "library_id", "embedding", "k", "predicate"))
    # one pass at a time: a pass's queries and candidates are gone when the next one begins
    keep = stored if passes > 1 else lambda x: x
    found = [keep(_one_pass(rows, q.filter(F.col("_pass") == i))) for i in range(passes)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _one_pass(rows: DataFrame, q: DataFrame) -> DataFrame:
    asked = q.select("query_id", "library_id", "embedding", "k", "predicate", "_text").toArrow()
    texts = sorted(set(asked.column("_text").to_pylist()))
    number = {t: i for i, t in enumerate(texts)}
    trees: dict[int, list[dict]] = {}
    by: dict = {}
    for r in asked.to_pylist():
        p = number[r["_text"]]
        trees[p] = r["predicate"] or []
        by.setdefault(r["library_id"], {}).setdefault(p, []).append(r)
    packed = {lib: {p: (np.array([r["query_id"] for r in some], object), np.array([r["embedding"] for r in some], np.float64), np.array([r["k"] for r in some], np.int64))
                    for p, some in groups.items()} for lib, groups in by.items()}
    kmax = max([1, *(r["k"] for r in asked.select(["k"]).to_pylist())])
    satisfied = F.filter(F.array(*[F.when(P.matches(F.col("metadata"), P.literal(trees[i])), F.lit(i)) for i in range(len(texts))]), lambda x: x.isNotNull()) \
        if texts else F.array().cast("array<int>")
    libs = [x for x in packed if x is not None]
    some = rows.filter(F.col("library_id").isin(libs)).select("library_id", "chunk_id", "vector", "inv_norm", satisfied.alias("_m")).filter(F.size("_m") > 0)
    # a task hands on k hits a query, so there are no more tasks than run at once, however many rows
    some = some.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    shared = rows.sparkSession.sparkContext.broadcast(packed)
    arrow_schema = to_arrow_schema(CAND_SCHEMA)

    def run(batches):
        pending, held = [], 0
        for b in batches:
            lib = np.array(b.column("library_id").to_pylist(), object)
            ids, inv = b.column("chunk_id").to_numpy(zero_copy_only=False), b.column("inv_norm").to_numpy()
            match = b.column("_m")
            row, which = np.repeat(np.arange(len(b)), match.value_lengths().to_numpy()), match.flatten().to_numpy()
            for name in set(lib):
                for p, (q_ids, raw, ks) in shared.value.get(name, {}).items():
                    mine = row[(which == p) & (lib[row] == name)]
                    if not len(mine):
                        continue
                    c = arrow_matrix(b.column("vector").take(pa.array(mine)))
                    if c.shape[1] != raw.shape[1]:
                        continue
                    best = block_topk(q_ids, raw, inv_norms(raw), ks, ids[mine], c, inv[mine])
                    pending.append(_emit(q_ids, np.full(len(q_ids), name, object), ks, ids[mine], best))
                    held += len(best)
            if held > 200_000:
                pending = [_reduce_candidates(pd.concat(pending, ignore_index=True))]
                held = len(pending[0])
        if pending:
            yield pa.RecordBatch.from_pandas(_reduce_candidates(pd.concat(pending, ignore_index=True)), schema=arrow_schema, preserve_index=False)

    return merge_topk(some.mapInArrow(run, CAND_SCHEMA), kmax, _salt_for(rows.sparkSession))


def write_filterable(rows: DataFrame, root: str, keys: list[str], cluster: str, file_rows: int = FILE_ROWS) -> int:
    """Publishes ``rows`` (with ``metadata``) as files in order of the number under ``cluster``, with the least
    and largest number under each of ``keys`` for every file in the manifest.  Returns the version."""
    spark, root = rows.sparkSession, root.rstrip("/")
    version = max([-1, *versions(spark, root)]) + 1
    out = f"{root}/v{version:012d}"
    number = lambda key: F.element_at("metadata", key).try_cast("double")
    files = max(1, math.ceil(rows.count() / file_rows))
    rows.repartitionByRange(files, number(cluster).asc_nulls_last(), F.xxhash64("chunk_id")).write.mode("overwrite").parquet(out)
    per = []
    for i, key in enumerate(keys):
        v = F.when(~F.isnan(number(key)), number(key))
        per += [F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"), F.count(v).alias(f"n{i}")]
    stats = spark.read.parquet(out).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *per).collect()     # one row a file
    listed = {r["file"]: {k: [r[f"l{i}"], r[f"h{i}"], r[f"n{i}"], r["rows"]] for i, k in enumerate(keys)} for r in stats}
    fs.write_text(spark, f"{root}/{manifest_name(version)}", json.dumps({"version": version, "dir": out, "schema": json.loads(rows.schema.json()), "files": listed}))
    return version


def read_filterable(spark: SparkSession, root: str, predicates: list[list[dict]] | None = None) -> DataFrame:
    """The rows of the newest version; with ``predicates``, of the files in which one of them can match."""
    root = root.rstrip("/")
    m = json.loads(fs.read_text(spark, f"{root}/{manifest_name(versions(spark, root)[-1])}"))
    schema = T.StructType.fromJson(m["schema"])
    paths = [f"{m['dir']}/{f}" for f, stats in sorted(m["files"].items()) if predicates is None or any(P.may_match(p, stats) for p in predicates)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def batch_predicates(queries: DataFrame, most: int = 10_000) -> list[list[dict]] | None:
    """The distinct predicates of a batch, for :func:`read_filterable`; None where there are more than ``most``."""
    found = queries.select(F.to_json("predicate").alias("t"), "predicate").groupBy("t").agg(F.first("predicate").alias("p")).limit(most + 1).toArrow().to_pylist()
    return None if len(found) > most else [r["p"] or [] for r in found]


def keep_matching(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Post-filter: the hits (with ``metadata``) that satisfy their query's predicate."""
    p = fresh(queries.select(*QUERY_KEY, "predicate"))
    return hits.join(p, QUERY_KEY).filter(P.matches(F.col("metadata"), F.col("predicate"))).drop("predicate")
