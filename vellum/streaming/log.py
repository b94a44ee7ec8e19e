"""A keyed table kept as a log (M1): append, merge on read, compact.

A batch of changes is reduced to the newest per key and written as one folder of change files;
nothing that is stored is read or rewritten, so a batch costs what its own rows
cost.  Readers merge: a base row holds unless a change file has its key, and of what competes for
a key the newest by the order columns wins, deletes included (a late, older change cannot
revive a key).  Rows of a key that are equal in the order columns and differ otherwise are decided by a digest of
their content, the same whatever order they arrive in.

``compact`` folds the change files into the base, bucket by bucket (a hash of the key); buckets that no change
touched are neither read nor written.  Writers call it when changes outgrow ``COMPACT_ROWS`` and a
share of the base.

A version is what its manifest lists, written last and renamed into place.  The manifest also records the keys, the order, the
schema, the number of buckets and the last batch of every stream.  One writer at a time.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.mutate import content_hash, latest_per_key
from ..session import fresh
from ..sources import fs
from ..sources.snapshot import manifest_name, versions

#: Rows of one change file.
FILE_ROWS = 1_000_000
#: Changes that are compacted: more rows than this, and than this share of the base.
COMPACT_ROWS = 1_000_000
COMPACT_SHARE = 0.5


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest published manifest, None before the first."""
    vs = versions(spark, root)
    return json.loads(fs.read_text(spark, f"{root.rstrip('/')}/{manifest_name(vs[-1])}")) if vs else None


def _publish(spark: SparkSession, root: str, m: dict) -> None:
    fs.write_text(spark, f"{root.rstrip('/')}/{manifest_name(m['version'])}", json.dumps(m))


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key; ties in ``order`` by content."""
    payload = [c for c in rows.columns if c not in keys]
    hashed = rows.withColumn("_h", content_hash(rows, payload))
    return latest_per_key(hashed, keys, [*order, "_h"]).select(*rows.columns)


def append(spark: SparkSession, root: str, rows: DataFrame, keys: list[str], order: list[str], *, op_col: str = "op",
           buckets: int = 64, stream: str = "", batch: int = -1) -> bool:
    """Publishes one batch of changes (``rows`` with ``op_col``: 'delete', or anything else to store the row).  False if
    ``stream`` has published ``batch`` before.  Another number of buckets, key or order than the table has is refused."""
    m = manifest(spark, root)
    kind = {"buckets": buckets, "keys": list(keys), "order": list(order), "op": op_col, "schema": json.loads(rows.schema.json())}
    if m is None:
        m = {"version": -1, "batches": {}, "base": {}, "base_rows": {}, "changes": [], **kind}
    if m["buckets"] != buckets:
        raise ValueError(f"the table at {root} is kept in {m['buckets']} buckets, not {buckets}")
    if (m["keys"], m["order"]) != (kind["keys"], kind["order"]):
        raise ValueError(f"the table at {root} has keys {m['keys']} and order {m['order']}")
    if stream and m["batches"].get(stream, -1) >= batch:
        return False                                         # published before the stream was stopped
    version = m["version"] + 1
    out = f"{root.rstrip('/')}/v{version:012d}-{stream or 'batch'}-{batch}"
    last = newest(rows, keys, order).withColumn("bkt", _bucket(keys, buckets))
    # as many files as the batch needs, whatever the number of buckets; rows in order of them
    few = max(1, math.ceil(rows.count() / FILE_ROWS))
    last.repartitionByRange(few, "bkt", *keys).sortWithinPartitions("bkt").write.mode("overwrite").parquet(out)
    count = {str(r[0]): r[1] for r in spark.read.parquet(out).groupBy("bkt").count().collect()}          # one a bucket at most
    if count:
        m = {**m, "changes": [*m["changes"], {"dir": out, "rows": count}]}
    if stream:
        m = {**m, "batches": {**m["batches"], stream: batch}}
    _publish(spark, root, {**m, "version": version})
    return True


def _merged(spark: SparkSession, m: dict, only: set[str] | None = None) -> DataFrame:
    """The newest row of every key, deletes included, of all or of ``only`` some buckets."""
    schema = T.StructType.fromJson(m["schema"])
    with_bkt = T.StructType([*schema.fields, T.StructField("bkt", T.IntegerType())])
    base = [d for b, d in sorted(m["base"].items()) if only is None or b in only]
    files = [c["dir"] for c in m["changes"]]
    read = lambda paths, s: spark.read.schema(s).parquet(*paths) if paths else spark.createDataFrame([], s)
    stored = read(base, schema)
    if not files:
        return stored
    changed = read(files, with_bkt)
    if only is not None:
        changed = changed.filter(F.col("bkt").isin(sorted(map(int, only))))
    changed = newest(changed.drop("bkt"), m["keys"], m["order"])
    if not base:
        return changed
    # base rows that no change competes with stay where they are; the others are few
    keys = fresh(changed.select(*m["keys"]))
    contested = stored.join(keys, m["keys"], "left_semi").unionByName(changed)
    return stored.join(keys, m["keys"], "left_anti").unionByName(newest(contested, m["keys"], m["order"]))


def read(spark: SparkSession, root: str, deletes: bool = False) -> DataFrame:
    """The newest version of the table; with ``deletes`` the op column and the deleted keys' rows too."""
    m = manifest(spark, root)
    if m is None:
        raise FileNotFoundError(f"no published rows under {root}")
    rows = _merged(spark, m)
    return rows if deletes else rows.filter(F.col(m["op"]) != "delete").drop(m["op"])


def compact(spark: SparkSession, root: str, force: bool = False) -> bool:
    """Folds the change files into the base when they have outgrown it (or ``force``)."""
    m = manifest(spark, root)
    if m is None or not m["changes"]:
        return False
    changed = sum(sum(c["rows"].values()) for c in m["changes"])
    if not force and changed <= max(COMPACT_ROWS, COMPACT_SHARE * sum(m["base_rows"].values())):
        return False
    touched = {b for c in m["changes"] for b in c["rows"]}
    version = m["version"] + 1
    out = f"{root.rstrip('/')}/v{version:012d}-compact"
    rows = _merged(spark, m, touched).withColumn("bkt", _bucket(m["keys"], m["buckets"]))
    rows.repartition(len(touched), "bkt").write.mode("overwrite").partitionBy("bkt").parquet(out)
    written = {n.split("=", 1)[1] for n in fs.list_names(spark, out) if n.startswith("bkt=")}
    count = {str(r[0]): r[1] for r in spark.read.parquet(out).groupBy("bkt").count().collect()}
    base = {**{b: d for b, d in m["base"].items() if b not in touched}, **{b: f"{out}/bkt={b}" for b in written}}
    base_rows = {**{b: n for b, n in m["base_rows"].items() if b not in touched}, **count}
    _publish(spark, root, {**m, "version": version, "base": base, "base_rows": base_rows, "changes": []})
    return True


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes manifests before the newest ``keep``, and folders that none of these lists (files of
    versions that readers may still hold must be within ``keep``).  Returns the removed names."""
    vs = versions(spark, root)
    kept = [json.loads(fs.read_text(spark, f"{root.rstrip('/')}/{manifest_name(v)}")) for v in vs[-keep:]]
    if not kept:
        return []
    live = {d.rsplit("/v", 1)[1].split("/")[0] for m in kept for d in [*m["base"].values(), *[c["dir"] for c in m["changes"]]]}
    newest_version = kept[-1]["version"]
    gone = [n for n in fs.list_names(spark, root) if n.startswith("v") and n[1:] not in live and n[1:13].isdigit() and int(n[1:13]) <= newest_version]
    old = [manifest_name(v) for v in vs[:-keep]]
    for name in [*old, *gone]:
        fs.remove(spark, f"{root.rstrip('/')}/{name}")
    return [*old, *gone]
