"""Session helpers.

Library code never creates its own session; it takes the caller's.  These
helpers exist for tests, the bench and the driver entry point, and for the
one piece of session state jobs need: a shared checkpoint directory.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings a local run needs.  On a cluster the deployment sets these.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "vellum", extra_conf: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    for k, v in {**LOCAL_CONF, **(extra_conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vellum`` importable in Python workers (pandas UDFs pickle their
    functions by module): zip the package once per SparkContext and add it
    with ``addPyFile``, as ``--py-files`` would on a cluster."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="vellum-pyfiles-"), "vellum.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def prepare(spark: SparkSession) -> str:
    """Everything a job needs from the session: the package on the workers
    and the checkpoint directory.  Returns the checkpoint directory."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, setting a scratch one only
    when none is configured (local runs and tests).  On a cluster the shared
    directory named in ``spark.checkpoint.dir`` is used as is."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder; "
                           "a machine-local scratch folder is not safe on a cluster")
    else:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


def stored(df):
    """``df`` written once as Parquet under the checkpoint folder and read back.  A checkpoint also cuts the
    lineage, but its frame keeps the constraints of the plan, and in a loop they multiply from turn to turn."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df):
    """``df`` with every column re-aliased, so it can be joined with a frame
    of the same lineage without ambiguous self-join references."""
    from pyspark.sql import functions as F
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])
