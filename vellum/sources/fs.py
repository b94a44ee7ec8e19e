"""Small file operations through Hadoop's FileSystem API, so the same code
works on local paths, HDFS and object stores (whatever the session's Hadoop
configuration resolves the path to).  Used only for manifests: tiny files
written last to publish a version."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p))


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """Write ``body`` to a temporary name, then rename it into place (atomic
    where the store's rename is; a reader never sees a half-written file)."""
    jvm = spark.sparkContext._jvm
    fs, p = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs.mkdirs(p.getParent())
    out = fs.create(tmp, True)
    out.write(bytearray(body.encode("utf-8")))
    out.close()
    if fs.exists(p):                       # a rewrite: the old text stays under another name until the new one is there
        old = jvm.org.apache.hadoop.fs.Path(path + ".old")
        fs.delete(old, False)
        if not fs.rename(p, old):
            raise OSError(f"{path} could not be moved aside")
        if not fs.rename(tmp, p):
            fs.rename(old, p)
            raise OSError(f"{path} could not be replaced")
        fs.delete(old, False)
    elif not fs.rename(tmp, p):
        raise OSError(f"{path} could not be published")


def read_text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
