"""Versioned tables as a Spark data source (S1, S2): ``spark.read.format("vellum")``.

``path`` holds one table.  A write puts every task's rows into files of its own under a new version's folder; the
driver's ``commit`` lists the files of the tasks that succeeded in a manifest, written last and renamed into place, and ``abort``
removes the folder.  So a failed write leaves no version, and a retried task's first file is in none.  A read takes the newest manifest, or the
one of ``option("version", n)``, one partition a file; a pushed-down column list reads those columns only.
``mode("append")`` publishes a version of the older files and the new ones, ``overwrite`` one of the new ones alone.

Files go through Arrow's file systems, so a path may be local, HDFS or an object store that Arrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_MANIFEST = "_manifest-"
#: Rows of one file.
FILE_ROWS = 500_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:"):])
    return fs.LocalFileSystem(), path


def manifests(path: str) -> list[int]:
    """Published versions under ``path``, oldest first."""
    files, root = _open(path.rstrip("/"))
    names = [x.base_name for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    return sorted(int(n[len(_MANIFEST):-len(".json")]) for n in names if n.startswith(_MANIFEST) and n.endswith(".json"))


def _manifest(path: str, version: int | None) -> dict:
    found = manifests(path)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"no published version{'' if version is None else f' {version}'} under {path}")
    files, root = _open(path.rstrip("/"))
    with files.open_input_stream(f"{root}/{_MANIFEST}{found[-1] if version is None else version:012d}.json") as f:
        return json.loads(f.read())


@dataclass
class _File(InputPartition):
    name: str


@dataclass
class _Written(WriterCommitMessage):
    names: list
    rows: int


class VersionedTable(DataSource):
    """``format("vellum")``; options ``path`` and, for reads, ``version``."""

    @classmethod
    def name(cls) -> str:
        return "vellum"

    def schema(self) -> StructType:
        m = _manifest(self.options["path"], int(self.options["version"]) if "version" in self.options else None)
        return StructType.fromJson(m["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.schema = options["path"].rstrip("/"), schema
        self.files = _manifest(self.path, int(options["version"]) if "version" in options else None)["files"]

    def partitions(self) -> list[InputPartition]:
        return [_File(n) for n in self.files]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not self.files:
            return
        files, root = _open(self.path)
        want = to_arrow_schema(self.schema)
        with files.open_input_file(f"{root}/{partition.name}") as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=4096, columns=self.schema.names):
                yield pa.RecordBatch.from_arrays([batch.column(x.name).cast(x.type) for x in want], schema=want)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path.rstrip("/"), schema, overwrite
        self.folder = f"v-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _open(self.path)
        files.create_dir(f"{root}/{self.folder}", recursive=True)
        schema, names, rows, out, held = to_arrow_schema(self.schema), [], 0, None, 0
        try:
            for batch in iterator:
                if not len(batch):
                    continue
                if out is None or held >= FILE_ROWS:
                    if out is not None:
                        out.close()
                    # a name of this attempt: a retry writes other files
                    names.append(f"{self.folder}/{uuid.uuid4().hex}.parquet")
                    out, held = pq.ParquetWriter(f"{root}/{names[-1]}", schema, filesystem=files), 0
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema))
                held, rows = held + len(batch), rows + len(batch)
        finally:
            if out is not None:
                out.close()
        return _Written(names, rows)

    def commit(self, messages: list) -> None:
        done = [m for m in messages if m is not None]
        found = manifests(self.path)
        old = _manifest(self.path, None) if found and not self.overwrite else None
        if old is not None and old["schema"] != json.loads(self.schema.json()):
            self.abort(messages)
            raise ValueError("the rows do not have the table's schema")
        version = (found[-1] if found else 0) + 1
        body = {"version": version, "schema": json.loads(self.schema.json()), "rows": sum(m.rows for m in done) + (old["rows"] if old else 0),
                "files": [*(old["files"] if old else []), *sorted(n for m in done for n in m.names)]}
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        name = f"{root}/{_MANIFEST}{version:012d}.json"
        with files.open_output_stream(f"{name}.tmp") as f:
            f.write(json.dumps(body).encode())
        files.move(f"{name}.tmp", name)

    def abort(self, messages: list) -> None:
        files, root = _open(self.path)
        if files.get_file_info(f"{root}/{self.folder}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.folder}")


def register(spark: SparkSession) -> None:
    """Makes ``format("vellum")`` known to the session."""
    spark.dataSource.register(VersionedTable)
