"""Point lookups, child listings and existence joins.

Lookups are filters on the composite key; when tables are written
partitioned or clustered by ``library_id`` the filter prunes partitions and
Parquet row groups at the scan.  Listing orders by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get_library(libraries: DataFrame, library_id: str) -> DataFrame:
    return libraries.filter(F.col("library_id") == library_id)


def get_document(documents: DataFrame, library_id: str, document_id: str) -> DataFrame:
    return documents.filter((F.col("library_id") == library_id) & (F.col("document_id") == document_id))


def get_chunk(chunks: DataFrame, library_id: str, document_id: str, chunk_id: str) -> DataFrame:
    return chunks.filter((F.col("library_id") == library_id) & (F.col("document_id") == document_id)
                         & (F.col("chunk_id") == chunk_id))


def lookup(table: DataFrame, keys: DataFrame, key_cols: list[str]) -> DataFrame:
    """F5 for a table of keys: rows of ``table`` whose key is in ``keys``.
    With ``found`` flags: :func:`found_flags`."""
    return table.join(keys.select(*key_cols).distinct(), key_cols, "left_semi")


def found_flags(keys: DataFrame, table: DataFrame, key_cols: list[str]) -> DataFrame:
    """Each requested key with ``found`` = exists in ``table``."""
    present = table.select(*key_cols).distinct().withColumn("found", F.lit(True))
    return (keys.select(*key_cols).distinct().join(present, key_cols, "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))


def list_documents(documents: DataFrame, library_id: str | None = None) -> DataFrame:
    """documents of a library (of every library when ``None``) in order."""
    d = documents if library_id is None else documents.filter(F.col("library_id") == library_id)
    return d.orderBy("library_id", "doc_pos", "document_id")


def list_chunks(chunks: DataFrame, library_id: str | None = None,
                document_id: str | None = None) -> DataFrame:
    """chunks of a document in order."""
    c = chunks
    if library_id is not None:
        c = c.filter(F.col("library_id") == library_id)
    if document_id is not None:
        c = c.filter(F.col("document_id") == document_id)
    return c.orderBy("library_id", "document_id", "chunk_pos", "chunk_id")


def drop_stale(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits whose chunk no longer exists vanish (``left_semi``)."""
    return hits.join(chunks.select("library_id", "chunk_id"), ["library_id", "chunk_id"], "left_semi")
