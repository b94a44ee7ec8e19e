"""Text to vector.

A *provider* turns a list of texts into a list of vectors; any model client
fits (a hosted API, a local ONNX model...).  :func:`embed_column` runs it in
Arrow batches through an iterator Arrow UDF, which holds the texts of one call and the vectors as floats: one provider per task, or per
Python worker where it has a name (created from a picklable factory, so clients
are not shipped with the closure), texts sent in batches of ``batch_size``, order kept.  As in
the reference, a batch whose call fails yields empty vectors for all its
texts rather than failing the job; callers split those off (E2).

The built-in :class:`HashingProvider` needs no network: signed-free feature
hashing of lower-cased ASCII word tokens into ``dim`` buckets by the first 8
hex digits of the token's md5, L2-normalised.  It is deterministic, so the
same vectors can be computed in SQL for checking.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..schema import VECTOR
from ..session import ensure_checkpoint_dir
from .mutate import CHUNK, DOC, LIB, Corpus3, add_chunks, gate


class EmbeddingProvider(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


# Fixed values of the built-in provider: token pattern and bucket rule.
TOKEN_SPLIT = re.compile(r"[^a-z0-9]+")
HASH_HEX_DIGITS = 8


class HashingProvider:
    """Deterministic feature-hashing embeddings (no model, no network)."""

    def __init__(self, dim: int = 64, memo_size: int = 1 << 16):
        self.dim = dim
        self._memo: dict[str, int] = {}
        self._memo_size = memo_size

    def tokens(self, text: str) -> list[str]:
        return [t for t in TOKEN_SPLIT.split(text.lower()) if t]

    def bucket(self, token: str) -> int:
        b = self._memo.get(token)
        if b is None:
            b = int(hashlib.md5(token.encode("utf-8")).hexdigest()[:HASH_HEX_DIGITS], 16) % self.dim
            if len(self._memo) >= self._memo_size:   # bounded per worker
                self._memo.clear()
            self._memo[token] = b
        return b

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            toks = self.tokens(text or "")
            counts = np.bincount([self.bucket(t) for t in toks], minlength=self.dim).astype(np.float64)
            n = np.sqrt(np.sum(counts * counts))
            out.append((counts / n if n > 0 else counts).astype(np.float32).tolist())
        return out


# Providers that a caller named, kept by a Python worker from task to task.
_PROVIDERS: dict[str, EmbeddingProvider] = {}


def _provider(factory: Callable[[], EmbeddingProvider], name: str | None) -> EmbeddingProvider:
    if name is None:
        return factory()
    if name not in _PROVIDERS:
        _PROVIDERS[name] = factory()
    return _PROVIDERS[name]


def hashed_embedding(text, dim: int = 64):
    """The vector of :class:`HashingProvider` as an expression: no Python, whatever the texts."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT.pattern), lambda t: t != "")
    bucket = F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, HASH_HEX_DIGITS), 16, 10).cast("long") % dim).cast("int"))
    # the count of a bucket is what its removal takes away
    counts = F.transform(F.array(bucket), lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(b) - F.size(F.array_remove(b, i))).cast("double")))
    unit = F.transform(counts, lambda c: F.transform(F.array(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))), lambda n: F.transform(
        c, lambda x: F.when(n > 0, x / n).otherwise(x).cast("float"))))
    return F.flatten(unit)[0]


def embed_column(df: DataFrame, text_col: str, out_col: str = "embedding",
                 factory: Callable[[], EmbeddingProvider] = HashingProvider,
                 batch_size: int = 96, name: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` (array<float>) embedding ``text_col``; a failed
    provider batch gives empty vectors for its texts.  Each task makes its own
    provider; one with a ``name`` stays in the worker and serves later tasks that
    ask for that name."""

    kind = to_arrow_type(VECTOR)

    @F.arrow_udf(VECTOR)
    def _embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        prov = _provider(factory, name)
        for texts in batches:
            out: list = []
            for s in range(0, len(texts), batch_size):
                part = [t or "" for t in texts.slice(s, batch_size).to_pylist()]
                try:
                    vecs = prov.embed(part)
                    if len(vecs) != len(part):
                        raise ValueError("provider returned a different number of vectors")
                    out.append(pa.array([np.asarray(v, np.float32) if v is not None else None for v in vecs], kind))
                except Exception:  # noqa: BLE001 - the reference returns empty vectors
                    out.append(pa.array([[] for _ in part], kind))
            yield pa.chunked_array(out, kind).combine_chunks()

    return (df.repartition(partitions) if partitions else df).withColumn(out_col, _embed(F.col(text_col)))


def split_embedded(df: DataFrame, col: str = "embedding"):
    """E2 gate: rows with a vector, and rows whose embedding came back empty
    (``reason = 'embedding_failed'``)."""
    ok = df.filter(F.size(col) > 0)
    bad = df.filter(F.coalesce(F.size(col), F.lit(0)) <= 0).withColumn("reason", F.lit("embedding_failed"))
    return ok, bad


def embed_and_insert(corpus: Corpus3, new_chunks: DataFrame, *, generate: bool = True,
                     factory: Callable[[], EmbeddingProvider] = HashingProvider, name: str | None = None,
                     order_col: str = "seq") -> tuple[Corpus3, DataFrame]:
    """Embed incoming chunk texts (when ``generate``), reject the ones
    whose embedding failed, and add the rest (U12, appended at the end).  With
    ``generate=False`` chunks are added with an empty vector, as the reference does.

    Keys and parents are checked first, so the provider sees only chunks that can be
    added, and its vectors are written once (checkpoint): no later step asks it again.
    Rejects are ``library_id, document_id, chunk_id, reason``; ``reason`` is
    ``duplicate_id``, ``not_found:Library``, ``not_found:Document`` or ``embedding_failed``."""
    def refused(rows: DataFrame, reason: str) -> DataFrame:
        return rows.select(*CHUNK, F.lit(reason).alias("reason"))

    rows, twice = gate(new_chunks, CHUNK)
    libraries, documents = corpus.libraries.select(*LIB), corpus.documents.select(*DOC)
    known = rows.join(libraries, LIB, "left_semi")
    rejects = (refused(twice, "duplicate_id")
               .unionByName(refused(rows.join(libraries, LIB, "left_anti"), "not_found:Library"))
               .unionByName(refused(known.join(documents, DOC, "left_anti"), "not_found:Document")))
    ok = known.join(documents, DOC, "left_semi")
    if generate:
        ensure_checkpoint_dir(rows.sparkSession)
        ok, bad = split_embedded(embed_column(ok, "text", "embedding", factory, name=name).checkpoint())
        rejects = rejects.unionByName(bad.select(*CHUNK, "reason"))
    else:
        ok = ok.withColumn("embedding", F.array().cast("array<float>"))
    out, _ = add_chunks(corpus, ok, order_col=order_col)
    return out, rejects
