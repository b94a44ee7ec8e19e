"""Terms of a text for the benchmark operators: maximal runs of ASCII digits, letters
and characters beyond ASCII, A-Z lower-cased.  Texts are handled as UTF-8 bytes."""

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(raw: bytes | None) -> list[bytes]:
    """The terms of one text (null: none), in order."""
    return raw.translate(_FOLD).split() if raw else []


def batch_terms(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """All terms of a batch of texts, and how many each text has."""
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i, raw in enumerate(texts.to_pylist()):
        some = terms(raw)
        sizes[i] = len(some)
        out += some
    return out, sizes


def hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive word hashes."""
    n = max(0, len(h) - width + 1)
    x = np.full(n, width, np.uint64)
    for i in range(width):
        x = (x ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)
