"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token (one match of the pattern) is a linked list of its bytes.  Every
adjacent pair whose concatenation has a merge rank is queued under that rank:
a bucket per rank holds the positions, and a two-level bitmap of non-empty
buckets answers "the lowest rank with work" with one find-first-set per level.  The queue never searches or removes:
an entry whose position has since got another pair is stale and is skipped
when popped.  A merge costs O(log V) instead of a scan over the pre-token, so
a pre-token of a million bytes is as cheap per byte as a short one.  The new
pre-tokens of several texts share one queue, so that a bucket that is found
holds the pairs of many of them.

Pre-tokens up to ``MEMO_BYTES`` bytes are memoised per Python worker in a table
of about ``MEMO_ENTRIES`` entries at most (it only saves repeated work).
"""

import base64
import hashlib
import itertools
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf

from .common import held

MEMO_BYTES = 64
MEMO_ENTRIES = 1 << 18
#: Largest vocabulary file that is broadcast, in bytes.
MAX_VOCAB_BYTES = 64 << 20
LONG_TEXT = 1 << 20
#: Characters of texts whose new pre-tokens are merged together, and bytes of pre-tokens in one queue.
GROUP_CHARS = 1 << 16
MERGE_BYTES = 1 << 13
FENCE = b"\xff"


def read_ranks(path: str) -> dict[bytes, int]:
    """``{token bytes: rank}`` of a file with a base64 token and its rank per line."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCAB_BYTES + 1)
    if len(raw) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path}: a vocabulary over {MAX_VOCAB_BYTES} bytes is not broadcast")
    return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in raw.splitlines() if line)}


def _popped(heap: list[int]) -> Iterator[int]:
    while heap:
        yield heappop(heap)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern)
        # two levels of bitmap words of about sqrt(V) bits each; all zero between calls
        self.shift = max(6, (max(ranks.values()).bit_length() + 1) // 2)
        self.mask = (1 << self.shift) - 1
        self.low = [0] * ((max(ranks.values()) >> self.shift) + 1)
        self.bits = [1 << b for b in range(max(len(self.low), self.mask + 1))]
        self.tokens = {r: t for t, r in ranks.items()}
        # the byte FF is in no UTF-8 text and stands between pre-tokens: no pair has it
        self.joint = {t: r for t, r in ranks.items() if FENCE not in t} if any(FENCE in t and t != FENCE for t in ranks) else ranks
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.double = np.full((256, 256), -1, np.int64)
        for t, r in ranks.items():
            if len(t) == 2 and FENCE not in t:
                self.double[t[0], t[1]] = r
        #: packed ids by pre-token: the newer half, and the older one, from which what is asked for again is taken over
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each of some pre-tokens (UTF-8).  They share one queue: each is merged by its own lowest
        rank, leftmost first, whatever the others do."""
        data = FENCE + FENCE.join(pieces) + FENCE
        raw = np.frombuffer(data, np.uint8)
        n, rank_of = len(data), self.joint.get
        shift, mask, bits, low = self.shift, self.mask, self.bits, self.low
        tok = self.single[raw].tolist()       # rank of the token that starts here
        first = self.double[raw[:-1], raw[1:]]
        pair = first.tolist()                 # rank of the pair that starts here now
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        high, buckets, parked = 0, {}, {}     # bitmap over the words of low; positions by rank; those begun, as heaps
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        found, start = np.unique(first[at], return_index=True)
        at, start = at.tolist(), [*start.tolist(), len(at)]
        for r, a, b in zip(found.tolist(), start, start[1:]):
            buckets[r] = at[a:b]
            high |= bits[r >> shift]
            low[r >> shift] |= bits[r & mask]
        while high:
            word = (high & -high).bit_length() - 1
            in_word = low[word]
            r = word << shift | (in_word & -in_word).bit_length() - 1
            low[word] = in_word = in_word & in_word - 1   # r is the lowest bit of either level
            if not in_word:
                high &= high - 1
            heap, some = parked.pop(r, None), buckets.pop(r, ())
            if heap is None:
                order = iter(sorted(some))
            else:
                for i in some:
                    heappush(heap, i)
                order = _popped(heap)
            for i in order:
                if pair[i] != r:
                    continue                  # stale
                j = nxt[i]
                end = nxt[i] = nxt[j]
                prv[end], before = i, prv[i]
                tok[i], tok[j], pair[j] = r, -1, -1
                lower = False
                # pairs that are new
                right = pair[i] = rank_of(data[i:nxt[end]], -1)
                if right >= 0:
                    if right in buckets:
                        buckets[right].append(i)
                    else:
                        buckets[right] = [i]
                        word = right >> shift
                        high |= bits[word]
                        low[word] |= bits[right & mask]
                    lower = right < r
                left = pair[before] = rank_of(data[before:end], -1)
                if left >= 0:
                    if left in buckets:
                        buckets[left].append(before)
                    else:
                        buckets[left] = [before]
                        word = left >> shift
                        high |= bits[word]
                        low[word] |= bits[left & mask]
                    lower = lower or left < r
                if lower:                     # that pair is first; the others of this rank wait
                    if rest := list(order) if heap is None else heap:
                        parked[r] = rest
                        high |= bits[r >> shift]
                        low[r >> shift] |= bits[r & mask]
                    break
        ids, fence = np.array(tok, np.int64), raw == FENCE[0]
        live = (ids >= 0) & ~fence
        ends = (4 * np.cumsum(live)[fence]).tolist()
        packed = ids[live].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip(ends, ends[1:])]

    def _look_up(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of all of ``pieces``; those that no memo has are merged together."""
        here, new = {}, []
        for piece in set(pieces):
            packed = self.memo.get(piece)
            if packed is None:
                packed = self.old.get(piece)
                if packed is None:
                    raw = piece.encode()
                    rank = self.ranks.get(raw)
                    if rank is None:
                        new.append((piece, raw))
                        continue
                    packed = rank.to_bytes(4, "little")
                self._keep(piece, packed)
            here[piece] = packed
        while new:
            size, some = 0, []
            while new and size < MERGE_BYTES:
                some.append(new.pop())
                size += len(some[-1][1])
            for (piece, raw), packed in zip(some, self.merge([raw for _, raw in some])):
                here[piece] = packed
                if len(raw) <= MEMO_BYTES:
                    self._keep(piece, packed)
        return here

    def _keep(self, piece: str, packed: bytes) -> None:
        if len(self.memo) >= MEMO_ENTRIES // 2:
            self.old, self.memo = self.memo, {}
        self.memo[piece] = packed

    def _joined(self, pieces: list[str]) -> bytes:
        return b"".join(map(self._look_up(pieces).__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers (null: none)."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text; texts that follow each other share a queue."""
        out, size, group = [], 0, []
        for text in texts:
            if text and len(text) > LONG_TEXT:
                pieces = (m.group() for m in self.find.finditer(text))
                out += self._group(group)
                out.append(b"".join(self._joined(some) for some in itertools.batched(pieces, LONG_TEXT // 8)))
                size, group = 0, []
                continue
            group.append(self.find.findall(text) if text else [])
            size += len(text or "")
            if size >= GROUP_CHARS:
                out += self._group(group)
                size, group = 0, []
        return out + self._group(group)

    def _group(self, group: list[list[str]]) -> list[bytes]:
        packed = self._look_up(list(itertools.chain.from_iterable(group))).__getitem__
        return [b"".join(map(packed, pieces)) for pieces in group]

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())) if ids else b""


def _codec(key: tuple, ranks, pattern: str) -> Codec:
    """One codec a worker and vocabulary, so its memo outlives the task.  ``ranks`` is a broadcast, unpacked only
    for a new codec."""
    codecs = held("bpe")
    if key not in codecs:
        codecs.clear()
        codecs[key] = Codec(ranks.value, pattern)
    return codecs[key]


class ByteBPE:
    """``encode(text)`` and ``decode(ids)`` as columns.

    ``encode`` returns ``struct<n_tokens bigint, ids binary>``; ids are packed
    little-endian unsigned 32-bit integers.  A null or empty text has no ids.
    ``decode`` takes such ids (null: none) and returns the bytes as binary;
    an id outside the vocabulary fails the job.  Both work row by row, so ties,
    repeated rows, empty tables and further columns do not matter.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{path}: not a byte-level vocabulary, some single bytes have no rank")
        key = (hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), pattern)
        shared = spark.sparkContext.broadcast(ranks)

        @arrow_udf("struct<n_tokens:bigint,ids:binary>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = _codec(key, shared, pattern)
            for texts in batches:
                ids = codec.encode_all(texts.to_pylist())
                yield pa.StructArray.from_arrays(
                    [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["n_tokens", "ids"])

        @arrow_udf("binary")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = _codec(key, shared, pattern)
            for ids in batches:
                yield pa.array([codec.decode(x) for x in ids.to_pylist()], pa.binary())

        self._encode, self._decode = encode, decode

    def encode(self, text) -> Column:
        return self._encode(text)

    def decode(self, ids) -> Column:
        return self._decode(ids)
