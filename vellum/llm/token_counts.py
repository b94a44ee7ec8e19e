"""Token counts under a unigram vocabulary, by dynamic programming on a trie.

A pre-token's count is the number of pieces of its cheapest segmentation, a
piece of rank r costing ``round(65536 * ln(r + 2))`` (a Zipf prior over the
vocabulary's own order; integers, so sums are exact) and ties going to fewer
pieces.  The forward cost of a prefix depends on the prefix alone, so the
distinct pre-tokens of an Arrow batch are inserted in a trie and every trie
node is scored once, however many pre-tokens share it; the count is stored at
the terminal node.  Insertion is in sorted order, which visits the trie depth
first: only the nodes of the current root-to-leaf path are held, so memory is
the longest pre-token, not the trie.

Counts of pre-tokens up to ``MEMO_BYTES`` bytes are remembered per Python worker,
about ``MEMO_ENTRIES`` of them at most, and reset beyond (repeated work only).
"""

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf

from .bpe import read_ranks

MEMO_BYTES = 64
MEMO_ENTRIES = 1_000_000
#: Pre-tokens of one text handled at a time.
SLICE = 1 << 17


def piece_cost(rank: int) -> int:
    return round(65536 * math.log(rank + 2))


class TrieCounter:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern)
        self.cost = {piece: piece_cost(rank) for piece, rank in ranks.items()}
        ends: dict[int, set[int]] = {b: set() for b in range(256)}
        for piece in ranks:
            ends[piece[-1]].add(len(piece))
        self.lengths = [sorted(ends[b]) for b in range(256)]   # of the pieces that end in a byte
        self.memo: dict[str, int] = {}

    def score(self, pretokens: list[str]) -> dict[str, int]:
        """Counts of distinct pre-tokens."""
        cost_of, lengths = self.cost.get, self.lengths
        path, best, count = b"", [0], [0]     # the open nodes: forward cost and pieces by depth
        out = {}
        for raw, text in sorted((t.encode(), t) for t in pretokens):
            depth, most = 0, min(len(path), len(raw))
            if raw[:most] == path[:most]:
                depth = most
            else:
                while raw[depth] == path[depth]:
                    depth += 1
            del best[depth + 1:], count[depth + 1:]
            for end in range(depth + 1, len(raw) + 1):
                low = low_n = None
                for length in lengths[raw[end - 1]]:
                    start = end - length
                    if start < 0:
                        break
                    c = cost_of(raw[start:end])
                    if c is not None:
                        c += best[start]
                        if low is None or c < low or c == low and count[start] + 1 < low_n:
                            low, low_n = c, count[start] + 1
                best.append(low)
                count.append(low_n)
            path = raw
            out[text] = count[-1]
        return out

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text; null or empty: (0, 0)."""
        memo, totals = self.memo, [(0, 0)] * len(texts)
        parts: list[tuple[int, Counter]] = []
        held = 0

        def settle() -> None:
            nonlocal parts, held
            fresh = self.score({p for _, c in parts for p in c if p not in memo})
            for at, c in parts:
                n = sum(k * (memo[p] if p in memo else fresh[p]) for p, k in c.items())
                totals[at] = (totals[at][0] + n, totals[at][1] + c.total())
            if len(memo) + len(fresh) > MEMO_ENTRIES:
                memo.clear()
            memo.update((p, n) for p, n in fresh.items() if len(p) <= MEMO_BYTES)
            parts, held = [], 0

        for at, text in enumerate(texts):
            pieces = (m.group() for m in self.find.finditer(text)) if text and len(text) > SLICE else self.find.findall(text or "")
            for some in itertools.batched(pieces, SLICE):
                parts.append((at, Counter(some)))
                held += len(some)
                if held >= 4 * SLICE:
                    settle()
        settle()
        return totals


_COUNTERS: dict[tuple, TrieCounter] = {}


def _counter(key: tuple, ranks: dict[bytes, int], pattern: str) -> TrieCounter:
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TrieCounter(ranks, pattern)
    return _COUNTERS[key]


def token_counts(spark: SparkSession, text, path: str, pattern: str) -> Column:
    """``struct<n_tokens bigint, n_pretokens bigint>`` of a text column.

    ``path`` names a byte-level vocabulary (base64 piece and rank per line, all
    256 single bytes among them).  Null and empty texts count (0, 0).  Row by
    row: repeated rows, empty tables and further columns do not matter."""
    ranks = read_ranks(path)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: not a byte-level vocabulary, some single bytes have no rank")
    key = (hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), pattern)
    shared = spark.sparkContext.broadcast(ranks)

    @arrow_udf("struct<n_tokens:bigint,n_pretokens:bigint>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(key, shared.value, pattern)
        for texts in batches:
            got = counter.count(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array([a for a, _ in got], pa.int64()),
                                              pa.array([b for _, b in got], pa.int64())], ["n_tokens", "n_pretokens"])

    return count(text)
