"""Language identification by prediction by partial matching (PPM).

For each language a variable-order byte context tree of depth ``ORDER`` is
counted on a bounded sample of labelled texts and then frozen.  The code
length of a byte after a context seen n times with d distinct successors, c
of them this byte, is ``-log2(c / (n + d))``; a byte never seen there costs the
escape ``-log2(d / (n + d))`` plus its code length in the next shorter context
(a context never seen costs nothing), down to one byte in 256 (escape method C,
no exclusions, statistics frozen).  A text's language is the one whose tree
codes its UTF-8 bytes, after ``ORDER`` newlines, in the fewest bits.

With frozen statistics the code length is a function of the last ORDER + 1 bytes,
so the trees of all languages merge into one hash table per order, from a
byte string to its code length in every language, and one per order from a
context to its escape costs.  Scoring is then a few table look-ups a byte.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import cut, held

ORDER = 4
#: Bounds of the training sample, for each language: rows (twice as many at
#: most, as rows are drawn at random) and bytes after which no further text is taken.
SAMPLE_ROWS = 500
SAMPLE_BYTES = 4 << 20
#: Bytes of the model that tasks get, and languages learned at most (those with most rows).
MODEL_BYTES = 256 << 20
LANGUAGES = 1000
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _grams(stream: np.ndarray, k: int, at: np.ndarray | slice) -> np.ndarray:
    """The k bytes up to and with each position, as one integer."""
    key = np.zeros(len(stream) - ORDER, np.uint64)
    for back in range(k - 1, -1, -1):
        key = key << np.uint64(8) | stream[ORDER - back:len(stream) - back].astype(np.uint64)
    return key[at]


class _Table:
    """Integer keys to row numbers: open addressing, a quarter full."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.size = 1 << (64 - int(self.shift))
        self.keys = np.zeros(self.size, np.uint64)
        self.rows = np.full(self.size, -1, np.int32)
        left, slot = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.rows[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.rows[slot[won]] = keys[left[won]], left[won]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, slot = left[lost], (slot[lost] + 1) % self.size

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is absent."""
        slot = self._home(keys)
        rows = self.rows[slot]
        odd = np.flatnonzero((rows >= 0) & (self.keys[slot] != keys))
        while len(odd):
            slot[odd] = (slot[odd] + 1) % self.size
            rows[odd] = self.rows[slot[odd]]
            odd = odd[(rows[odd] >= 0) & (self.keys[slot[odd]] != keys[odd])]
        return rows


@dataclass
class Model:
    """Frozen code lengths: ``bits[k]`` has a row for each string of k + 1
    bytes in ``grams[k]``, ``escape[k]`` one for each context in ``contexts[k]``."""

    langs: list[str]
    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]


def freeze(langs: list[str], counts: list[dict[int, np.ndarray]]) -> Model:
    """``counts[k][i]``: arrays (gram, count) of order k in language i."""
    L, model = len(langs), Model(langs, [], [], [], [])
    for k in range(ORDER + 1):
        keys = np.unique(np.concatenate([counts[k][i][0] for i in range(L)] + [np.arange(256 if k == 0 else 0, dtype=np.uint64)]))
        ctx = np.unique(keys >> np.uint64(8))
        esc = np.zeros((len(ctx), L))
        if k:
            low = model.bits[k - 1][np.searchsorted(model.grams[k - 1], keys & np.uint64((1 << 8 * k) - 1))].astype(float)
        else:
            low = np.full((len(keys), L), 8.0)
        row = np.searchsorted(ctx, keys >> np.uint64(8))
        bits = np.empty((len(keys), L))
        for i in range(L):
            c = np.zeros(len(keys))
            c[np.searchsorted(keys, counts[k][i][0])] = counts[k][i][1]
            n, d = np.bincount(row, c, len(ctx)), np.bincount(row, c > 0, len(ctx))
            seen = n > 0
            esc[seen, i] = -np.log2(d[seen] / (n + d)[seen])
            bits[:, i] = esc[row, i] + low[:, i]
            hit = c > 0
            bits[hit, i] = -np.log2(c[hit] / (n + d)[row[hit]])
        model.grams.append(keys)
        model.bits.append(bits.astype(np.float32))
        model.contexts.append(ctx)
        model.escape.append(esc.astype(np.float32))
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model, L = model, max(1, len(model.langs))
        self.grams = [_Table(g) for g in model.grams]
        self.contexts = [_Table(c) for c in model.contexts]
        self.step = max(4096, (1 << 18) // L)      # positions scored at a time: some 20 MB of arrays, 60 with 8 times as many

    def costs(self, stream: np.ndarray) -> np.ndarray:
        """Bits of every position from ORDER on, by language."""
        m = self.model
        out = np.zeros((len(stream) - ORDER, len(m.langs)), np.float32)
        at = np.arange(len(out))
        for k in range(ORDER, -1, -1):
            keys = _grams(stream, k + 1, at)
            rows = self.grams[k].find(keys)
            hit = rows >= 0
            out[at[hit]] += m.bits[k][rows[hit]]
            at, keys = at[~hit], keys[~hit]
            if not len(at):
                break
            ctx = self.contexts[k].find(keys >> np.uint64(8))
            known = ctx >= 0
            out[at[known]] += m.escape[k][ctx[known]]
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        total = np.zeros((len(texts), len(self.model.langs)))
        pad = b"\n" * ORDER
        stream = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8)
        # text i fills stream positions [start, start + length), pads between are not scored
        length = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(length + ORDER) - length
        for a in range(ORDER, len(stream), self.step):
            b = min(a + self.step, len(stream))
            cost = self.costs(stream[a - ORDER:b])
            first, last = np.searchsorted(start + length, a, "right"), np.searchsorted(start, b)
            for i in range(first, last):
                total[i] += cost[max(start[i], a) - a:min(start[i] + length[i], b) - a].sum(0, dtype=float)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not some or not self.model.langs:
            return langs, score
        bits = self.bits([texts[i].encode() for i in some])
        best = bits.argmin(1)
        share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
        for j, i in enumerate(some):
            langs[i], score[i] = self.model.langs[best[j]], float(share[j])
        return langs, score


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, seed: int = 7) -> Model:
    """Learn from ``labelled`` (columns ``text``, ``lang``); rows with a null in
    either, empty texts and ones of over a quarter of ``size`` bytes teach nothing; a text that repeats teaches once.  The grams are counted on Spark;
    the driver gets their counts over the bounded sample only.  The sample is drawn by a hash: the same rows in
    another order or partitioning give the same model."""
    known = labelled.select("text", "lang").filter("text IS NOT NULL AND text != '' AND lang IS NOT NULL")
    most = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    found = {r["lang"]: r["n"] for r in most}
    langs = sorted(found, key=lambda s: s.encode())
    number = {s: i for i, s in enumerate(langs)}
    if not langs:
        return Model([], *[[np.zeros(0, np.uint64)] * (ORDER + 1), [np.zeros((0, 0), np.float32)] * (ORDER + 1)] * 2)
    share = labelled.sparkSession.createDataFrame([(s, min(1.0, rows / n)) for s, n in found.items()], "lang string, _share double")
    draw = F.pmod(F.xxhash64(F.lit(seed), "text", "lang"), F.lit(1 << 30)) / (1 << 30)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    fits = F.octet_length("text") <= size // 4
    drawn = known.join(F.broadcast(share), "lang").filter((draw < F.col("_share")) & fits).select("text", "lang").distinct()
    drawn = cut(drawn.withColumn("_n", F.row_number().over(order))
                .withColumn("_end", F.sum(F.octet_length("text")).over(order))
                .filter((F.col("_n") <= 2 * rows) & (F.col("_end") <= size)))

    def count(batches):
        for batch in batches:
            by: dict[int, list[bytes]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(number[lang], []).append(text.encode())
            for i, texts in by.items():
                pad = b"\n" * ORDER
                stream = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8)
                real = np.concatenate([np.arange(len(t)) + off for t, off in
                                       zip(texts, np.cumsum([0] + [len(t) + ORDER for t in texts[:-1]]))])
                for k in range(ORDER + 1):
                    gram, c = np.unique(_grams(stream, k + 1, real), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(gram), i), pa.int32()), pa.array(np.full(len(gram), k), pa.int32()),
                         pa.array(gram.astype(np.int64)), pa.array(c, pa.int64())], ["lang", "k", "gram", "c"])

    while True:
        # fewer bytes a language until the model, a row of bits for every gram, keeps its bound
        sample = drawn.filter(F.col("_end") <= size).select("text", "lang")
        counted = cut(sample.mapInArrow(count, "lang int, k int, gram bigint, c bigint").groupBy("lang", "k", "gram").agg(F.sum("c").alias("c")))
        if size <= 1 or 8 * len(langs) * counted.select("k", "gram").distinct().count() <= MODEL_BYTES:
            break
        size //= 2
    counted = counted.toArrow()
    lang, k, gram, c = (counted.column(x).to_numpy() for x in ("lang", "k", "gram", "c"))
    counts = []
    for order_k in range(ORDER + 1):
        by = {}
        for i in range(len(langs)):
            mine = (lang == i) & (k == order_k)
            sort = np.argsort(gram[mine], kind="stable")
            by[i] = (gram[mine][sort].astype(np.uint64), c[mine][sort])
        counts.append(by)
    return freeze(langs, counts)


def predict(spark: SparkSession, model: Model, text) -> Column:
    """``struct<lang string, score double>`` of a text column.  ``score`` is the
    share of the best language when languages weigh 2^-bits; ties go to the
    language first by code point.  A null text or one without a letter gets
    ``und`` and 0, and so does every text when nothing was learned.  The column is marked as not
    deterministic, though it is: otherwise a filter on it is pushed below and scores every text again, in another worker."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("struct<lang:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("langid")
        scorer = Scorer(shared.value)
        for texts in batches:
            lang, score = scorer.predict(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return run.asNondeterministic()(text)
