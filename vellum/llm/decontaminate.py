"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its ``window`` consecutive words (an item of fewer words is one
window).  A window is a set of word shingles (``SHINGLE`` words, or the whole of a shorter
window), and a document holds the window only if it holds all of them.

1. Rarity: one pass counts, over all documents, in how many each shingle of an item occurs.
2. Prefix: where all of a window's n shingles are needed, n - n + 1 = 1 of them is a
   necessary prefix; ordered by rarity that is its rarest one.
3. Join: documents are asked for the places of prefix shingles only, and these are joined
   with the windows that have them as prefix.
4. Bounds: the place leaves room for the window before and after it, within the text.
5. Verification: the words of the document at the window's place are the window's words.

Documents are tokenised in the tasks that read them.  A bitmap of fixed size
(``FILTER_BITS``) of the shingles that matter is broadcast, whatever the
number of items; what it lets through by chance the joins discard.  A text's result hangs on
the text alone, so equal texts, however many, are joined once.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import cut
from .terms import batch_terms, hashes, shingle_hashes, terms

SHINGLE = 3
#: Bits of the broadcast filter: 8 MB.
FILTER_BITS = 1 << 26
#: Windows up to this many are broadcast to the documents' candidate places (about 200 bytes each).
BROADCAST_WINDOWS = 100_000
#: Results of texts, and items they list, that are broadcast to the documents (about 50 bytes each).
BROADCAST_TEXTS = 500_000


def _item_windows(window: int):
    @arrow_udf("array<struct<w:string,m:int,shingles:array<bigint>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for raw in texts.to_pylist():
                w = terms(raw)
                h = hashes(w, len(w))
                size = min(window, len(w))
                each = shingle_hashes(h, min(SHINGLE, size)).view(np.int64).tolist() if size else []
                n = size - min(SHINGLE, size) + 1
                out.append([{"w": b" ".join(w[i:i + size]), "m": size, "shingles": each[i:i + n]}
                            for i in range(len(w) - size + 1)] if size else [])
            yield pa.array(out, pa.list_(pa.struct([("w", pa.binary()), ("m", pa.int32()), ("shingles", pa.list_(pa.int64()))]))).cast(
                pa.list_(pa.struct([("w", pa.string()), ("m", pa.int32()), ("shingles", pa.list_(pa.int64()))])))

    return run


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id string, w, m, shingles): every window of every item once; w is its words joined by blanks."""
    x = items.select(F.col("item_id").cast("string").alias("item_id"), F.explode(_item_windows(window)(F.col("text").cast("binary"))).alias("x"))
    return x.select("item_id", "x.*").dropDuplicates(["item_id", "w"])


def bitmap(hashed: DataFrame) -> np.ndarray:
    """FILTER_BITS bits as 64-bit words, set at the lowest bits of the hashes ``h``."""
    at = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = hashed.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit")) \
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()       # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _places(words: list[bytes], sizes: np.ndarray, widths: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the batch) and hashes of shingles that the filter lets through."""
    h = hashes(words, len(words))
    end = np.repeat(np.cumsum(sizes), sizes)                 # the end of the text that each word is in
    at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for width in widths:
        s = shingle_hashes(h, width)
        low = s & np.uint64(64 * len(bits) - 1)
        hit = np.flatnonzero(bits[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1))
        hit = hit[hit + width <= end[hit]]
        at.append(hit)
        found.append(s[hit])
    return np.concatenate(at), np.concatenate(found)


def _shingles_held(widths: list[int], bits: Broadcast):
    @arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            words, sizes = batch_terms(texts)
            at, found = _places(words, sizes, widths, bits.value)
            doc = np.searchsorted(np.cumsum(sizes), at, side="right")
            pairs = np.unique(np.stack([doc, found.view(np.int64)], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            offsets = np.searchsorted(pairs[:, 0], np.arange(len(texts) + 1))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs[:, 1], pa.int64()))

    return run


_PLACE = pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("at", pa.int32()), ("near", pa.list_(pa.string()))])


def _candidates(window: int, widths: list[int], bits: Broadcast):
    @arrow_udf("struct<n_words:bigint,d1:bigint,d2:bigint,places:array<struct<h:bigint,pos:int,at:int,near:array<string>>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            words, sizes = batch_terms(texts)
            at, found = _places(words, sizes, widths, bits.value)
            ends = np.cumsum(sizes)
            doc = np.searchsorted(ends, at, side="right")
            places = [[] for _ in range(len(texts))]
            for d, p, h in zip(doc.tolist(), at.tolist(), found.view(np.int64).tolist()):
                first, end = int(ends[d] - sizes[d]), int(ends[d])
                low = max(first, p - window + 1)
                places[d].append({"h": h, "pos": p - first, "at": p - low,
                                  "near": [w.decode("utf-8", "replace") for w in words[low:min(end, p + window)]]})
            digest = b"".join(xxhash.xxh3_128_digest(raw or b"") for raw in texts.to_pylist())
            d = np.frombuffer(digest, np.int64).reshape(-1, 2)
            yield pa.StructArray.from_arrays([pa.array(sizes), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(places, pa.list_(_PLACE))],
                                             ["n_words", "d1", "d2", "places"])

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items array<string>, contaminated) for every row of ``docs``
    (doc_id, text), against ``items`` (item_id, text).

    n_hit counts the words inside occurrences of items' windows, items lists the item_ids with occurring
    windows, sorted as strings.  Null and empty texts have no words; rows are returned as they
    come, repeated ones and ones without an id too.  Rows of one item_id are one item; windows of items without
    an id hit words, and are not listed.  Without items nothing is hit.  Other columns play no part."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    windows = cut(item_windows(items, window))
    widths = [r[0] for r in windows.select(F.least("m", F.lit(SHINGLE))).distinct().collect()]     # SHINGLE values at most
    one = windows.groupBy("w", "m").agg(F.first("shingles").alias("shingles"))
    each = one.select("w", "m", F.posexplode("shingles").alias("off", "h"))
    every = spark.sparkContext.broadcast(bitmap(each.select("h")))
    df = d.select(F.explode(_shingles_held(widths, every)("text")).alias("h")).groupBy("h").count()
    rare = each.join(df, "h", "left").groupBy("w", "m").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("df"), "h", "off")).alias("p"))
    # a window with a shingle in no document is in none
    prefix = cut(rare.filter("p.df > 0").select("w", "m", "p.h", "p.off"))
    needed = spark.sparkContext.broadcast(bitmap(prefix.select("h")))
    asked = cut(d.select("doc_id", _candidates(window, widths, needed)("text").alias("c")).select("doc_id", "c.*"))
    place = asked.filter(F.size("places") > 0).select("d1", "d2", F.explode("places").alias("c")).select("d1", "d2", "c.*")
    few = prefix.count() <= BROADCAST_WINDOWS
    near = place.join(F.broadcast(prefix) if few else prefix, "h")
    start = F.col("at") - F.col("off")
    fits = near.filter((start >= 0) & (start + F.col("m") <= F.size("near")))
    same = fits.filter(F.concat_ws(" ", F.slice("near", start + 1, F.col("m"))) == F.col("w"))
    hits = cut(same.select("d1", "d2", (F.col("pos") - F.col("off")).alias("start"), "m", "w").distinct())
    # words in the union of the hits: each adds what lies beyond all before it
    order = Window.partitionBy("d1", "d2").orderBy("start", "end")
    spans = hits.select("d1", "d2", "start", (F.col("start") + F.col("m")).alias("end")).distinct()
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("more", F.greatest(F.lit(0), F.col("end") - F.greatest("start", before))) \
        .groupBy("d1", "d2").agg(F.sum("more").alias("n_hit"))
    named = hits.select("d1", "d2", "w").distinct().join(windows.filter("item_id IS NOT NULL").select("w", "item_id"), "w") \
        .groupBy("d1", "d2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    texts = cut(covered.join(named, ["d1", "d2"], "left"))
    n, listed = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.coalesce("items", F.array()))), F.lit(0))).first()
    few = n + listed <= BROADCAST_TEXTS
    out = asked.select("doc_id", "n_words", "d1", "d2").join(F.broadcast(texts) if few else texts, ["d1", "d2"], "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                      listed.alias("items"), (hit > 0).alias("contaminated"))
