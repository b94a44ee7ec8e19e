"""Ranked lexical search over a deduplicated bag of documents.

A document matters to the items only by the counts of its terms that some item has
and by its length measure m.

1. Documents are restricted to the items' vocabulary, in the tasks that read them: a
   packed vector of (term, count), and the number of all terms.
2. Equal vectors with equal m are one class.  A class is named by two 64-bit hashes,
   verified by grouping on the vectors themselves: were two vectors to share a name, all would be hashed anew.
3. Every class is scored once, for all items, in blocks: contributions of a class's terms
   are added up over the items that have them, in whole numbers.  A task keeps each item's k
   best classes, ties by the least doc_id of the class.
4. The best classes are expanded to their members by ascending doc_id; a document among
   the k best is in one of the k best classes, and among its k least members.

Items are the stated query set: blocks of them whose vocabulary fits ``VOCAB_BYTES``
are broadcast, and one pass over the documents answers a block.
"""

import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import cut
from .terms import batch_terms, terms

#: Bytes of the terms of one block of items (with repeats among items), and the items in it.
VOCAB_BYTES = 32 << 20
BLOCK_ITEMS = 10_000
#: Class x item scores, and single additions, held at once by a task.
CELLS = 1 << 21
#: Parts in which an item's candidate classes are ranked first.
SALT = 32
#: Classes up to this many are broadcast to the members (16 bytes each).
BROADCAST_CLASSES = 200_000
LAST = np.iinfo(np.int64).max


def _distinct_terms():
    @arrow_udf("array<string>")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([sorted({w.decode("utf-8", "replace") for w in terms(raw)}) for raw in text.to_pylist()], pa.list_(pa.string()))

    return run


def _vectors(vocabulary: Broadcast):
    ids: dict[bytes, int] = {}

    @arrow_udf("struct<n:bigint,v:binary>")
    def run(text: pa.Array) -> pa.Array:
        if not ids:
            ids.update({w.encode(): i for i, w in enumerate(vocabulary.value)})
        words, sizes = batch_terms(text)
        known = np.fromiter(map(ids.get, words, itertools.repeat(-1)), np.int64, len(words))
        key = (np.repeat(np.arange(len(sizes)), sizes) * (len(ids) + 1) + known)[known >= 0]
        key, tf = np.unique(key, return_counts=True)
        packed = np.stack([key % (len(ids) + 1), tf], 1).astype("<u4")
        at = np.searchsorted(key // (len(ids) + 1), np.arange(len(sizes) + 1)) * 8
        return pa.StructArray.from_arrays(
            [pa.array(sizes), pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(packed.tobytes())])],
            ["n", "v"])

    return run


def _term_documents(batches):
    """(term, documents that hold it) of a partition."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        t = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4").reshape(-1, 2)[:, 0]
        n = np.bincount(t, minlength=len(total))
        n[:len(total)] += total
        total = n
    term = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "df"])


class Scorer:
    """Scores of classes for a block of items; item i has the terms ``item_terms[i]``."""

    def __init__(self, item_terms: list[np.ndarray], weights: np.ndarray, k: int):
        self.k, self.n_items, self.weights = k, len(item_terms), weights
        item = np.repeat(np.arange(len(item_terms)), [len(t) for t in item_terms])
        term = np.concatenate([*item_terms, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(term, kind="stable")
        self.items = item[order]                       # items of each term, term after term
        self.start = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.best = np.zeros((self.n_items, k), np.int64)
        self.first = np.full((self.n_items, k), LAST)
        self.name = np.zeros((self.n_items, k, 2), np.int64)

    def scores(self, vectors: list[bytes], m: np.ndarray) -> np.ndarray:
        """Classes x items."""
        sizes = np.fromiter(map(len, vectors), np.int64, len(vectors)) // 8
        packed = np.frombuffer(b"".join(vectors), "<u4").reshape(-1, 2).astype(np.int64)
        term, tf = packed[:, 0], packed[:, 1]
        row = np.repeat(np.arange(len(vectors)), sizes)
        x = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        out = np.zeros(len(vectors) * self.n_items, np.int64)
        many = self.start[term + 1] - self.start[term]
        ends = np.cumsum(many)
        at = 0
        while at < len(term):                          # as many entries as CELLS additions, one at least
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
            n = many[at:to]
            shift = np.repeat(self.start[term[at:to]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            cell = np.repeat(row[at:to], n) * self.n_items + self.items[shift + np.arange(n.sum())]
            np.add.at(out, cell, np.repeat(x[at:to], n))
            at = to
        return out.reshape(len(vectors), self.n_items)

    def add(self, vectors: list[bytes], m: np.ndarray, first: np.ndarray, name: np.ndarray) -> None:
        step = max(1, CELLS // max(1, self.n_items))
        for at in range(0, len(vectors), step):
            s = self.scores(vectors[at:at + step], m[at:at + step])
            row, item = np.nonzero(s >= np.maximum(self.best[:, -1], 1))
            if not len(row):
                continue
            touched = np.unique(item)
            old = len(touched) * self.k
            item = np.concatenate([np.repeat(touched, self.k), item])
            score = np.concatenate([self.best[touched].ravel(), s[row, item[old:]]])
            low = np.concatenate([self.first[touched].ravel(), first[at + row]])
            names = np.concatenate([self.name[touched].reshape(-1, 2), name[at + row]])
            order = np.lexsort((names[:, 0], low, -score, item))
            place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
            keep = order[place < self.k].reshape(len(touched), self.k)
            self.best[touched], self.first[touched], self.name[touched] = score[keep], low[keep], names[keep]

    def result(self) -> pa.RecordBatch:
        item, j = np.nonzero(self.best > 0)
        names = self.name[item, j]
        return pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(self.best[item, j]), pa.array(self.first[item, j]), pa.array(names[:, 0]), pa.array(names[:, 1])],
            ["item", "score", "first", "h1", "h2"])


def _named(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with the name (h1, h2) of their class, and the classes: (h1, h2, m, v, first)."""
    for seed in itertools.count():
        d = vectors.withColumn("h1", F.xxhash64(F.lit(2 * seed), "v", "m")).withColumn("h2", F.xxhash64(F.lit(2 * seed + 1), "v", "m"))
        classes = cut(d.filter("length(v) > 0").groupBy("h1", "h2", "m", "v").agg(F.min("doc_id").alias("first")))
        if not classes.groupBy("h1", "h2").count().filter("count > 1").limit(1).count():
            return d, classes


def _search_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``docs`` (doc_id, text as bytes); ``items`` (item_id, terms), which fit the driver and the tasks."""
    spark = docs.sparkSession
    asked = items.toArrow()
    ids_of = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(asked), dtype=np.int32)), "item_id": asked.column("item_id")}))
    words = sorted({w for t in asked.column("terms").to_pylist() for w in t})
    number = {w: i for i, w in enumerate(words)}
    item_terms = [np.array([number[w] for w in t], np.int64) for t in asked.column("terms").to_pylist()]
    d = cut(docs.select("doc_id", _vectors(spark.sparkContext.broadcast(words))("text").alias("x")).select("doc_id", "x.*").filter("n > 0"))
    n_docs, length = d.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = d.select("v").mapInArrow(_term_documents, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(words), np.int64)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    m = F.lit(100 - 90) + F.expr(f"(90 * n * {n_docs}L) div {max(1, length)}L")
    members, classes = _named(d.withColumn("m", m.cast("bigint")).drop("n"))
    shared = spark.sparkContext.broadcast((item_terms, weights))

    def best(batches):
        scorer = Scorer(*shared.value, k)
        for b in batches:
            if len(b):
                first = b.column("first").fill_null(LAST).to_numpy()
                scorer.add(b.column("v").to_pylist(), b.column("m").to_numpy(), first,
                           np.stack([b.column("h1").to_numpy(), b.column("h2").to_numpy()], 1))
        yield scorer.result()

    found = classes.mapInArrow(best, "item int, score bigint, first bigint, h1 bigint, h2 bigint")
    order = (F.desc("score"), "first", "h1")
    salted = found.withColumn("salt", F.pmod("h2", F.lit(SALT)))
    salted = salted.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("r") <= k)
    top = cut(salted.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("r") <= k)
              .select("item", "score", "h1", "h2"))
    names = top.select("h1", "h2").distinct()
    few = names.count() <= BROADCAST_CLASSES
    within = Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("doc_id"))
    first = members.select("doc_id", "h1", "h2").join(F.broadcast(names) if few else names, ["h1", "h2"], "left_semi") \
        .withColumn("r", F.row_number().over(within)).filter(F.col("r") <= k).drop("r")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return top.join(first, ["h1", "h2"]).withColumn("rank", rank).filter(F.col("rank") <= k) \
        .join(ids_of, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item of ``items`` (item_id, text) its k best rows of ``docs``
    (doc_id whole number, text) with a score above 0; equal scores by ascending doc_id, rows without an id last.

    Null and texts without a term are no documents and no items.  Rows of one item_id (null
    included) are one item with the terms of all.  Repeated rows of ``docs`` are documents each.
    No documents, or no items, give no rows.  Other columns play no part."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    t = items.select("item_id", F.explode(_distinct_terms()(F.col("text").cast("binary"))).alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    size = F.aggregate("terms", F.lit(0).cast("bigint"), lambda a, w: a + F.octet_length(w))
    t = cut(t.withColumn("bytes", size))
    total, many = t.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, math.ceil(total / VOCAB_BYTES), math.ceil(many / BLOCK_ITEMS))
    dealt = t.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    return reduce(DataFrame.unionByName, [_search_block(d, dealt.filter(F.col("block") == b).select("item_id", "terms"), k) for b in range(blocks)])
