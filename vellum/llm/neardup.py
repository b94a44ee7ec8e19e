"""Near-duplicate groups by bottom-k sketches of one hash function.

A document's set is its distinct word shingles, as 64-bit hashes; its sketch is the
``SKETCH`` smallest.  Documents with equal sets form a class and go on as one.

1. Inverted lists: each class is posted under the smallest ``LISTED`` values of its
   sketch.  Two sets of Jaccard ``SIMILAR`` share at least ``least_common`` of them
   (certain up to 25 shingles; beyond, each shared with probability
   0.8 and ten of 32 needed, missed less than once in 10^8 pairs), so with values
   ordered from rare to common a class need only be posted under its rarest
   ones (prefix filter): common values, such as a licence's, are hardly posted.
2. Overlaps: every member of a list is compared with the list's pivot, the member
   whose values are shared most.  A pair within one component needs no comparison, as
   only components are asked for, so lists of one component are done.
3. The members of the other lists get a second, exact prefix filter on their full sets: sets
   of sizes n and m are similar only if they share 0.8 / 1.8 * (n + m) values, so, by size
   of the partner, only a set's rarest values are posted, fewer than a tenth for an equal
   size.  What lies outside a list's largest component is compared with the list's other
   components, after further pivot rounds while that would be many pairs.  A copy
   with too many words of its own to be similar to anything is not posted at all, and
   parity bitmaps of the sets rule out most of the rest before a pair is made.
4. A pair's Jaccard, estimated from the bottom ``SKETCH`` of the union of both sketches,
   discards it when six standard errors below ``SIMILAR``; so do the sizes.
5. Verification: exact Jaccard on the full sets.

Nothing data-sized reaches the driver; what several steps read is written once to the shared folder.
"""

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Tables, held

SKETCH = 64
LISTED = 32
#: Jaccard in percent; a pair is linked from here on.
SIMILAR = 80
#: Sets up to this size have partners that are listed whole.
WHOLE = 25
COMMON = 10
#: Six standard errors of the estimate from SKETCH values.
MARGIN = 0.3
#: Ids up to this many are broadcast when their texts are read again (8 bytes each).
BROADCAST_IDS = 500_000
#: Comparisons per posting above which another pivot round comes before the rest.
EXPAND_RATIO = 16
ROUNDS = 4
#: Edges (16 bytes each) that one task joins up.
LOCAL_EDGES = 1_000_000
#: Sizes are told apart to this ratio where partners are posted by size.
SIZE_STEP = 1.01
PARITY = 512


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes.  A-Z become lower case, words are cut at
    ASCII blanks; fewer than ``width`` words make one shingle, none makes none."""
    words = text.encode().lower().split() if text else ()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    x = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(len(h), width)):
        x = (x ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((x ^ x >> np.uint64(32)).view(np.int64))


def parity_bits(values: np.ndarray) -> np.ndarray:
    """PARITY bits, each the parity of the values that fall on it: two sets differ in
    at least as many values as their bits differ in places."""
    return np.packbits(np.bincount(values & PARITY - 1, minlength=PARITY).astype(np.uint8) & 1).view(np.int64)


def _sketcher(width: int):
    @arrow_udf("struct<n:bigint,d1:bigint,d2:bigint,sketch:array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("neardup")
        for texts in batches:
            n, digest, sketch = [], [], []
            for text in texts.to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketch.append(s[:SKETCH])
            d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2) if digest else np.zeros((0, 2), np.int64)
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sketch, pa.list_(pa.int64()))],
                ["n", "d1", "d2", "sketch"])

    return run


def _full_sets(width: int):
    @arrow_udf("struct<set:array<bigint>,bits:array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("neardup")
        for texts in batches:
            sets = [shingle_set(t, width) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array(sets, pa.list_(pa.int64())),
                                              pa.array([parity_bits(x) for x in sets], pa.list_(pa.int64()))], ["set", "bits"])

    return run


def least_common(n: Column) -> Column:
    """Listed values that a linked pair shares at least, by the size of one set."""
    return F.when(n <= WHOLE, F.ceil(n * (SIMILAR / 100))).otherwise(COMMON).cast("int")


def postings(classes: DataFrame) -> DataFrame:
    """The rare ends of the lists, for values of two classes or more."""
    listed = classes.select("cid", "n", F.slice("sketch", 1, LISTED).alias("s"))
    rows = listed.select("cid", "n", F.size("s").alias("size"), F.explode("s").alias("value"))
    df = rows.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = rows.join(df, "value").groupBy("cid", "n", "size").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"), F.sum("df").alias("weight"))   # LISTED at most
    # values of this class alone come first in its order, and no list
    alone = F.col("size") - F.size("v")
    posted = F.greatest(F.lit(0), F.col("size") - least_common(F.col("n")) + 1 - alone).cast("int")
    return shared.filter(posted > 0).select("cid", "weight", F.explode(F.slice("v", F.lit(1), posted)).alias("v")) \
        .select(F.struct(F.col("v.value").alias("value"), F.lit(0).alias("i"), F.lit(0).alias("j")).alias("list"), "cid", "weight",
                F.lit(0).alias("n"), F.lit(0).alias("left"), F.lit(0).alias("own"))


def exact_postings(sets: DataFrame) -> DataFrame:
    """Postings of full sets (cid, set, with its hash sid, size n and bits) by value and the size steps of both partners, i <= j.

    A value at place p of a set of n, from rare to common, can be the first that is
    shared with a similar set of m only if n - p >= share(n + m)."""
    step = lambda x: F.floor(F.log(x) / F.log(F.lit(SIZE_STEP))).cast("int")
    t = SIMILAR / 100
    # only what is stored goes along with an exploded value: an expression over the set would be computed for each
    rows = sets.withColumn("own", step(F.col("n"))).select("sid", "cid", "bits", "n", "own", F.explode("set").alias("value"))
    df = rows.groupBy("value").agg(F.count(F.lit(1)).alias("df"), F.min("own").alias("low"), F.max("own").alias("high")).filter("df > 1")
    v = rows.join(df, "value").groupBy("sid", "cid", "n", "own", "bits").agg(
        F.sort_array(F.collect_list(F.struct("df", "value", "low", "high"))).alias("v"), F.sum("df").alias("weight"))
    # values of this set alone come first in its order
    v = v.select("cid", "n", "weight", "own", "bits", F.size("v").alias("common"), F.posexplode("v").alias("at", "v"))
    v = v.withColumn("left", F.col("common") - F.col("at")).filter(F.col("left") >= t * F.col("n") - 1e-6)
    # size steps that hold the value; they are few, a logarithm of the largest set
    low, high = F.col("v.low"), F.col("v.high")
    owns = F.when(F.col("v.df") == 2, F.array_distinct(F.array(low, high))).otherwise(F.sequence(low, high))
    v = v.withColumn("other", F.explode(F.filter(owns, lambda o: o.between(step(t * F.col("n")) - 1, step(F.col("n") / t) + 1))))
    smallest = F.floor(F.pow(F.lit(SIZE_STEP), F.col("other"))) - 1
    v = v.filter(F.col("left") >= share(F.col("n"), F.greatest(smallest, t * F.col("n"))))
    return v.select(F.struct(F.col("v.value").alias("value"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("list"),
                    "cid", "weight", "n", "left", "own", "bits")


def share(n: Column, m: Column) -> Column:
    """Values that similar sets of these sizes have in common at least."""
    t = SIMILAR / 100
    return t / (1 + t) * (n + m) - 1e-6


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    c = classes.select("cid", "n", "sketch")
    x = (pairs.join(c.toDF("a", "na", "sa"), "a").filter("na IS NOT NULL").join(c.toDF("b", "nb", "sb"), "b")
         .filter(100 * F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb")))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    x = x.withColumn("u", union)
    shared = F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb"))
    x = x.filter(shared >= (SIMILAR / 100 - MARGIN) * F.size("u")).select("a", "b")
    sets = sets.select("cid", "set")
    s = x.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    s = s.select("a", "b", both.cast("long").alias("both"), F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"))
    return s.filter(100 * F.col("both") >= SIMILAR * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _union_find(batches):
    """(cid, label) of all nodes of the edges of one bounded partition."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if len(b)]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts), return_inverse=True)
    u, v = at.reshape(-1, 2).T
    low = np.arange(len(nodes))                    # positions are in order of ids: the least one labels
    while True:
        a, b = low[u], low[v]
        if (a == b).all():
            break
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[low])], ["cid", "label"])


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(cid, label): the least node of the component of every node of ``edges`` (a, b).  Alternating large and small
    stars, until nothing changes or the edges are at most ``LOCAL_EDGES``, which one task joins up."""
    e = tables.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    seen = None
    while e.count() > LOCAL_EDGES:
        # large star: a node's greater neighbours join its least neighbour
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's lesser neighbours, and the node, join the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, tables.cut(small)
        tables.drop(old)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())
        if now == seen:
            return tables.cut(e.select(F.col("u").alias("cid"), F.col("v").alias("label")).unionByName(
                e.select(F.col("v").alias("cid"), F.col("v").alias("label"))).groupBy("cid").agg(F.min("label").alias("label")))
        seen = now
    label = tables.cut(e.coalesce(1).mapInArrow(_union_find, "cid bigint, label bigint"))
    tables.drop(e)
    return label


def link_classes(classes: DataFrame, sets_of, tables: Tables, links: DataFrame | None = None, stats: dict | None = None) -> DataFrame | None:
    """(cid, label) of classes with a link; ``sets_of(ids)`` gives their full sets.
    ``links`` (a, b) hold beforehand.  None when there is no link to look for."""
    index = tables.cut(postings(classes))
    n_postings = index.count()
    label: DataFrame | None = None
    few_labels = False
    if n_postings:
        ids = tables.cut(index.select("cid").distinct())
        sets = tables.cut(sets_of(ids).withColumn("sid", F.xxhash64("set")).withColumn("n", F.size("set")))
        own = tables.cut(classes.join(ids, "cid", "left_semi"))

    def join_up(edges: DataFrame) -> None:
        """Adds links to the components."""
        nonlocal label, few_labels
        if edges.limit(1).count():
            old = label
            if old is not None:
                edges = edges.unionByName(old.filter("cid != label").select(F.col("cid").alias("a"), F.col("label").alias("b")))
            label = components(edges, tables)
            tables.drop(old)
            few_labels = label.count() <= BROADCAST_IDS

    def place(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with labels; lists of several labels with the size, and the largest, of them."""
        if label is None:
            placed = rows.withColumn("label", F.col("cid"))
        else:
            placed = rows.join(F.broadcast(label) if few_labels else label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        main = placed.groupBy("list", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("list").agg(
            F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("top")).filter("size > top.c")
        return placed, main.select("list", "size", F.col("top.c").alias("c"), F.col("top.label").alias("main"))

    def compare(pairs: DataFrame) -> None:
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found = tables.cut(verified(pairs, own, sets))
        join_up(found)
        tables.drop(found)

    def with_pivot(rest: DataFrame, among: DataFrame) -> DataFrame:
        """Each member with the pivot of its list, where they are of two components."""
        top = among.groupBy("list").agg(F.max(F.struct("weight", "cid", "label")).alias("p"))
        return rest.withColumnsRenamed({"cid": "y", "label": "ly"}).join(
            top.select("list", F.col("p.cid").alias("x"), F.col("p.label").alias("lx")), "list").filter("lx != ly")

    if links is not None:
        join_up(links)
    if not n_postings:
        return label
    placed, _ = place(index)
    compare(with_pivot(placed, placed))
    placed, main = place(index)
    members = tables.cut(placed.join(main, "list", "left_semi").select("cid").distinct())
    tables.drop(index)
    index = tables.cut(exact_postings(sets.join(members, "cid", "left_semi")))
    n_postings = index.count()
    nearest = False
    for turn in itertools.count():
        placed, main = place(index)
        rest = tables.cut(placed.join(main.select("list", "main"), "list").withColumn("out", (F.col("label") != F.col("main")).cast("long")))
        # a list of two sizes compares one with the other only
        sides = rest.groupBy("list", "own").agg(F.count(F.lit(1)).alias("s"), F.sum("out").alias("o")).groupBy("list").agg(
            F.sum("s").alias("s"), F.sum("o").alias("o"), F.sum(F.col("s") * F.col("o")).alias("same"))
        work = sides.agg(F.sum(F.col("s") * F.col("o") - F.when(F.col("list.i") != F.col("list.j"), F.col("same")).otherwise(0))).first()[0] or 0
        if stats is not None:
            stats.setdefault("work", []).append((n_postings, work))
        if not work:
            break
        outside = rest.filter("out = 1")
        if not nearest and turn < ROUNDS and work > EXPAND_RATIO * n_postings:
            compare(with_pivot(rest, outside))
            tables.drop(rest)
            continue
        x, y = (z.select("list", F.col("cid").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("label", "n", "left", "own", "out", "bits")])
                for z, c in ((outside, "x"), (rest, "y")))
        need = share(F.col("n_x"), F.col("n_y"))
        differ = sum(F.bit_count(F.get("bits_x", F.lit(i)).bitwiseXOR(F.get("bits_y", F.lit(i)))) for i in range(PARITY // 64))
        pairs = x.join(y, "list").filter(
            (F.col("label_x") != F.col("label_y")) & ((F.col("out_y") == 0) | (F.col("x") < F.col("y")))
            & ((F.col("list.i") == F.col("list.j")) | (F.col("own_x") != F.col("own_y")))
            & (F.col("left_x") >= need) & (F.col("left_y") >= need) & (differ <= F.col("n_x") + F.col("n_y") - 2 * need))
        if not nearest:
            # first each with its nearest by the bitmaps: one link spares its other pairs
            pairs = pairs.groupBy("x").agg(F.min_by("y", F.struct(differ, "y")).alias("y"))
        if stats is not None:
            stats.setdefault("pairs", []).append(pairs.count())
        compare(pairs)
        tables.drop(rest)
        if nearest:
            break
        nearest = True
    tables.drop(index, members, ids, sets, own)
    return label


def near_duplicates(docs: DataFrame, width: int = 5, stats: dict | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id
    whole number, text).  component_id is the least doc_id reachable over links, the row's
    own included; kept is doc_id = component_id.  Null and empty texts, and texts
    of blanks, have no shingles and link with nothing.  Rows without an id link with
    nothing either: their component_id is null and they are kept.  Repeated rows
    are each returned; rows of one id with different texts are one document with several sets.  Other columns of ``docs`` play no part."""
    tables = Tables(docs.sparkSession)
    d = docs.select("doc_id", "text")
    signed = tables.cut(d.select("doc_id", _sketcher(width)("text").alias("s")).select("doc_id", "s.*"))
    classes = tables.cut(signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("cid"), F.first("sketch").alias("sketch")))

    def sets_of(ids: DataFrame) -> DataFrame:
        few = ids.count() <= BROADCAST_IDS
        ids = ids.withColumnRenamed("cid", "doc_id")
        rows = d.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        return rows.select(F.col("doc_id").alias("cid"), _full_sets(width)("text").alias("s")).select("cid", "s.*")

    # an id with several texts is one document with several sets: it links their classes
    several = signed.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "d1", "d2", "n").groupBy("doc_id").agg(
        F.min("d1").alias("low"), F.max("d1").alias("high")).filter("low < high").select("doc_id")
    same_id = None
    if several.limit(1).count():
        held = signed.join(several, "doc_id").join(classes, ["d1", "d2", "n"]).select("doc_id", "cid")
        same_id = held.join(held.groupBy("doc_id").agg(F.min("cid").alias("a")), "doc_id").select("a", F.col("cid").alias("b"))
    label = link_classes(classes, sets_of, tables, same_id, stats)
    group = classes.select("d1", "d2", "n", "cid")
    group = group.withColumn("label", F.col("cid")) if label is None else group.join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    named = signed.select("doc_id", "d1", "d2", "n").join(group.select("d1", "d2", "n", "label"), ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
