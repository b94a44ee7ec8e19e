"""Prefix trie of conversations, as a table of nodes with a minimal perfect hash.

1. Every conversation is rebuilt and its turns are folded into digests: a node is the
   128-bit digest of all turns down to it.  Conversations stream through the tasks turn by
   turn; texts are reduced to a digest and a word count before anything is shuffled.
2. Conversations are range-partitioned by their first nodes and id into shards of about
   ``SHARD_ROWS`` turns, so a first turn that a third of them share is many shards.
   A shard enumerates its distinct prefix digests, gives each a slot by a minimal perfect hash whose table keeps
   the digest (a lookup of any other digest is refused), and scatters its counts into flat arrays.
3. The shards' counts are added up per digest.  Of a node's shards the least owns it.
4. A shard's nodes come back with the totals.  What a node gives to its subtree sums counts in the shard that owns it;
   arrays over the slots are accumulated through the parent slots, deepest nodes first, and
   the shards' partial sums are added up per digest.  A sum over a subtree is thereby
   complete wherever the shards cut the trie.
5. Members that end in a node are hashed in order of their ids: pieces of a node's list are
   made in range-partitioned tasks, and one stream joins the pieces.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

#: Turns of a shard, about; some 100 bytes each in a task.
SHARD_ROWS = 200_000
#: Load factor of the levels of the hash; expected levels are few.
GAMMA = 2.0
#: A conversation takes the head of the one at the multiple of this below its id.
BASE = 20
#: Ids of one piece of a node's list of members.
PIECE_IDS = 50_000
ROOT = b"\0" * 16
EMPTY = hashlib.sha256(b"").hexdigest()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class NodeTable:
    """A minimal perfect hash of distinct digests (n x 2 unsigned 64-bit words).

    Level after level, the digests that fall alone on a place of a bit array stay there; the
    others go on.  A digest's slot is its place's rank over all levels."""

    def __init__(self, keys: np.ndarray):
        self.levels, rest, base = [], keys, 0
        while len(rest):
            size = max(64, int(GAMMA * len(rest)))
            at = self._place(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            rest = rest[~alone[at]]
        self.digests = np.zeros_like(keys)
        self.digests[self._slots(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (_mix(keys[:, 0] ^ _mix(keys[:, 1] + seed)) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(keys[todo], level, len(alone))
            hit = alone[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 for one that is not in the table."""
        out = self._slots(keys)
        known = np.flatnonzero(out >= 0)
        out[known[(self.digests[out[known]] != keys[known]).any(1)]] = -1
        return out


def accumulate(depth: np.ndarray, parent: np.ndarray, *values: np.ndarray) -> None:
    """Adds to every slot, in place, the values of all slots below it."""
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        if len(level) and depth[level[0]] > 0:
            for v in values:
                np.add.at(v, parent[level], v[level])


def _keys(column) -> np.ndarray:
    """n x 2 words of a column of 16-byte digests."""
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, "<u8").reshape(-1, 2).copy()


def _digests(keys: np.ndarray) -> pa.Array:
    return pa.array([k.tobytes() for k in keys], pa.binary())


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, rn, turn_sha, words): the turns of every rebuilt conversation in
    the order (part, rn), and a row of part 0 without a turn for each conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    t = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", word_count(text).alias("words"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("turn_sha"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "turn_sha")
    t = cut(t.withColumn("rn", F.row_number().over(order).cast("long")))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    own = t.withColumn("h", head)
    each = own.filter("rn = 1").select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"))
    heads = t.filter((F.col("rn") <= 3) & (F.col("conv_id") % BASE == 0)).select(F.col("conv_id").alias("base"), "rn", "turn_sha", "words")
    first = each.join(heads, "base").filter("rn <= h").select("conv_id", F.lit(1).alias("part"), "rn", "turn_sha", "words")
    rest = own.filter("rn > h").select("conv_id", F.lit(2).alias("part"), "rn", "turn_sha", "words")
    top = each.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("rn"), F.lit(None).cast("binary").alias("turn_sha"), F.lit(0).cast("long").alias("words"))
    return first.unionByName(rest).unionByName(top)


_NODE_ROWS = "conv_id bigint, depth bigint, digest binary, parent binary, words bigint, k1 binary, k2 binary, last boolean"


def _fold(batches):
    """Turns in order to nodes: the digest of all turns down to each.  A conversation's first
    two nodes order the shards; a row is held back until it is known to be the last or not."""
    now = depth = held = digest = k1 = k2 = None
    for b in batches:
        out = []
        for conv, sha, words in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn_sha", "words"))):
            if conv != now:
                if held:
                    out += [(*row, k1, k2, i == len(held) - 1) for i, row in enumerate(held)]
                now, depth, digest, k1, k2, held = conv, 0, ROOT, ROOT, ROOT, [(conv, 0, ROOT, None, 0)]
                continue
            parent, depth = digest, depth + 1
            digest = hashlib.blake2b(parent + sha, digest_size=16).digest()
            k1, k2 = (digest if depth == 1 else k1), (digest if depth == 2 else k2)
            held.append((conv, depth, digest, parent, words))
            if depth > 2:
                out += [(*row, k1, k2, False) for row in held[:-1]]
                held = held[-1:]
        yield _rows(out)
    if held:
        yield _rows([(*row, k1, k2, i == len(held) - 1) for i, row in enumerate(held)])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in _NODE_ROWS.split(", ")])


_SHARD = "shard int, slot bigint, parent_slot bigint, depth bigint, digest binary, words bigint, n bigint, conv_id bigint, inner_ boolean"


def _count(batches):
    """The node table of a shard with its counts."""
    batches = [b for b in batches if len(b)]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    keys = _keys(t.column("digest"))
    _, one = np.unique(keys, axis=0, return_index=True)
    table = NodeTable(keys[one])
    slot = table.slots(keys)
    n, conv = len(one), t.column("conv_id").to_numpy()
    members = np.bincount(slot, minlength=n)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, conv)
    depth, words, parent = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    depth[slot], words[slot] = t.column("depth").to_numpy(), t.column("words").to_numpy()
    below = np.flatnonzero(t.column("depth").to_numpy() > 0)
    parent[slot[below]] = table.slots(_keys(t.column("parent").take(pa.array(below))))
    inner = np.zeros(n, bool)
    inner[parent[parent >= 0]] = True
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, t.column("shard")[0].as_py(), np.int32)), pa.array(np.arange(n)), pa.array(parent), pa.array(depth), _digests(table.digests),
         pa.array(words), pa.array(members), pa.array(least), pa.array(inner)], [c.split()[0] for c in _SHARD.split(", ")])


_PART = "digest binary, parent_conv_id bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def _subtrees(t: pa.Table) -> pa.Table:
    """A shard's share of every node's subtree sums."""
    t = t.sort_by("slot")
    get = lambda c: t.column(c).to_numpy()
    depth, parent, conv, owned = get("depth"), get("parent_slot"), get("node_conv"), get("owner") == get("shard")
    leaves = (owned & ~get("node_inner").astype(bool)).astype(np.int64)
    saved = np.where(owned, (get("total") - 1) * get("words"), 0)
    children = np.bincount(parent[owned & (parent >= 0)], minlength=len(t))
    accumulate(depth, parent, leaves, saved)
    up = pa.array(conv[np.maximum(parent, 0)], mask=parent < 0)
    return pa.table({"digest": t.column("digest"), "parent_conv_id": up, "n_children": children, "n_leaves": leaves, "saved_tokens": saved})


def _pieces(batches):
    """(digest, first conv_id, joined ids) of rows in order of digest and id."""
    digest, first, ids = None, None, []
    for b in batches:
        out = []
        for d, c in zip(b.column("digest").to_pylist(), b.column("conv_id").to_pylist()):
            if d != digest or len(ids) >= PIECE_IDS:
                if ids:
                    out.append((digest, first, ",".join(ids)))
                digest, first, ids = d, c, []
            ids.append(str(c))
        yield _piece_rows(out)
    if ids:
        yield _piece_rows([(digest, first, ",".join(ids))])


def _piece_rows(rows):
    cols = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.string()))], ["digest", "first", "ids"])


def _hash_pieces(batches):
    """(digest, ends_sha256) of pieces in order of digest and first id."""
    digest, state = None, None
    for b in batches:
        out = []
        for d, ids in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist()):
            if d != digest:
                if state:
                    out.append((digest, state.hexdigest()))
                digest, state = d, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_pylist([{"digest": d, "ends_sha256": s} for d, s in out], pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())]))
    if state:
        yield pa.RecordBatch.from_pylist([{"digest": digest, "ends_sha256": state.hexdigest()}])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt ``conversations`` (conv_id, turn, role, text): digest, conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, null first, equal ones by the SHA-256 of role and text; repeated rows
    are turns each.  Null roles and texts are empty.  Rows without a conv_id belong to no
    conversation and are left out.  An empty table has no nodes.  Other columns play no part.  A conversation
    is folded in a stream and must fit one shard's arrays, 100 bytes a turn."""
    turns = rebuilt(conversations)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "rn")
               .select("conv_id", "turn_sha", "words").mapInArrow(_fold, _NODE_ROWS))
    n = rows.count()
    shards = max(1, math.ceil(n / SHARD_ROWS))
    placed = rows.select("conv_id", "depth", "digest", "parent", "words", "k1", "k2").repartitionByRange(shards, "k1", "k2", "conv_id")
    local = cut(placed.select(F.spark_partition_id().alias("shard"), "conv_id", "depth", "digest", "parent", "words").mapInArrow(_count, _SHARD))
    nodes = cut(local.groupBy("digest").agg(F.sum("n").alias("total"), F.min("conv_id").alias("node_conv"), F.max("inner_").alias("node_inner"),
                                            F.min("shard").alias("owner"), F.first("depth").alias("depth")))
    back = local.select("shard", "slot", "parent_slot", "depth", "digest", "words").join(nodes.drop("depth"), "digest")
    shares = back.groupBy("shard").applyInArrow(_subtrees, _PART)
    sums = shares.groupBy("digest").agg(F.max("parent_conv_id").alias("parent_conv_id"), F.sum("n_children").alias("n_children"),
                                        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = rows.filter("last").select("digest", "conv_id")
    pieces = ends.repartitionByRange(parts, "digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_pieces, "digest binary, first bigint, ids string")
    hashed = pieces.repartition(parts, "digest").sortWithinPartitions("digest", "first").mapInArrow(_hash_pieces, "digest binary, ends_sha256 string")
    out = nodes.join(sums, "digest").join(hashed, "digest", "left")
    return out.select("digest", F.col("node_conv").alias("conv_id"), "depth", "parent_conv_id", F.col("total").alias("n_convs"), "n_children", "n_leaves",
                      "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
