"""Decontamination, lexical search and the conversation trie against brute force, with nulls,
empty and long texts, ties, repeated rows, empty tables and further columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vellum.llm import decontaminate, lexical, trie
from vellum.llm.common import ready
from vellum.llm.terms import terms

rng = random.Random(11)
WORDS = ["alpha", "Beta", "gamma", "été", "x1", "42", "STONE", "日本", "paper", "light"]
DOCS = "doc_id long, text string, h bigint, item_id string, w string, places int, term string"
ITEMS = "item_id long, text string, m int, doc_id long"


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    ready(spark)


def prose(n, r=rng):
    return "".join(r.choice(WORDS) + r.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(n))


def term_list(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def doc_rows(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, "z") for i, t in rows], DOCS)


def item_rows(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], ITEMS)


def test_terms():
    for t in [None, "", " \n", "A-b_C", "Ünï \x85x\xa0y", prose(50)]:
        assert [w.decode() for w in terms(None if t is None else t.encode())] == term_list(t)


ITEM_ROWS = [(1, prose(25)), (2, "alpha beta"), (3, prose(10)), (4, None), (5, " ,"), (6, prose(60)), (None, "zeta unique words here"), (3, "paper 42 日本 light"),
             (7, "alpha alpha alpha alpha alpha alpha alpha alpha alpha alpha alpha alpha"), (8, "alpha beta"), (8, "alpha beta")]
DOC_ROWS = [(1, None), (2, ""), (3, ITEM_ROWS[0][1]), (3, ITEM_ROWS[0][1]), (3, "other"), (None, "before zeta, Unique words HERE after"), (4, "x " + ITEM_ROWS[5][1] + " y " + ITEM_ROWS[2][1]),
            (5, "alpha " * 5000 + "beta"), (6, prose(400)), (7, " ".join(term_list(ITEM_ROWS[5][1])[5:16])), (8, " ".join(term_list(ITEM_ROWS[5][1])[5:14])),
            *((20 + i, "prefix " + ITEM_ROWS[0][1] + f" tail{i}") for i in range(30)), *((60, "same copy ALPHA beta") for _ in range(40))]


def brute_contamination(docs, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = term_list(t)
        m = min(window, len(w))
        for at in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[at:at + m])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = term_list(t), set(), set()
        for m in {len(x) for x in windows}:
            for at in range(len(w) - m + 1):
                if tuple(w[at:at + m]) in windows:
                    hit |= set(range(at, at + m))
                    found |= {str(x) for x in windows[tuple(w[at:at + m])] if x is not None}
        out.append((i, len(w), len(hit), len(found), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


def contamination(spark, docs, items):
    rows = decontaminate.contamination(doc_rows(spark, docs), item_rows(spark, items)).collect()
    return sorted([(r[0], r[1], r[2], r[3], tuple(r[4]), r[5]) for r in rows], key=repr)


def test_contamination(spark):
    want = brute_contamination(DOC_ROWS, ITEM_ROWS)
    assert contamination(spark, DOC_ROWS, ITEM_ROWS) == want
    assert sum(r[-1] for r in want) > 70


def test_contamination_without_broadcast_and_filter(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 64)       # nearly everything passes the filter
    assert contamination(spark, DOC_ROWS, ITEM_ROWS) == brute_contamination(DOC_ROWS, ITEM_ROWS)


def test_contamination_of_empty_tables(spark):
    assert contamination(spark, [], ITEM_ROWS) == []
    assert contamination(spark, DOC_ROWS[:4], []) == brute_contamination(DOC_ROWS[:4], [])


def brute_search(docs, items, k):
    rows = [(i, Counter(term_list(t))) for i, t in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    n, length = len(rows), sum(r[2] for r in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(term_list(t))
    out = []
    for item, some in asked.items():
        scored = []
        for i, c, size in rows:
            m = 10 + (90 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in some if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, x[2], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, k=10):
    return sorted(map(tuple, lexical.search(doc_rows(spark, docs), item_rows(spark, items), k).collect()), key=repr)


def test_search(spark):
    docs = [*DOC_ROWS, *((i, prose(12)) for i in range(100, 200)), *((i, DOC_ROWS[8][1]) for i in (-3, 900, 901)), (None, prose(8))]
    rng.shuffle(docs)
    want = brute_search(docs, ITEM_ROWS, 10)
    assert searched(spark, docs, ITEM_ROWS) == want
    assert len({r[0] for r in want}) > 6


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "VOCAB_BYTES", 60)
    monkeypatch.setattr(lexical, "CELLS", 7)
    monkeypatch.setattr(lexical, "BROADCAST_CLASSES", 0)
    assert searched(spark, DOC_ROWS, ITEM_ROWS, 3) == brute_search(DOC_ROWS, ITEM_ROWS, 3)


def test_search_classes_share_no_name(spark):
    d = spark.createDataFrame([(i, bytes([i % 3]) * 8, i % 2) for i in range(60)], "doc_id long, v binary, m bigint")
    members, classes = lexical._named(d)
    assert classes.count() == 6 and classes.select("h1", "h2").distinct().count() == 6
    assert {r["first"] for r in classes.collect()} == set(range(6)) and members.count() == 60


def test_search_of_empty_tables(spark):
    assert searched(spark, [], ITEM_ROWS) == [] and searched(spark, DOC_ROWS, []) == []
    assert searched(spark, [(1, None), (2, "-")], ITEM_ROWS) == []


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256((str(len(role.encode())) + ":" + role + text).encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    path = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(path):
        for d in range(len(path[c]) + 1):
            members[path[c][:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        own_saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own_saved
    return sorted([(m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in m if len(path[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()], key=repr)


def turns(seed, convs, longest=7, words=3):
    r = random.Random(seed)
    out = []
    for c in convs:
        out += [(c, r.choice([None, 0, 1, 2, 2, 3, 4]) if r.random() < .3 else i, r.choice(["user", "assistant", None]), " ".join(r.choice("ab") for _ in range(r.randint(0, words))) or None)
                for i in range(r.randint(1, longest))]
    return out


def tried(spark, rows):
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest binary")
    return sorted([tuple(r)[1:] for r in trie.prefix_trie(df).collect()], key=repr)


def test_trie(spark):
    rows = turns(1, [*range(0, 90), *range(203, 219), -1, -19, -20, -40, -45]) + [(None, 1, "user", "x")]
    rows += [(400, i, "user", f"long {i}") for i in range(300)] + [(c, i, "user", f"long {i}") for c in (401, 402) for i in range(300)]
    rows += rows[:5]
    assert tried(spark, rows) == brute_trie(rows)


def test_trie_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_ROWS", 40)
    monkeypatch.setattr(trie, "PIECE_IDS", 3)
    rows = turns(2, range(150), 5, 1) + [(c, 0, "user", "hot first") for c in range(1000, 1100)]
    assert tried(spark, rows) == brute_trie(rows)


def test_trie_of_empty_table(spark):
    assert tried(spark, []) == []


def test_node_table():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 20_000):
        keys = r.integers(0, 2 ** 63, (n, 2)).astype(np.uint64)
        t = trie.NodeTable(keys)
        assert sorted(t.slots(keys).tolist()) == list(range(n))
        assert (t.slots(r.integers(0, 2 ** 63, (50, 2)).astype(np.uint64)) == -1).all()


def test_accumulate():
    depth, parent = np.array([2, 0, 1, 1, 2]), np.array([2, -1, 1, 1, 2])
    a, b = np.array([1, 1, 1, 1, 1]), np.array([5, 0, 2, 1, 0])
    trie.accumulate(depth, parent, a, b)
    assert a.tolist() == [1, 5, 3, 1, 1] and b.tolist() == [5, 8, 7, 1, 0]
