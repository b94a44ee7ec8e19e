"""Fixture builders shared by the tests (hand-made data from FIXTURES.md)."""

from __future__ import annotations

import numpy as np

from vellum.schema import CHUNKS, DOCUMENTS, LIBRARIES, QUERIES


def corpus(spark, chunks_rows, lib="lib", doc="doc", lib_meta=None, doc_meta=None):
    libs = spark.createDataFrame([(lib, lib_meta or {"name": "Test Library"})], LIBRARIES)
    docs = spark.createDataFrame([(lib, doc, 0, doc_meta or {"title": "Test Document"})], DOCUMENTS)
    rows = [(lib, doc, cid, i, text, [float(x) for x in emb], md) for i, (cid, text, emb, md) in enumerate(chunks_rows)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    return libs, docs, chunks


def queries(spark, rows):
    """rows: (query_id, library_id, embedding, k, filters)"""
    return spark.createDataFrame([(q, lib, [float(x) for x in e], k, f) for q, lib, e, k, f in rows], QUERIES)


FX1 = [
    ("1", "This is the first chunk", [1, 0, 0], {"page": "1"}),
    ("2", "This is the second chunk", [0, 1, 0], {"page": "2"}),
    ("3", "This is the third chunk", [0, 0, 1], {"page": "3"}),
]


def brute_topk(ids, vecs, q, k):
    """Exact top-k by (score desc, id asc) with NumPy in float64."""
    m = np.asarray(vecs, dtype=np.float64)
    n = np.linalg.norm(m, axis=1)
    m = np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)
    qv = np.asarray(q, dtype=np.float64)
    qn = np.linalg.norm(qv)
    qv = qv / qn if qn > 0 else qv
    s = m @ qv
    order = sorted(range(len(ids)), key=lambda i: (-round(s[i], 12), ids[i]))
    return [(ids[i], float(s[i])) for i in order[:k]]


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


