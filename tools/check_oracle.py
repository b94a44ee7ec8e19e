"""Run registered queries in Spark and their oracle SQL in DuckDB on the same
tables and compare row counts, column names and values (order-insensitive).

    python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from vellum.catalog import ORACLE, QUERIES, load_all  # noqa: E402
from vellum.session import local_session  # noqa: E402
from vellum.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) + 0.0
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    load_all()
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in (names or list(QUERIES)):
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in ORACLE:
            print(f"rows {name}: {len(sdf)} rows (no oracle) {dt:.1f}s")
            continue
        try:
            odf = con.execute(ORACLE[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: sql error {str(e)[:400]}")
            bad += 1
            continue
        sc, sr = rows_of(sdf)
        oc, orr = rows_of(odf)
        if sc != oc:
            print(f"FAIL {name}: columns {sc} vs {oc}")
            bad += 1
        elif len(sr) != len(orr):
            print(f"FAIL {name}: rows {len(sr)} vs {len(orr)}")
            bad += 1
        elif sr != orr:
            diff = [(a, b) for a, b in zip(sr, orr) if a != b][:3]
            print(f"FAIL {name}: values differ, e.g. {diff}")
            bad += 1
        else:
            print(f"ok   {name}: {len(sr)} rows {dt:.1f}s")
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
