"""Run registered queries in Spark and their SQL in DuckDB; compare like the driver.

Usage: python tools/check_oracle.py [sf_dir] [name ...]
Compares row count, sorted column names, and the multiset of rows
(columns sorted by name, values normalised to Python scalars).
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if v == int(v) and abs(v) < 1e15:
            return float(int(v))
        return float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, int):
        return float(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: json.dumps(t, default=str))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import duckdb
    from tabsmith.session import get_spark
    from tabsmith.plans.catalog import load_all
    spark = get_spark("local[8]", shuffle_partitions=8)
    queries, oracle = load_all()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ok = bad = 0
    for name in names or list(queries):
        t0 = time.time()
        try:
            sdf = queries[name](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in oracle:
            print(f"ROWS {name}: {len(srows)} rows ({ts:.1f}s) [no oracle]")
            continue
        try:
            cur = con.execute(oracle[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={sorted(scols)} duck={sorted(dcols)}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a == b:
            print(f"OK   {name}: {len(a)} rows ({ts:.1f}s)")
            ok += 1
        else:
            bad += 1
            print(f"FAIL {name}: spark {len(a)} rows, duck {len(b)} rows; cols {sorted(scols)}")
            sa, sb = set(a), set(b)
            print("   spark-only:", list(sa - sb)[:4])
            print("   duck-only: ", list(sb - sa)[:4])
    print(f"== {ok} ok, {bad} failed, {len(queries)} registered, {len(oracle)} with oracle")


if __name__ == "__main__":
    main()
