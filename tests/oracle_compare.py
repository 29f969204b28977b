"""Run catalogue queries on Spark and their SQL on DuckDB and compare (local mirror of
the driver's correctness check: row count, column names, order-insensitive values)."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, (pd.Timestamp,)):
        return str(v.to_pydatetime())
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(records, cols):
    out = []
    for r in records:
        out.append(tuple(_norm(r[c]) for c in cols))
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, sf_dir, name, fn, sql, con=None, verbose=True):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sorted(sdf.columns)
    s_rows = [r.asDict() for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols_raw = [d[0] for d in res.description]
    d_rows = [dict(zip(d_cols_raw, r)) for r in res.fetchall()]
    t2 = time.time()
    d_cols = sorted(d_cols_raw)
    ok_cols = s_cols == d_cols
    ok_n = len(s_rows) == len(d_rows)
    ok_v = False
    diff = None
    if ok_cols and ok_n:
        a, b = rows_of(s_rows, s_cols), rows_of(d_rows, d_cols)
        ok_v = a == b
        if not ok_v:
            for x, y in zip(a, b):
                if x != y:
                    diff = (x, y)
                    break
    if verbose:
        print(f"{name:40s} spark={len(s_rows):6d} ({t1-t0:5.1f}s) duck={len(d_rows):6d} ({t2-t1:4.1f}s) "
              f"cols={'ok' if ok_cols else (s_cols, d_cols)} values={'ok' if ok_v else 'DIFF'}")
        if diff:
            print("   first diff:", str(diff[0])[:600], "\n            vs", str(diff[1])[:600])
    return ok_cols and ok_n and ok_v


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from casestory.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if not a.startswith("/")]
    spark = get_spark(cpus=8, shuffle_partitions=8)
    Q, S = E.queries(), E.oracle_sql()
    con = duck(sf)
    bad = []
    for n in (names or list(Q)):
        if n not in S:
            df = Q[n](spark, sf)
            print(f"{n:40s} rows-only: {df.count()} rows")
            continue
        try:
            if not compare(spark, sf, n, Q[n], S[n], con):
                bad.append(n)
        except Exception as e:  # noqa: BLE001
            print(f"{n:40s} ERROR {type(e).__name__}: {str(e)[:800]}")
            bad.append(n)
    print("FAILED:", bad)
