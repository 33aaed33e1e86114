"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row counts, column names and order-insensitive values.

    python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{v:.6g}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def compare(spark, con, name, build, sql, sf_dir, show=3):
    t0 = time.time()
    df = build(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    s_sorted, s_cols = rows_of(df.columns, srows)
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), spark_s=round(t1 - t0, 2), note="rows-only")
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    d_sorted, d_cols = rows_of(dcols, drows)
    ok = s_cols == d_cols and s_sorted == d_sorted
    info = dict(name=name, ok=ok, rows=len(srows), oracle_rows=len(drows), spark_s=round(t1 - t0, 2))
    if not ok:
        if s_cols != d_cols:
            info["cols"] = (s_cols, d_cols)
        else:
            a, b = set(s_sorted), set(d_sorted)
            info["only_spark"] = sorted(a - b)[:show]
            info["only_oracle"] = sorted(b - a)[:show]
    return info


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from branchdata.plans.registry import builders, oracles
    from branchdata.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    b, o = builders(), oracles()
    bad = 0
    for name in names or sorted(b):
        try:
            info = compare(spark, con, name, b[name], o.get(name), sf_dir)
        except Exception as exc:
            info = dict(name=name, ok=False, error=f"{type(exc).__name__}: {str(exc)[:400]}")
            traceback.print_exc(limit=3)
        bad += info.get("ok") is False
        print(info, flush=True)
    print(f"mismatches: {bad} of {len(names or b)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
