"""Run registered queries against their DuckDB oracle (like the driver's gate).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        v = round(v, 6)
        return repr(0.0 if v == 0 else v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    sh, sl = digest(s_cols, s_rows)
    dh, dl = digest(d_cols, d_rows)
    out = {"name": name, "rows": (len(s_rows), len(d_rows)),
           "cols_match": sorted(s_cols) == sorted(d_cols), "hash_match": sh == dh,
           "spark_sec": round(t1 - t0, 2)}
    if not out["cols_match"]:
        out["cols"] = (sorted(s_cols), sorted(d_cols))
    elif sh != dh:
        only_s = sorted(set(sl) - set(dl))[:3]
        only_d = sorted(set(dl) - set(sl))[:3]
        out["diff"] = {"cols": sorted(s_cols), "spark_only": only_s, "duck_only": only_d}
    return out


def main():
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from cohortflow import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session()
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        if name not in os_:
            df = qs[name](spark, sf_dir)
            print({"name": name, "rows_only": df.count()})
            continue
        try:
            r = compare(spark, con, name, qs[name], os_[name], sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "error": repr(e)[:800]}
        ok = r.get("hash_match") and r.get("cols_match")
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
