"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
The comparison mirrors the driver: same column names, same row count, and the
same multiset of rows (order-insensitive); floats compared exactly and, as a
diagnostic, with a 1e-9 relative tolerance.
"""

from __future__ import annotations

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
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return (2, float(v))
    if isinstance(v, int):
        return (2, float(v))
    return (3, str(v))


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records), [columns[i] for i in order]


def close(a, b, rel=1e-9):
    for x, y in zip(a, b):
        if x == y:
            continue
        if x[0] == 2 and y[0] == 2 and abs(x[1] - y[1]) <= rel * max(1.0, abs(x[1]), abs(y[1])):
            continue
        return False
    return True


def compare(spark, con, name, build, sql, sf_dir):
    t0 = time.time()
    sdf = build(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(s_rows), "status": "no-oracle", "spark_s": round(t1 - t0, 2)}
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    a, ac = rows_of(s_cols, s_rows)
    b, bc = rows_of(d_cols, d_rows)
    out = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "spark_s": round(t1 - t0, 2)}
    if ac != bc:
        out["status"] = f"COLUMNS differ spark={ac} oracle={bc}"
    elif len(a) != len(b):
        out["status"] = "ROWCOUNT differs"
    elif a == b:
        out["status"] = "ok"
    elif all(close(x, y) for x, y in zip(a, b)):
        out["status"] = "ok~ (float noise)"
    else:
        bad = [(x, y) for x, y in zip(a, b) if not close(x, y)]
        out["status"] = f"VALUES differ ({len(bad)} rows) e.g. {bad[0]}"
    return out


def main(argv):
    sys.path.insert(0, ".")
    from pricelens.session import local_session
    import __spark_entry__ as E
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n, build in qs.items():
        if names and not any(n.startswith(x) for x in names):
            continue
        try:
            r = compare(spark, con, n, build, sqls.get(n), sf_dir)
        except Exception as ex:  # report and continue
            r = {"name": n, "status": f"ERROR {type(ex).__name__}: {str(ex)[:300]}"}
        ok = r["status"].startswith("ok") or r["status"] == "no-oracle"
        bad += not ok
        print(("  " if ok else "!!") + f" {r}", flush=True)
    print(f"{len(qs)} queries, {len(sqls)} oracles, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
