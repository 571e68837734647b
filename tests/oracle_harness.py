"""Run a catalogue query in Spark and its oracle SQL in DuckDB; compare.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6))
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def table_hash(cols, rows) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    ok_cols = sorted(scols) == sorted(dcols)
    ok_n = len(srows) == len(drows)
    hs, hd = table_hash(scols, srows), table_hash(dcols, drows)
    return dict(name=name, ok=ok_cols and ok_n and hs == hd, cols=ok_cols, rows=(len(srows), len(drows)),
                hash=hs == hd, spark_s=round(t1 - t0, 2), scols=scols, dcols=dcols,
                srows=srows, drows=drows)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from churnspark.session import local_session
    import __spark_entry__ as E
    spark = local_session(8, 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or list(sqls)):
        try:
            r = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            print(f"ERROR {name}: {type(e).__name__}: {str(e)[:600]}")
            bad += 1
            continue
        flag = "OK " if r["ok"] else "BAD"
        print(f"{flag} {name:22s} rows={r['rows']} cols={r['cols']} hash={r['hash']} {r['spark_s']}s")
        if not r["ok"]:
            bad += 1
            if not r["cols"]:
                print("   spark:", r["scols"], "\n   duck: ", r["dcols"])
            else:
                order_s = sorted(range(len(r["scols"])), key=lambda i: r["scols"][i])
                order_d = sorted(range(len(r["dcols"])), key=lambda i: r["dcols"][i])
                ss = sorted(tuple(_norm(x[i]) for i in order_s) for x in r["srows"])
                dd = sorted(tuple(_norm(x[i]) for i in order_d) for x in r["drows"])
                diff = [(a, b) for a, b in zip(ss, dd) if a != b][:3]
                print("   cols:", sorted(r["scols"]))
                for a, b in diff:
                    print("   S:", a, "\n   D:", b)
    print(f"{bad} failing of {len(names or sqls)}")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
