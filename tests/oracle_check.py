"""Run registered queries next to their DuckDB oracle and compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive multiset of rows.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    return v


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(norm(x) for x in r) for r in df.collect()]
    cols = df.columns
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(rows), spark_s=round(t1 - t0, 2), note="rows-only")
    rel = con.sql(sql)
    ocols = rel.columns
    orows = [tuple(norm(x) for x in r) for r in rel.fetchall()]
    res = dict(name=name, rows=len(rows), orows=len(orows), spark_s=round(t1 - t0, 2))
    if sorted(cols) != sorted(ocols):
        res.update(ok=False, note=f"columns {cols} vs {ocols}")
        return res
    idx = [ocols.index(c) for c in cols]
    orows = [tuple(r[i] for i in idx) for r in orows]
    a = sorted(rows, key=repr)
    b = sorted(orows, key=repr)
    if a == b:
        res.update(ok=True)
    else:
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        res.update(ok=False, note=f"spark-only {diff_a!r:.1500} | oracle-only {diff_b!r:.1500}")
    return res


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from tidepool.session import build_session
    import __spark_entry__ as E
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or list(qs)):
        try:
            r = compare(spark, con, name, qs[name], orc.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = dict(name=name, ok=False, note=f"ERROR {type(e).__name__}: {str(e)[:1500]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"{len(names or qs)} queries, {bad} failing, {len(orc)} with oracle")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
