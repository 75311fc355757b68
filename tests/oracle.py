"""Compare a query with its SQL on one scale, as rows sorted with columns by name."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

import __spark_entry__ as entry
from loomgraph.runtime import session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings kg_pages anchor_nodes edges usage_events usage_windows eval_items mix_targets".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())


def sql_rows(folder: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    cols = sorted(names)
    return cols, Counter(tuple(plain(row[names.index(c)]) for c in cols) for row in cur.fetchall())


def compare(spark, folder: str, name: str) -> str:
    """Empty when equal, else what differs."""
    t0 = time.time()
    got_cols, got = spark_rows(entry.queries()[name](spark, folder))
    took = time.time() - t0
    sql = entry.oracle_sql().get(name)
    if sql is None:
        print(f"{name}: {sum(got.values())} rows in {took:.1f} s, no SQL", flush=True)
        return ""
    cols, want = sql_rows(folder, sql)
    if cols != got_cols:
        return f"columns {got_cols} != {cols}"
    if got != want:
        return f"{sum(got.values())} rows, SQL {sum(want.values())}; only here {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    print(f"{name}: {sum(got.values())} rows equal, {took:.1f} s", flush=True)
    return ""


if __name__ == "__main__":
    sf, names = sys.argv[1], sys.argv[2:]
    s = session()
    s.sparkContext.setLogLevel("ERROR")
    for n in names or entry.queries():
        try:
            if bad := compare(s, f"/root/testdata/sf{sf}", n):
                print(f"{n}: DIFFERS: {bad}"[:1500], flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{n}: FAILED {type(e).__name__} {str(e)[:1500]}", flush=True)
