"""Run queries against their SQL on DuckDB. Usage: check.py <sf> [name ...]"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession
    return (SparkSession.builder.master(f"local[{cpus}]").appName("cadastra")
            .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return v + 0.0
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def compare(got: list[tuple], want: list[tuple]) -> str | None:
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    key = lambda r: tuple((x is None, str(type(x).__name__ in ("int", "float")), x if x is not None else 0) if not isinstance(x, tuple) else (False, "t", str(x)) for x in r)
    a, b = sorted(got, key=lambda r: str(key(r))), sorted(want, key=lambda r: str(key(r)))
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    return None


def run(names, sf_dir):
    import __spark_entry__ as entry
    qs, sql = entry.queries(), entry.oracle_sql()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or qs:
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = sorted(df.columns)
            got = [tuple(canon(r[c]) for c in cols) for r in df.collect()]
            took = time.time() - t
            if name not in sql:
                print(f"{name:44s} rows-only {len(got):7d}  {took:6.1f}s", flush=True)
                continue
            t = time.time()
            cur = con.execute(sql[name])
            desc = [d[0] for d in cur.description]
            if sorted(desc) != cols:
                print(f"{name:44s} COLUMNS {cols} != {sorted(desc)}", flush=True); bad += 1
                continue
            pos = [desc.index(c) for c in cols]
            want = [tuple(canon(r[p]) for p in pos) for r in cur.fetchall()]
            types = {type(x).__name__ for r in want[:50] for x in r if x is not None}
            gtypes = {type(x).__name__ for r in got[:50] for x in r if x is not None}
            err = compare(got, want)
            if not err and types != gtypes:
                err = f"types {gtypes} != {types}"
            print(f"{name:44s} {'FAIL ' + err if err else 'ok'} {len(got):7d}  {took:6.1f}s / {time.time() - t:.1f}s", flush=True)
            bad += bool(err)
        except Exception as ex:  # noqa: BLE001 - a report of every query
            print(f"{name:44s} ERROR {type(ex).__name__}: {str(ex)[:600]}", flush=True)
            bad += 1
    print(f"{bad} bad of {len(names or qs)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if run(sys.argv[2:], f"/root/testdata/sf{sys.argv[1]}") else 0)
