"""Run registered queries next to their DuckDB twins and compare rows.

    python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def normal(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(repr(v + 0.0))
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(normal(r[i])) for i in order) for r in rows)


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, fn, sql):
    """(ok, message) for one query."""
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"rows-only {len(got)}"
    res = con.sql(sql)
    want = res.fetchall()
    if sorted(df.columns) != sorted(res.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(res.columns)}"
    a, b = rows_of(df.columns, got), rows_of(res.columns, want)
    if a == b:
        kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        types = dict(zip(res.columns, map(str, res.types)))
        off = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t, t) != types[c]]
        return True, f"{len(a)} rows" + (f" TYPES {off}" if off else "")
    sa, sb = set(a), set(b)
    return False, f"{len(a)} vs {len(b)} rows; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}"


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    picks = sys.argv[2:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls, bad = duck(sf), entry.queries(), entry.oracle_sql(), []
    for name, fn in qs.items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, con, sf, fn, sqls.get(name))
        except Exception as e:  # report every query, then fail at the end
            ok, msg = False, f"{type(e).__name__} {str(e)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.2f}s {msg}", flush=True)
        if not ok:
            bad.append(name)
    print("FAILED", bad)
