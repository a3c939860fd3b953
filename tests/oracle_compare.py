"""Runs a query and its SQL on the same tables and compares the rows; also a script: NAME... [SF_DIR]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return bool(v) if type(v).__name__ == "bool_" else v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def both(spark, query, sql: str, sf_dir: str):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)
    cur = duck(sf_dir).execute(sql)
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == names, (sorted(cols), names)
    want = sorted((tuple(norm(r[cols.index(c)]) for c in names) for r in cur.fetchall()), key=repr)
    return names, got, want


def session():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    args = [a for a in sys.argv[1:] if "/" not in a]
    sf = next((a for a in sys.argv[1:] if "/" in a), "/root/testdata/sf0.01")
    spark, q, o = session(), e.queries(), e.oracle_sql()
    bad = []
    for name in args or sorted(q):
        t = time.time()
        try:
            if name in o:
                names, got, want = both(spark, q[name], o[name], sf)
                ok = got == want
                print(name, "OK" if ok else "DIFF", len(got), len(want), f"{time.time() - t:.1f}s", flush=True)
                if not ok:
                    bad.append(name)
                    print(" ", names, [x for x in got if x not in set(want)][:2] if len(got) < 20000 else got[:1], [x for x in want if x not in set(got)][:2] if len(want) < 20000 else want[:1])
            else:
                print(name, "rows", q[name](spark, sf).count(), f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:
            bad.append(name)
            print(name, "ERROR", str(x)[:1500], flush=True)
    print("BAD", bad)
