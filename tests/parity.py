"""Compare registered queries with their SQL twins: python tests/parity.py [names...]."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "None" if math.isnan(value) else f"{value:.6f}".rstrip("0").rstrip(".")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def spark_rows(df):
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    return cols, sorted(tuple(canon(v) for v in r) for r in rows)


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rel.fetchall())


def compare(con, df, sql) -> str:
    """'' when equal, else a short description of the first difference."""
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    if sc != dc:
        return f"columns {sc} != {dc}"
    if sr != dr:
        a, b = set(sr), set(dr)
        only_a, only_b = sorted(a - b)[:2], sorted(b - a)[:2]
        return f"rows {len(sr)} vs {len(dr)}; spark-only {only_a}; sql-only {only_b}; cols {sc}"
    return "" if sr else "EMPTY"


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def main(names: list[str]) -> int:
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                msg = compare(con, df, oracles[name])
            else:
                n = df.count()
                msg = "" if n else "EMPTY"
        except Exception as exc:  # report and go on with the next query
            msg = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(msg)
        print(f"{'ok ' if not msg else 'BAD'} {name} {time.time() - t:.1f}s {msg}"[:2500], flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
