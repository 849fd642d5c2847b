"""Run registered queries next to their SQL twins and compare the rows.

`python tests/compare.py [sf_dir] [name ...]`
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value)) + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(spark, con, sf_dir: str, name: str, query, sql: str) -> str | None:
    """None when both sides agree, otherwise a short description."""
    df = query(spark, sf_dir)
    got = df.collect()
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    expected = want.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}"
    a, b = _rows(df.columns, [tuple(r) for r in got]), _rows(columns, expected)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}" if bad else None


def main() -> None:
    from checks import QUERIES, SQL
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in SQL:
                problem = differences(spark, con, sf_dir, name, QUERIES[name], SQL[name])
            else:
                rows = QUERIES[name](spark, sf_dir).count()
                problem = None if rows else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} passed")


if __name__ == "__main__":
    main()
