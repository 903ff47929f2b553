"""Run registered queries next to their SQL and report differences.

usage: python check_queries.py [sf_dir] [query ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

from twinframe.session import build_session
from workloads.pairs import TABLES
from workloads.queries import ORACLES, QUERIES


def plain_value(value: object) -> str:
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain_value(r[i]) for i in order) for r in rows)


def compare(spark, connection, sf_dir: str, name: str) -> tuple[str, float, float]:
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_seconds = time.time() - started
    if name not in ORACLES:
        return f"rows only ({len(got)})", spark_seconds, 0.0
    started = time.time()
    cursor = connection.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    wanted = rows_of(names, cursor.fetchall())
    sql_seconds = time.time() - started
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", spark_seconds, sql_seconds
    if got == wanted:
        return f"ok ({len(got)})", spark_seconds, sql_seconds
    extra, lost = [r for r in got if r not in set(wanted)], [r for r in wanted if r not in set(got)]
    return (
        f"DIFFERS {len(got)} vs {len(wanted)} rows\n   spark only: {extra[:3]}\n   sql only:   {lost[:3]}",
        spark_seconds,
        sql_seconds,
    )


def open_views(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    chosen = argv[1:] or list(QUERIES)
    spark = build_session(
        master="local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = open_views(sf_dir)
    bad = 0
    for name in chosen:
        try:
            verdict, spark_seconds, sql_seconds = compare(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            verdict, spark_seconds, sql_seconds = f"ERROR {type(error).__name__}: {str(error)[:1500]}", 0.0, 0.0
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:32s} {spark_seconds:6.2f}s {sql_seconds:6.2f}s  {verdict}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
