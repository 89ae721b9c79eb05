"""Run registered queries on Spark and their checks on DuckDB, and compare all rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tideline.queries.registry import BASE_TABLES  # noqa: E402

FOLDER = os.environ.get("TIDELINE_TESTDATA", "/root/testdata/sf0.001")


def open_oracle(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9)
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark_df, connection, sql):
    """None when equal, otherwise what differs."""
    got_columns, got = spark_df.columns, [tuple(r) for r in spark_df.collect()]
    cursor = connection.execute(sql)
    want_columns, want = [d[0] for d in cursor.description], cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} against {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    a, b = sorted_rows(got_columns, got), sorted_rows(want_columns, want)
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return f"{sorted(got_columns)}\n  spark {x}\n  check {y}"
    return None


def main(names):
    import __spark_entry__ as contract
    from tideline.session import build_session

    spark = build_session("compare", "local[8]", 8, {"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = open_oracle(FOLDER)
    queries, checks = contract.queries(), contract.oracle_sql()
    chosen = [n for n in queries if not names or n in names or any(n.startswith(p[:-1]) for p in names if p.endswith("*"))]
    bad = []
    for name in chosen:
        started = time.time()
        try:
            df = queries[name](spark, FOLDER)
            if name in checks:
                problem = compare(df, connection, checks[name])
                rows = "="
            else:
                rows, problem = df.count(), None
        except Exception as error:
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", "?"
        print(f"{'ok ' if problem is None else 'BAD'} {name} {rows} {time.time() - started:.1f}s", flush=True)
        if problem:
            bad.append(name)
            print(f"   {problem}", flush=True)
    print(f"{len(chosen)} queries, {len(bad)} bad: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
