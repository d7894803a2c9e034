"""Compare registered queries with their SQL: python -m tests.check [sf] [name ...]"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    out.sort(key=repr)
    return [columns[i] for i in order], out


def compare(df, con, sql: str) -> tuple[str | None, int]:
    """None and the row count if equal, else what differs."""
    columns, rows = table(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want_columns, want = table(names, result.fetchall())
    if columns != want_columns:
        return f"columns {columns} != {want_columns}", len(rows)
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}", len(rows)
    kinds = [{type(v) for v in col if v is not None} for col in zip(*rows)] if rows else []
    want_kinds = [{type(v) for v in col if v is not None} for col in zip(*want)] if want else []
    if kinds != want_kinds:
        return f"types {list(zip(columns, kinds, want_kinds))}", len(rows)
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, e.g. {columns}\n  {bad[0][0]}\n  {bad[0][1]}", len(rows)
    return None, len(rows)


def main(sf: str = "0.01", *names: str) -> int:
    from tidemark import get_session
    from tidemark.plans.registry import all_queries, all_sql

    spark = get_session("check", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, sql = all_queries(), all_sql()
    failed = 0
    for name in names or queries:
        begin = time.time()
        try:
            if name in sql:
                problem, n = compare(queries[name](spark, sf_dir), con, sql[name])
            else:
                n = len(queries[name](spark, sf_dir).collect())
                problem = None if n else "no rows"
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:900]}", -1
        kind = "E" if name in sql else "R"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name:30s} rows={n:<7d} {time.time() - begin:6.2f}s", problem or "", flush=True)
        failed += problem is not None
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) > 0)
