"""Run registered queries against their oracle SQL in DuckDB and compare values.

    python -m tests.compare [name-part ...]     (BENCH_SF_DIR picks the data)
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
import sys
import time

import duckdb


def canonical(value):
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, decimal.Decimal):
        return format(value.normalize(), "f")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf_dir, run, sql):
    """(problem or None, row count, seconds of the Spark run)."""
    began = time.time()
    df = run(spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    if sql is None:
        return None, len(got), took
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want_columns, want = rows_of(columns, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}", len(got), took
    if len(got) != len(want):
        extra = sorted(set(got) - set(want))[:2]
        lack = sorted(set(want) - set(got))[:2]
        return f"{len(got)} rows, wanted {len(want)}; only here {extra}; only there {lack}", len(got), took
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"values differ: {g} != {w}", len(got), took
    return None, len(got), took


def main(parts):
    import __spark_entry__ as contract
    from tests.sessions import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    con = duck(sf_dir)
    oracle = contract.oracle_sql()
    failed = 0
    for name, run in contract.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            problem, n, took = compare(spark, con, sf_dir, run, oracle.get(name))
        except Exception as failure:  # noqa: BLE001 - listed and counted
            text = str(failure)
            problem, n, took = text[:1500], 0, 0.0
        failed += problem is not None
        state = "ok  " if problem is None else "FAIL"
        note = "" if oracle.get(name) else " (no oracle)"
        print(f"{state} {name:34s} {n:8d} rows {took:6.2f}s{note} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
