"""Runs a query on Spark and its SQL on DuckDB and compares the two row sets.

``python -m tests.oracle SF [NAME_PREFIX ...]`` checks the named queries and prints one line each.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


TIMES: dict[str, float] = {}


def connect(sf_dir: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for parquet in sorted(sf_dir.glob("*.parquet")):
        con.execute(f"CREATE VIEW {parquet.stem} AS SELECT * FROM read_parquet('{parquet}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(cell(row[i]) for i in order) for row in rows), key=repr
    )


def cell(value):
    if isinstance(value, float):
        return repr(0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(cell(v)) for v in value) + "]"
    return str(value) if value is not None else None


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, str(sf_dir))
    start = time.time()
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    TIMES["spark"] = time.time() - start
    if sql is None:
        return len(got[1]), None
    start = time.time()
    rel = con.execute(sql)
    want = canonical([d[0] for d in rel.description], rel.fetchall())
    TIMES["duckdb"] = time.time() - start
    if got[0] != want[0]:
        return len(got[1]), f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        lacking = [r for r in want[1] if r not in set(got[1])][:2]
        return len(got[1]), f"rows {len(got[1])} vs {len(want[1])}\n   spark {extra}\n   duckdb {lacking}"
    return len(got[1]), None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from fleetledger.session import local_session

    sf_dir = TESTDATA / f"sf{argv[0]}"
    spark, con, sqls, bad = local_session(), connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        TIMES.update(spark=0.0, duckdb=0.0)
        try:
            rows, problem = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on to the next query
            rows, problem = 0, f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:34s} rows={rows} spark {TIMES['spark']:.1f}s duckdb {TIMES['duckdb']:.1f}s{' (rows only)' if name not in sqls else ''}", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
