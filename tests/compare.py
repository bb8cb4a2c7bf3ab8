"""Run registered queries beside their SQL oracles and compare the results.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(value: object) -> object:
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns sorted by name, rows sorted as text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    named = [columns[i] for i in order]
    return named, sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def oracle(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple], list[str]]:
    done = con.execute(sql)
    columns = [d[0] for d in done.description]
    return columns, done.fetchall(), [str(d[1]) for d in done.description]


def difference(ours: tuple, theirs: tuple) -> str | None:
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} vs {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} vs {len(theirs[1])}"
    for a, b in zip(ours[1], theirs[1], strict=True):
        if a != b:
            return f"row {a} vs {b}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tabulary.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    sqls = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            df = run(spark, args.sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in sqls:
                print(f"rows {name}: {len(rows)} {took:.2f}s", flush=True)
                continue
            columns, expected, types = oracle(con, sqls[name])
            problem = difference(canonical(df.columns, rows), canonical(columns, expected))
            if problem is None:
                print(f"ok   {name}: {len(rows)} rows {took:.2f}s", flush=True)
            else:
                failed += 1
                print(f"DIFF {name}: {problem[:600]}", flush=True)
                print("     ", df.dtypes, types, flush=True)
        except Exception as error:  # noqa: BLE001  (report and go on)
            failed += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:500]}", flush=True)
            print("     ", traceback.format_exc().strip().splitlines()[-4:][:2], flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
