"""Run registered queries next to their SQL: python tests/compare.py [sf_dir] [query ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _key(row):
    return tuple((value is None, str(type(value)), value if value is not None else 0) for value in row)


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    """Columns by name and rows in order, with plain Python values."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(row[i] for i in order) for row in rows), key=_key)


def differences(spark_df, result: duckdb.DuckDBPyConnection) -> str | None:
    """None if both give the same columns and exactly the same rows."""
    ours = canonical(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    theirs = canonical([column[0] for column in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns differ: {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"row counts differ: {len(ours[1])} and {len(theirs[1])}"
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1], strict=True) if a != b or list(map(type, a)) != list(map(type, b))]
    return f"{len(wrong)} of {len(ours[1])} rows differ, first: {wrong[0]}" if wrong else None


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, str(ROOT))
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import session

    spark, connection, oracles, failed = session(), duck(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            result = query(spark, sf_dir)
            if name in oracles:
                verdict = differences(result, connection.execute(oracles[name])) or "same"
            else:
                verdict = f"no SQL, {result.count()} rows"
        except Exception as error:  # report every query, whatever happens to one
            verdict = f"error: {str(error)[:1500]}"
        failed += not verdict.startswith(("same", "no SQL"))
        print(f"{name:26s} {time.time() - started:6.2f}s  {verdict}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
