"""Runs the queries on Spark and their SQL on DuckDB and compares names, types and rows.

    python tests/oracle_check.py FOLDER [QUERY ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def sort_key(row):
    return tuple((value is not None, str(value)) for value in row)


def differences(spark, connection, folder: str, name: str) -> list[str]:
    """What differs between the two results of a query; nothing when they are equal."""
    df = queries()[name](spark, folder)
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*columns).collect()), key=sort_key)
    described = connection.execute(f"DESCRIBE {oracle_sql()[name]}").fetchall()
    kinds = {column[0]: column[1] for column in described}
    if sorted(kinds) != columns:
        return [f"columns {columns} and {sorted(kinds)}"]
    types = {c: TYPES.get(t, t) for c, t in df.dtypes}
    found = [f"type of {c}: {types[c]} and {kinds[c]}" for c in columns if types[c] != kinds[c]]
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = sorted(connection.execute(f"SELECT {quoted} FROM ({oracle_sql()[name]})").fetchall(), key=sort_key)
    if len(rows) != len(expected):
        found.append(f"{len(rows)} and {len(expected)} rows")
    wrong = [(a, b) for a, b in zip(rows, expected) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, such as {wrong[0]}")
    return found if rows else ["no rows"]


def main(folder: str, names: list[str]) -> int:
    from eventdocs.session import local_session

    spark, connection, failed = local_session("8"), duck(folder), 0
    for name in names or queries():
        start = time.time()
        found = differences(spark, connection, folder, name)
        failed += bool(found)
        print(f"{name:22} {time.time() - start:6.2f}s  {found or 'equal'}"[:1500], flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
