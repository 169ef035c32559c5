"""Run a registered query next to its SQL and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(value: object) -> object:
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def differences(spark, con, sf_dir: str, query, sql: str) -> list[str]:
    ours = query(spark, sf_dir)
    left = rows_of(ours.columns, [tuple(r) for r in ours.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    right = rows_of(names, cursor.fetchall())
    found = []
    if sorted(ours.columns) != sorted(names):
        found.append(f"columns {sorted(ours.columns)} != {sorted(names)}")
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    found += [f"{a} != {b}" for a, b in zip(left, right) if a != b][:3]
    return found
