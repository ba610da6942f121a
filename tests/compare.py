"""Run a registered query and its checking SQL on one data folder and compare them."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from shelfmark.plans.adapters import DRIVER_TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, (float, decimal.Decimal)):
        number = float(value)
        return ("f", "nan" if math.isnan(number) else f"{number:.9g}")
    if isinstance(value, datetime.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    return ("s", str(value))


def sorted_rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def spark_rows(df):
    return sorted_rows(df.columns, df.collect())


def sql_rows(con, sql: str):
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    return sorted_rows(names, result.fetchall())


def first_difference(left, right) -> str | None:
    """Human-readable first difference of two sorted tables, None where they are equal."""
    if left[0] != right[0]:
        return f"columns differ: {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        only = [row for row in left[1] if row not in set(right[1])][:2]
        missing = [row for row in right[1] if row not in set(left[1])][:2]
        return f"row counts differ: {len(left[1])} / {len(right[1])}; only left {only}; only right {missing}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            cells = [(name, x, y) for name, x, y in zip(left[0], a, b) if x != y]
            return f"rows differ: {cells[:3]} in {dict(zip(left[0], a))}"
    return None
