"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def stamp(column: str) -> Column:
    """A timestamp as text, so that both engines show the same digits."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column.split(".")[-1])


def rounded(*names: str) -> list[Column]:
    return [F.round(F.col(name).cast("double"), 6).alias(name) for name in names]


def significant(name: str) -> Column:
    """Seven significant digits: a score over a tiny deviation has no six decimals to compare."""
    return F.format_string("%.6e", F.col(name).cast("double")).cast("double").alias(name)


def sql_significant(name: str) -> str:
    return f"printf('%.6e', {name}::DOUBLE)::DOUBLE AS {name}"


def sql_stamp(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def sql_rounded(*names: str) -> str:
    return ", ".join(f"round({name}::DOUBLE, 6) AS {name}" for name in names)
