"""Literal values as SQL text: one parsed expression instead of many column objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value) if isinstance(value, int) else f"{value!r}D"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(sql_literal(item) for item in value) + ")"
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def literal_array(values: Sequence[object]) -> Column:
    return F.expr(sql_literal(list(values)))


def pick(values: Sequence[object], position: Column) -> Column:
    """Element of a literal list, counted from zero."""
    return F.element_at(literal_array(values), position.cast("int") + 1)


def lookup(mapping: dict[str, object], key: Column) -> Column:
    """A literal map lookup, NULL for other keys."""
    names = list(mapping)
    values = [*mapping.values(), None]
    return F.element_at(literal_array(values), F.coalesce(F.nullif(F.array_position(literal_array(names), key), F.lit(0)), F.lit(len(values))).cast("int"))
