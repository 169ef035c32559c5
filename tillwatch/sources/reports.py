"""Report sink: named summary tables as JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(summaries: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Write each summary below ``path/name`` as JSON lines with nulls kept."""
    for name, table in summaries.items():
        table.write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/{name}")


def as_json_rows(summaries: Mapping[str, DataFrame]) -> DataFrame:
    """All summaries as one table (section, row) with a JSON object per row."""
    result = None
    for name, table in summaries.items():
        part = table.select(
            F.lit(name).alias("section"), F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}).alias("row")
        )
        result = part if result is None else result.unionByName(part)
    return result
