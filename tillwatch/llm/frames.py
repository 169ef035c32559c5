"""Tables written to the shared folder, and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.session import shared_folder

__all__ = ["ascii_lower", "null_safe", "shared_folder", "shuffle_partitions", "stored"]

#: What separates words in every contract of this package: blank and the controls 09 to 0D.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write a table once and go on from its files: lineage is cut and a lost executor loses nothing."""
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where a null equals a null; the right side's keys are left out of the result."""
    renamed = right.select([F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for key in keys:
        same = left[key].eqNullSafe(renamed[f"__{key}"])
        condition = same if condition is None else condition & same
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])
