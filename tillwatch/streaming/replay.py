"""Run a stream to the end of what is there and read back what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.session import ROCKSDB, shared_folder


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Everything the stream emits over the input at hand, with the batch number as ``batch``.

    Each micro-batch is written to a place of its own, so a repeated batch replaces itself.
    """
    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")


def fed(rows: DataFrame, folder: str, order: Column, steps: int = 3) -> Iterator[str]:
    """Write the rows to a source folder in ``steps`` parts of about equal size in the order of a timestamp; yields after each.

    Every part is written by Spark as it is partitioned; rows of one moment are in one part.
    """
    source = f"{folder}/in"
    rows.withColumn("__order", F.unix_micros(order)).write.parquet(f"{folder}/all")
    ordered = rows.sparkSession.read.parquet(f"{folder}/all")
    cuts = ordered.agg(F.percentile_approx("__order", [k / steps for k in range(1, steps)])).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds, bounds[1:]):
        part = ordered
        if low is not None:
            part = part.where(F.col("__order") > low)
        if high is not None:
            part = part.where(F.col("__order") <= high)
        part.drop("__order").write.mode("append").parquet(source)
        yield source


def replayed(rows: DataFrame, build: Callable[[DataFrame], DataFrame], mode: str = "append", order: Column | None = None, steps: int = 3) -> DataFrame:
    """``build`` applied to the rows as a stream of files.

    With ``order`` (a timestamp) the rows arrive in that order in several parts. The stream is stopped and started again from its
    checkpoint between them, so state and watermark carry over; without, all rows arrive at once.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark)
    if order is None:
        rows.write.parquet(f"{folder}/in")
    for source in [f"{folder}/in"] if order is None else fed(rows, folder, order, steps):
        out = drained(build(spark.readStream.schema(rows.schema).parquet(source)), folder, mode)
    return out


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of an update-mode result the last state of each key."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("row"))
    return picked.select(*keys, *[F.col(f"row.{c}").alias(c) for c in others]).drop("batch")
