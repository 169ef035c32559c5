"""Audit log on storage: append-only records, and beside them a small index of chain tips.

``records/batch_no=N/chain_day=D`` holds what batch N appended. ``tips/epoch=E/batch_no=N`` holds one file with the last
sequence and hash of each chain that batch N touched; the first batch of an epoch writes the tips of all chains, so the newest
epoch alone tells where to go on, and an append never reads a record that was there before. A batch counts once its tips file is
there, which appears in one step: records without it are not read, and are overwritten when the batch is repeated. There is one
writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tillwatch.operators.audit import SHARDS_PER_DAY, build_chain, chain_tips

#: Batches of an epoch of the tip index.
EPOCH_BATCHES = 16
TIPS = "chain_id string, last_sequence long, last_hash string, batch_id string, epoch int, batch_no int"


def _tips(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        spark.read.parquet(f"{path}/tips")
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return spark.read.schema(TIPS).parquet(f"{path}/tips")


def _newest_tips(tips: DataFrame) -> DataFrame:
    last = tips.groupBy("chain_id").agg(F.max_by(F.struct("last_sequence", "last_hash"), "last_sequence").alias("tip"))
    return last.where("chain_id IS NOT NULL").select("chain_id", "tip.last_sequence", "tip.last_hash")


def current_tips(spark: SparkSession, path: str) -> DataFrame | None:
    """(chain_id, last_sequence, last_hash) of every chain of the log, from the newest epoch of the index."""
    tips = _tips(spark, path)
    if tips is None:
        return None
    return _newest_tips(tips.where(F.col("epoch") == (tips.agg(F.max("epoch")).first()[0] or 0)))


def append_audit(
    rows: DataFrame, path: str, shards_per_day: int = SHARDS_PER_DAY, batch_id: str | None = None,
) -> None:
    """Chain the rows onto the log at ``path`` and append them; new chains start where none is.

    With a ``batch_id`` a batch that the log holds already is not appended again, so a retry changes nothing, whether the
    first attempt failed before, during or after its writes.
    """
    spark = rows.sparkSession
    tips, number, known = _tips(spark, path), 0, None
    if tips is not None:
        if batch_id is not None and not tips.where(F.col("batch_id") == batch_id).isEmpty():
            return
        number = tips.agg(F.max("batch_no")).first()[0] + 1
        known = _newest_tips(tips.where(F.col("epoch") == (number - 1) // EPOCH_BATCHES))
    epoch, records = number // EPOCH_BATCHES, f"{path}/records/batch_no={number}"
    chained = build_chain(rows, shards_per_day, known).withColumn("batch_id", F.lit(batch_id).cast("string"))
    chained.write.mode("overwrite").partitionBy("chain_day").parquet(records)
    written = spark.read.schema(chained.schema).parquet(records)
    new = chain_tips(written)
    if known is not None and number % EPOCH_BATCHES == 0:
        new = _newest_tips(known.unionByName(new))
    mark = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema.fields])
    named = new.unionByName(mark).withColumn("batch_id", F.lit(batch_id).cast("string"))
    named.coalesce(1).write.mode("overwrite").parquet(f"{path}/tips/epoch={epoch}/batch_no={number}")


def append_stream(rows: DataFrame, path: str, checkpoint: str, shards_per_day: int = SHARDS_PER_DAY) -> DataStreamWriter:
    """Append a stream of audit rows, each micro-batch exactly once; a replayed one is recognised by its number."""
    def append(batch: DataFrame, number: int) -> None:
        append_audit(batch, path, shards_per_day, f"{checkpoint}#{number}")

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def read_audit(spark: SparkSession, path: str) -> DataFrame | None:
    """The log, or None before its first append. Order comes from ``sequence``; the day stays text."""
    tips = _tips(spark, path)
    if tips is None:
        return None
    try:
        found = spark.read.parquet(f"{path}/records").schema
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    days = [T.StructField(f.name, T.StringType()) if f.name == "chain_day" else f for f in found.fields]
    whole = tips.agg(F.max("batch_no")).first()[0]
    return spark.read.schema(T.StructType(days)).parquet(f"{path}/records").where(F.col("batch_no") <= whole).drop("batch_no")


def export_audit_json(log: DataFrame, path: str) -> None:
    """Log as JSON lines, one file set per day."""
    log.write.mode("errorifexists").partitionBy("chain_day").json(path)


def read_audit_json(spark: SparkSession, path: str, schema: object) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(path)
