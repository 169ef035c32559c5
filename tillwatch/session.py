"""Session settings, reliable checkpoints and small literal tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tillwatch.functions.literals import sql_literal


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, for a cluster where the wheel is not installed."""
    here = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tillwatch-')}/tillwatch", "zip", here.parent, here.name)
    spark.sparkContext.addPyFile(archive)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE with skew splitting)."""
    builder = (
        SparkSession.builder.appName("tillwatch")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    return spark if spark.sparkContext.master.startswith("local[") else ship_package(spark)


def pin_utc(spark: SparkSession) -> SparkSession:
    """Bucket edges, quiet hours and day keys all read the wall clock as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local-mode session without that
    setting gets a temporary one: executors of a cluster could not read it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    A local session without that setting (tests) gets one of its own; a cluster must have it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tillwatch-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder; readers scan only the columns they need."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def inline_table(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence[object]]) -> DataFrame:
    """A literal dimension as a local relation: exact statistics, no Python row transfer."""
    values = ", ".join("(" + ", ".join(sql_literal(value) for value in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
