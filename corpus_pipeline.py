"""documents to a training mix in five stages, each written to shared storage and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm.decontamination import contaminated
from tillwatch.llm.frames import null_safe, shared_folder, stored
from tillwatch.llm.language import identify_languages
from tillwatch.llm.lines import dedup_lines
from tillwatch.llm.minhash import near_duplicates
from tillwatch.llm.mixing import mix_by_source


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows that gone names by doc_id and text_hash."""
    keyed = docs.withColumn("__text_hash", F.xxhash64("text"))
    names = gone.select("doc_id", F.col("text_hash").alias("__text_hash")).distinct()
    return null_safe(keyed, names, ["doc_id", "__text_hash"], "left_anti").drop("__text_hash")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters, and those unlike all languages learned, go."""
    return _without(docs, identify_languages(docs).where("NOT accepted"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; the document stays with the rest of its text."""
    kept = dedup_lines(docs).drop("__n_lines", "__n_dropped")
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows repeated under one id are one document."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their copies, size, source_size, target and taken words."""
    mix = mix_by_source(docs).where("copies > 0").select("doc_id", "text_hash", "copies", "size", "source_size", "target", "taken").distinct()
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    clashing = [c for c in mix.columns if c in docs.columns and c != "doc_id"]
    keyed = keyed.select(*[F.col(c).alias(f"__own_{c}") if c in clashing and c != "text_hash" else F.col(c) for c in keyed.columns])
    return null_safe(keyed, mix, ["doc_id", "text_hash"]).drop("text_hash")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Components of near duplicates and the mix are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
