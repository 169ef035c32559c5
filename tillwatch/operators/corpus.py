"""Labels and mixes over a failure table: outliers, splits, reason pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions.literals import lookup
from tillwatch.session import inline_table
from tillwatch.sources.dimensions import default_reasons, first_row_per_reason
from tillwatch.sources.failures import first_sentence, hash_percent, method_clause


def outlier_keys(failures: DataFrame, max_count: int = K.OUTLIER_MAX_COUNT) -> DataFrame:
    """(method, reason) pairs seen at most ``max_count`` times among background failures that
    are not catch-all."""
    eligible = failures.filter(
        F.col("downtime_window_id").isNull() & ~F.col("error_reason").isin(K.CATCH_ALL_REASONS)
    )
    return eligible.groupBy("method", "error_reason").agg(F.count("*").alias("n")).filter(F.col("n") <= max_count)


def tag_outliers(failures: DataFrame, max_count: int = K.OUTLIER_MAX_COUNT) -> DataFrame:
    """Set ``is_outlier`` by the rare pairs; outage failures with such a pair inherit the flag.
    """
    keys = outlier_keys(failures, max_count).select("method", "error_reason", F.lit(True).alias("_rare"))
    joined = failures.join(keys, ["method", "error_reason"], "left")
    flagged = joined.withColumn("is_outlier", F.coalesce("_rare", F.lit(False)))
    return flagged.select(*[c for c in failures.columns if c != "is_outlier"], "is_outlier")


def assign_split(failures: DataFrame, test_fraction: float = K.TEST_FRACTION) -> DataFrame:
    """Leak-free split: an outage window moves as a whole, background failures one by one."""
    key = F.coalesce("downtime_window_id", "payment_id")
    value = F.when(hash_percent(key) < int(round(100 * test_fraction)), "test").otherwise("train")
    return failures.withColumn("split", value)


def reason_pools(spark: SparkSession, reasons: DataFrame | None = None) -> DataFrame:
    """Per method its own reasons first, then the generic ones in dimension order, with rank
    and Zipf weight."""
    specific = inline_table(
        spark, ["method", "reason", "position"],
        [(m, r, i) for m, bucket in K.REASON_BUCKET_BY_METHOD.items() for i, r in enumerate(K.METHOD_REASONS[bucket])],
    )
    distinct = first_row_per_reason(default_reasons(spark) if reasons is None else reasons)
    explicit = specific.select("reason").distinct()
    methods = F.array(*[F.lit(m) for m in K.METHODS])
    generic = distinct.join(explicit, "reason", "left_anti").select(
        F.explode(methods).alias("method"), "reason", (F.col("row_index") + 1000).alias("position")
    )
    order = W.partitionBy("method").orderBy("position")
    ranked = specific.unionByName(generic).select("method", "reason", F.row_number().over(order).alias("rank"))
    return zipf_weights(ranked)


def zipf_weights(ranked: DataFrame, exponent: float = K.ZIPF_EXPONENT) -> DataFrame:
    raw = F.pow(F.col("rank").cast("double"), F.lit(-exponent))
    return ranked.withColumn("weight", raw / F.sum(raw).over(W.partitionBy("method")))


def opaque_description(failures: DataFrame, explanations: dict[str, str]) -> Column:
    """Replace a catch-all description by its reason-level sentence and the method clause."""
    plain = first_sentence(lookup(explanations, F.col("error_reason")))
    masked = F.concat(plain, method_clause(F.lit("000000000000")))
    return F.when(F.col("error_reason").isin(K.CATCH_ALL_REASONS), masked).otherwise(F.col("description"))
