"""Deterministic recovery draw and the recovery probability model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.session import inline_table


def unit_draw(payment_id: Column, salt: str = K.DRAW_SALT) -> Column:
    """A stable number in [0, 1): the first 64 bits of SHA-256 over salt and id, over 2^64."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), payment_id), 256)
    top = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return top / F.lit(float(2**64))


def recovery_probability(remediation_class: str, action: str, level: str) -> float:
    """Modelled chance that the order recovers after the action, clamped to [0, 1]."""
    uplift, floor_scale = K.UPLIFT_MULTIPLIER[level], K.FLOOR_MULTIPLIER[level]
    floor, ceiling = K.SELF_RECOVERY[remediation_class], K.ACTION_CEILING[remediation_class]
    if action == "reconcile":
        return 0.0
    if action == "wait_bank_recovery":
        value = K.GENERIC_FLOOR * floor_scale + (K.INCIDENT_RATE - K.GENERIC_FLOOR) * uplift
    elif action == "no_action":
        value = floor * floor_scale
    else:
        fit = K.NATIVE_FIT if K.BASE_ACTION_BY_CLASS[remediation_class] == action else K.OTHER_FIT
        value = floor * floor_scale + fit * (ceiling - floor) * uplift
    return min(1.0, max(0.0, value))


def probability_table(spark: SparkSession) -> DataFrame:
    """All (level, class, action) probabilities: 210 rows, whatever the data size."""
    rows = [
        (level, cls, action, recovery_probability(cls, action, level))
        for level in K.LEVELS for cls in K.REMEDIATION_CLASSES for action in K.ACTIONS
    ]
    return inline_table(spark, ["level", "remediation_class", "action", "probability"], rows)


def score_recovery(decisions: DataFrame, level: str = "central", salt: str = K.DRAW_SALT) -> DataFrame:
    """Add ``draw``, ``probability`` and ``recovered`` for the final action."""
    table = probability_table(decisions.sparkSession).filter(F.col("level") == level).select(
        "remediation_class", F.col("action").alias("final_action"), "probability"
    )
    scored = decisions.join(F.broadcast(table), ["remediation_class", "final_action"], "left")
    draw = unit_draw(F.col("payment_id"), salt)
    unknown = F.raise_error(F.concat(F.lit("no recovery model for class "), F.col("remediation_class")))
    return scored.withColumn("draw", draw).withColumn(
        "probability", F.coalesce("probability", unknown.cast("double"))
    ).withColumn("recovered", F.col("draw") < F.col("probability"))


def self_recovery_rates(spark: SparkSession) -> DataFrame:
    return probability_table(spark).filter(F.col("action") == "no_action").drop("action")
