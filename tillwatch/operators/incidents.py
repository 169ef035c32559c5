"""From bursts to incidents, and from incidents back to the failures inside them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions.timegrid import ENTITY, bucket_index, bucket_start, scoped_bank
from tillwatch.operators.detectors import poisson_surprise
from tillwatch.operators.series import bucket_counts
from tillwatch.sources.failures import with_entity

Detector = Callable[..., DataFrame]


def incident_buckets(scored: DataFrame, keys: Sequence[str] = ENTITY, max_gap: int = K.MAX_GAP_BUCKETS) -> DataFrame:
    """Non-empty buckets that belong to an incident, numbered per entity.

    Two bursts share an incident when at most ``max_gap`` buckets lie between them; a quiet
    bucket belongs to it only when bursts on both sides are that close. All frames are bounded
    by the gap or running, and share one sort per entity.
    """
    order = W.partitionBy(*keys).orderBy("idx")
    burst_at = F.when(F.col("is_burst"), F.col("idx"))
    near = scored.select(
        "*",
        F.max(burst_at).over(order.rangeBetween(-(max_gap + 1), -1)).alias("_prev"),
        (F.min(burst_at).over(order.rangeBetween(1, max_gap)) if max_gap else F.lit(None).cast("long")).alias("_next"),
    )
    opens = (F.col("is_burst") & F.col("_prev").isNull()).cast("int")
    numbered = near.withColumn("incident_no", F.sum(opens).over(order.rowsBetween(W.unboundedPreceding, 0)))
    inside = F.col("is_burst") | (F.col("_next") - F.col("_prev") <= max_gap + 1)
    return numbered.filter(inside).drop("_prev", "_next", "origin")


def summarise_incidents(
    buckets: DataFrame, detector: str | None, keys: Sequence[str] = ENTITY, width_seconds: int = K.BUCKET_SECONDS
) -> DataFrame:
    """One row per incident; the end is exclusive and bridged buckets count.

    Pass no name when ``detector`` is already one of the keys.
    """
    named = [] if detector is None else [F.lit(detector).alias("detector")]
    spans = buckets.groupBy(*keys, "incident_no").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"),
        F.sum("n").alias("total_count"), F.max("score").alias("peak_score"),
    )
    return spans.select(
        *keys, *named, "incident_no",
        bucket_start(F.col("first_idx"), width_seconds).alias("start"),
        bucket_start(F.col("last_idx") + 1, width_seconds).alias("end"),
        (F.col("last_idx") - F.col("first_idx") + 1).alias("n_buckets"), "total_count", "peak_score",
    )


def detect_incidents(
    failures: DataFrame, detector: Detector = poisson_surprise, keys: Sequence[str] = ENTITY,
    grid_keys: Sequence[str] = (), max_gap: int = K.MAX_GAP_BUCKETS,
    width_seconds: int = K.BUCKET_SECONDS, **options: object,
) -> DataFrame:
    """Counts, detection, islands and summary in one lazy plan."""
    all_keys = [*grid_keys, *keys]
    counts = bucket_counts(failures, keys, grid_keys, width_seconds)
    scored = detector(counts, keys=all_keys, **options)
    return summarise_incidents(incident_buckets(scored, all_keys, max_gap), detector.__name__, all_keys, width_seconds)


def member_buckets(
    failures: DataFrame, detector: Detector = poisson_surprise, keys: Sequence[str] = ENTITY,
    grid_keys: Sequence[str] = (), max_gap: int = K.MAX_GAP_BUCKETS,
    width_seconds: int = K.BUCKET_SECONDS, **options: object,
) -> DataFrame:
    """``(keys, idx, incident_no)`` of every non-empty bucket inside an incident."""
    all_keys = [*grid_keys, *keys]
    scored = detector(bucket_counts(failures, keys, grid_keys, width_seconds), keys=all_keys, **options)
    return incident_buckets(scored, all_keys, max_gap).select(*all_keys, "idx", "incident_no")


def flag_members(
    failures: DataFrame, members: DataFrame, keys: Sequence[str] = ENTITY, width_seconds: int = K.BUCKET_SECONDS
) -> DataFrame:
    """Add ``in_active_incident`` (and ``incident_no``) by an equi join on entity and bucket.

    The member table has at most one row per entity and bucket. Spark broadcasts it when its
    measured size allows; otherwise the join shuffles on entity and bucket, and AQE splits a
    bucket that holds too many failures.
    """
    keyed = failures.select(
        "*", bucket_index(F.col("created_at"), width_seconds).alias("_idx"),
        scoped_bank(F.col("method"), F.col("bank")).alias("_bank"),
    )
    right = members.select(
        *[F.col(key).alias(f"m_{key}") for key in keys], F.col("idx").alias("m_idx"), "incident_no"
    )
    condition = F.col("_idx") == F.col("m_idx")
    for key in keys:
        condition = condition & F.col("_bank" if key == "bank" else key).eqNullSafe(F.col(f"m_{key}"))
    return keyed.join(right, condition, "left").select(
        *failures.columns, F.col("incident_no").isNotNull().alias("in_active_incident"), "incident_no",
    )


def flag_active_incidents(failures: DataFrame) -> DataFrame:
    """Mark failures inside a Poisson-detected incident of their (method, bank)."""
    return flag_members(failures, member_buckets(failures))


def union_of_members(*members: DataFrame) -> DataFrame:
    """Buckets that any of several detections covers, once each."""
    first, *rest = [m.drop("incident_no") for m in members]
    for other in rest:
        first = first.unionByName(other)
    return first.distinct()


def incident_reason_mix(failures: DataFrame, members: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Reason counts inside each incident."""
    inside = flag_members(failures, members, keys).filter("in_active_incident")
    return with_entity(inside).groupBy(*keys, "incident_no", "error_reason").agg(F.count("*").alias("n"))


__all__ = [
    "detect_incidents", "flag_active_incidents", "flag_members", "incident_buckets",
    "incident_reason_mix", "member_buckets", "summarise_incidents", "union_of_members",
]
