"""Failure counts per entity and time bucket.

The working form is sparse: one row per entity and non-empty bucket. The detectors read the
empty buckets off the grid arithmetic, so the dense form (``dense_series``) is only built when
a caller wants it as a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions.timegrid import ENTITY, bucket_index, bucket_start
from tillwatch.sources.failures import with_entity


def bucket_counts(
    failures: DataFrame,
    keys: Sequence[str] = ENTITY,
    grid_keys: Sequence[str] = (),
    width_seconds: int = K.BUCKET_SECONDS,
) -> DataFrame:
    """Sparse series ``(grid keys, keys, idx, n, origin)``.

    ``idx`` counts buckets from the epoch and ``origin`` is the first bucket of the grid: the
    whole input, or each value of ``grid_keys`` (for example one grid per split). Counting
    combines map-side, so a hot entity costs one row per task and bucket in the shuffle.
    """
    counts = (
        with_entity(failures)
        .groupBy(*grid_keys, *keys, bucket_index(F.col("created_at"), width_seconds).alias("idx"))
        .agg(F.count("*").alias("n"))
    )
    return with_origin(counts, grid_keys)


def with_origin(counts: DataFrame, grid_keys: Sequence[str] = ()) -> DataFrame:
    """Attach the first bucket of the grid to counts per bucket."""
    if not grid_keys:
        origin = counts.agg(F.min("idx").alias("origin")).scalar()
        return counts.withColumn("origin", origin)
    origins = counts.groupBy(*grid_keys).agg(F.min("idx").alias("origin"))
    return counts.join(origins, list(grid_keys))


def dense_series(counts: DataFrame, keys: Sequence[str] = ENTITY, width_seconds: int = K.BUCKET_SECONDS) -> DataFrame:
    """Zero-filled series on one grid from the first to the last bucket of any entity.

    Every row of the sparse series fills the gap behind it, so the grid is generated where the
    entity's rows already are and nothing is joined.
    """
    last = counts.agg(F.max("idx").alias("last")).scalar()
    by_entity = W.partitionBy(*keys).orderBy("idx")
    marked = counts.select(
        *keys, "idx", "n", "origin",
        F.lag("idx").over(by_entity).alias("before"), F.lead("idx").over(by_entity).alias("after"),
    ).withColumn("last", last)
    start = F.when(F.col("before").isNull(), F.col("origin")).otherwise(F.col("idx"))
    end = F.coalesce(F.col("after") - 1, F.col("last"))
    return (
        marked.select(*keys, "n", "origin", F.col("idx").alias("own"), F.explode(F.sequence(start, end)).alias("idx"))
        .select(
            *keys, "idx", bucket_start(F.col("idx"), width_seconds).alias("bucket_start"),
            F.when(F.col("idx") == F.col("own"), F.col("n")).otherwise(F.lit(0)).alias("n"), "origin",
        )
    )


def reason_histogram(failures: DataFrame, keys: Sequence[str] = ENTITY, width_seconds: int = K.BUCKET_SECONDS) -> DataFrame:
    """Per entity and non-empty bucket the reasons with their counts, as a map."""
    per_reason = (
        with_entity(failures)
        .groupBy(*keys, bucket_index(F.col("created_at"), width_seconds).alias("idx"), "error_reason")
        .agg(F.count("*").alias("n"))
    )
    return (
        per_reason.groupBy(*keys, "idx")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_reason", "n")))).alias("reason_counts"))
        .withColumn("bucket_start", bucket_start(F.col("idx"), width_seconds))
    )
