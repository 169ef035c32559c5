"""Deduplication of at-least-once deliveries over a finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions.timegrid import micros
from tillwatch.operators.spacing import HOT_ROWS, select_spaced


def first_deliveries(
    deliveries: DataFrame, ttl_seconds: int = K.DEDUP_TTL_SECONDS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Deliveries ``(event_id, received_at, delivery_id)`` that are not repeats.

    A sighting counts as new once the time to live since the last *kept* one is over; repeats
    in between do not extend it, so comparing neighbours would be wrong.
    """
    rows = deliveries.select(
        "event_id", micros(F.col("received_at")).alias("us"), F.col("delivery_id").alias("id")
    )
    kept = select_spaced(rows, ["event_id"], [(1, ttl_seconds * 1_000_000)], hot_rows=hot_rows)
    return kept.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("received_at"), F.col("id").alias("delivery_id"))
