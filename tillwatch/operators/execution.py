"""Dry-run execution records and idempotent outbound work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions import outbound
from tillwatch.functions.policy import is_chase


def outbound_requests(decisions: DataFrame, prefix: str = K.REFERENCE_PREFIX) -> DataFrame:
    """One request per decision that contacts the customer."""
    return decisions.filter(is_chase(F.col("final_action"))).select(
        "payment_id", outbound.reference_id(F.col("payment_id"), prefix).alias("reference_id"),
        outbound.wire_request(prefix).alias("request"),
        outbound.restriction_note(F.col("disallowed_method")).alias("note"),
    )


def split_replays(requests: DataFrame, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests still to send, and those whose key was sent before."""
    keys = sent.select("reference_id")
    return requests.join(keys, "reference_id", "left_anti"), requests.join(keys, "reference_id", "left_semi")


def execution_records(decisions: DataFrame, prefix: str = K.REFERENCE_PREFIX) -> DataFrame:
    """Dry-run record per decision in struct ``execution``; nothing leaves the cluster.

    Fields are declared alphabetically, which is the order of the canonical JSON.
    """
    chase = is_chase(F.col("final_action"))
    nothing = F.lit(None).cast("string")
    record = F.struct(
        F.col("final_action").alias("action"), F.lit(True).alias("dry_run"), nothing.alias("error_detail"),
        nothing.alias("error_message"), F.lit(None).cast("int").alias("http_status"),
        F.lit(False).alias("idempotent_replay"), F.lit(None).cast("double").alias("latency_ms"),
        F.when(chase, outbound.restriction_note(F.col("disallowed_method")))
        .otherwise(F.concat(F.lit("no outbound call for "), F.col("final_action"))).alias("note"),
        F.when(chase, "dry_run").otherwise("no_op").alias("outcome"), nothing.alias("payment_link_id"),
        F.when(chase, outbound.reference_id(F.col("payment_id"), prefix)).alias("reference_id"),
        F.when(chase, outbound.wire_request(prefix)).alias("request"),
        F.create_map().cast("map<string,string>").alias("request_headers"), nothing.alias("response"),
        F.lit(0).alias("retry_count"), nothing.alias("short_url"),
    )
    return decisions.withColumn("execution", record)


def outcome_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(F.col("execution.outcome").alias("outcome")).agg(F.count("*").alias("n"))


def reference_id_check(failures: DataFrame, prefix: str = K.REFERENCE_PREFIX, exact: bool = True) -> DataFrame:
    """Are the keys of all failures distinct and short enough? ``exact=False`` estimates.

    The exact count groups by key first, so distinct keys are counted on all tasks.
    """
    keys = failures.select(outbound.reference_id(F.col("payment_id"), prefix).alias("key"))
    if not exact:
        return keys.agg(
            F.count("*").alias("n_events"), F.approx_count_distinct("key", 0.01).alias("n_unique"),
            F.max(F.length("key")).alias("max_length"),
        )
    return keys.groupBy("key").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"), F.count("*").alias("n_unique"),
        (F.coalesce(F.max("n"), F.lit(1)) == 1).alias("collision_free"),
        F.coalesce(F.max(F.length("key")), F.lit(0)).alias("max_length"),
    )
