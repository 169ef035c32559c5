"""Aggregates over logs of external answerer calls and review verdicts, and seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch.operators.scoring import ratio


def spend_summary(calls: DataFrame, n_events: DataFrame, n_incidents: DataFrame) -> DataFrame:
    """Cost per kind of call (reason, incident, judge) and its projection to 100,000 events.

    The projection multiplies the mean cost per diagnosed incident by the incidents *detected*.
    ``n_events`` and ``n_incidents`` are one-row, one-column tables.
    """
    def part(kind: str, suffix: str) -> list:
        hit = F.col("kind") == kind
        return [
            F.count_if(hit).alias(f"{suffix}_calls"),
            F.coalesce(F.sum(F.when(hit, F.coalesce("cost", F.lit(0.0)))), F.lit(0.0)).alias(f"{suffix}_cost"),
        ]

    sums = calls.agg(*part("reason", "reason"), *part("incident", "incident"), *part("judge", "judge"))
    sums = sums.withColumn("n_events", n_events.scalar()).withColumn("n_incidents_detected", n_incidents.scalar())
    mean = F.coalesce(ratio(F.col("incident_cost"), F.col("incident_calls")), F.lit(0.0))
    scale = F.coalesce(ratio(F.lit(100_000.0), F.col("n_events")), F.lit(0.0))
    warm = mean * F.col("n_incidents_detected") * scale
    return sums.select(
        "*", (F.col("reason_cost") + F.col("incident_cost") + F.col("judge_cost")).alias("total_spend"),
        (F.col("reason_cost") + warm).alias("per_100k_cold"), warm.alias("per_100k_warm"),
    )


def model_aggregates(calls: DataFrame) -> DataFrame:
    """Per model: errors, cost and quality of its calls; latency counts failed calls too."""
    ok = F.col("error").isNull()
    return calls.groupBy("model").agg(
        F.count("*").alias("n_calls"), F.count_if(~ok).alias("n_errors"), F.count_if(ok).alias("n_successes"),
        F.coalesce(F.sum(F.when(ok, F.col("cost"))), F.lit(0.0)).alias("total_cost"),
        F.avg("latency_seconds").alias("mean_latency_seconds"),
        F.coalesce(F.sum(F.when(ok, F.col("reasoning_tokens"))), F.lit(0)).alias("total_reasoning_tokens"),
        F.avg(F.when(ok, F.col("reasoning_tokens"))).alias("mean_reasoning_tokens"),
        ratio(F.count_if(ok & (F.col("attempts") == 1)), F.count_if(ok)).alias("first_attempt_rate"),
        ratio(F.count_if(ok & F.col("agrees")), F.count_if(ok & F.col("agrees").isNotNull())).alias("agreement_rate"),
    )


def pick_default_model(aggregates: DataFrame) -> DataFrame:
    """Cheapest model without errors; if all err, the fewest errors come first."""
    return aggregates.orderBy("n_errors", "total_cost", "mean_latency_seconds", "model").limit(1)


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """How often the reviewer disagreed, how many cases were plainly wrong, and what it cost."""
    counts = verdicts.agg(
        F.count("*").alias("n_sampled"), F.count_if(~F.col("agrees")).alias("n_disagree"),
        F.count_if(F.col("verdict") == "wrong").alias("n_wrong"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
    )
    return counts.withColumn(
        "disagreement_rate", F.coalesce(ratio(F.col("n_disagree"), F.col("n_sampled")), F.lit(0.0))
    )


def wrong_cases(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("verdict") == "wrong").select("subject_id", "confidence")


def seeded_sample(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows that only depend on seed and keys; a top-k, so no full sort is needed."""
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return rows.withColumn("_draw", draw).orderBy("_draw", key).limit(k).drop("_draw")


def outlier_enriched_sample(failures: DataFrame, size: int, seed: int) -> DataFrame:
    """All outliers plus a seeded fill up to ``size`` rows."""
    outliers = failures.filter("is_outlier")
    rest = failures.filter(~F.col("is_outlier"))
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("payment_id")), 256)
    filled = rest.withColumn("_draw", draw).orderBy("_draw", "payment_id").limit(size)
    ranked = filled.withColumn("_rank", F.row_number().over(W.orderBy("_draw", "payment_id")))
    room = outliers.agg(F.count("*")).scalar()
    return outliers.unionByName(ranked.filter(F.col("_rank") <= F.lit(size) - room).drop("_draw", "_rank"))
