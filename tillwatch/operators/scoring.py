"""Detected incidents against labelled outage windows and declared downtimes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions.literals import literal_array
from tillwatch.functions.timegrid import ENTITY, bucket_index, micros
from tillwatch.operators.detectors import DETECTORS
from tillwatch.operators.incidents import incident_buckets, summarise_incidents
from tillwatch.operators.intervals import confirmed_incidents, correlate_downtimes, overlap_join
from tillwatch.operators.series import with_origin
from tillwatch.session import checkpointed
from tillwatch.sources.failures import with_entity


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def true_windows(failures: DataFrame) -> DataFrame:
    """Labelled outages rebuilt from their failures; the end is one microsecond past the last.

    A window whose failures belong to more than one (method, bank) is an error.
    """
    entity = F.struct("method", "bank")
    labelled = with_entity(failures).filter(F.col("downtime_window_id").isNotNull())
    per_reason = labelled.groupBy(F.col("downtime_window_id").alias("window_id"), "error_reason").agg(
        F.count("*").alias("n"), F.min(F.struct("created_at", "payment_id")).alias("first_seen"),
        F.max("created_at").alias("last_at"), F.min(entity).alias("low"), F.max(entity).alias("high"),
        F.min("split").alias("split"),
    )
    windows = per_reason.groupBy("window_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("split").alias("split"),
        F.min("first_seen.created_at").alias("start"), F.max("last_at").alias("last_at"), F.sum("n").alias("n_events"),
        F.count("*").alias("n_distinct_reasons"),
        F.min(F.struct((-F.col("n")).alias("minus"), "first_seen", "error_reason")).alias("top"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_reason", "n")))).alias("reason_counts"),
    )
    mixed = F.raise_error(F.concat(F.lit("window spans several entities: "), F.col("window_id"))).cast("string")
    return windows.select(
        "window_id", "split",
        F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low.method")).otherwise(mixed).alias("method"),
        F.col("low.bank").alias("bank"), "start",
        (F.col("last_at") + F.expr("INTERVAL '0.000001' SECOND")).alias("end"),
        "n_events", "n_distinct_reasons", "reason_counts",
        F.col("top.error_reason").alias("majority_reason"),
        (-F.col("top.minus") / F.col("n_events")).alias("majority_share"),
        (F.col("n_events") + F.col("top.minus")).alias("invisible_events"),
    )


def cross_reason_summary(windows: DataFrame) -> DataFrame:
    """How much of an outage a per-reason view would miss, for all windows and per split."""
    multi = F.col("n_distinct_reasons") > 1
    hidden = F.when(multi, 1.0 - F.col("majority_share"))
    return windows.rollup("split").agg(
        F.count("*").alias("n_windows"), F.count_if(multi).alias("n_multi_reason_windows"),
        ratio(F.count_if(multi), F.count("*")).alias("multi_reason_fraction"),
        F.avg(hidden).alias("mean_invisible_fraction"), F.percentile(hidden, F.lit(0.5)).alias("median_invisible_fraction"),
        F.coalesce(F.sum(F.when(multi, F.col("n_events"))), F.lit(0)).alias("multi_reason_events"),
        F.coalesce(F.sum(F.when(multi, F.col("invisible_events"))), F.lit(0)).alias("invisible_events"),
        ratio(F.sum(F.when(multi, F.col("invisible_events"))), F.sum(F.when(multi, F.col("n_events"))))
        .alias("overall_invisible_fraction"),
    ).withColumn("scope", F.coalesce("split", F.lit("all"))).drop("split")


def scored_detectors(
    counts: DataFrame, keys: Sequence[str] = ENTITY, options: Mapping[str, dict] | None = None,
    names: Sequence[str] = tuple(DETECTORS), prefix: str = "",
) -> DataFrame:
    """Incident buckets of several detectors over one series with per-split grids, tagged ``detector``."""
    result = None
    for name in names:
        scored = DETECTORS[name](counts, keys=["split", *keys], **(options or {}).get(name, {}))
        tagged = incident_buckets(scored, ["split", *keys]).select(
            F.lit(prefix + name).alias("detector"), "split", *keys, "idx", "n", "score", "incident_no"
        )
        result = tagged if result is None else result.unionByName(tagged)
    return result


def detector_report(
    failures: DataFrame, keys: Sequence[str] = ENTITY, options: Mapping[str, dict] | None = None,
    names: Sequence[str] = tuple(DETECTORS), prefix: str = "",
) -> DataFrame:
    """One row per detector and split: precision, recall, F1, time to detect, fragmentation,
    event attribution and background false positives.

    The failures are read twice: for the counts per bucket and for the windows. Counts, windows
    and detected buckets are checkpointed, because every figure below reads them again.
    """
    truth = checkpointed(
        with_entity(failures).groupBy("split", *keys, bucket_index(F.col("created_at")).alias("idx")).agg(
            F.count("downtime_window_id").alias("labelled"),
            F.count_if(F.col("downtime_window_id").isNull()).alias("background"),
        )
    )
    counts = with_origin(
        truth.select("split", *keys, "idx", (F.col("labelled") + F.col("background")).alias("n")), ["split"]
    )
    buckets = checkpointed(scored_detectors(counts, keys, options, names, prefix))
    group = ["detector", "split"]
    incidents = summarise_incidents(buckets, None, [*group, *keys])
    tags = literal_array([prefix + name for name in names])
    windows = checkpointed(true_windows(failures).select("window_id", "split", "method", "bank", "start", "end"))
    tagged_windows = windows.select("*", F.explode(tags).alias("detector"))
    scope = ["detector", "split", "method", "bank"]

    per_window = overlap_join(tagged_windows, incidents, scope).groupBy(
        F.col("l_detector").alias("detector"), F.col("l_window_id").alias("window_id")
    ).agg(F.count("*").alias("fragments"), F.min("r_start").alias("first_start"))
    judged = tagged_windows.join(per_window, ["detector", "window_id"], "left")
    late = (micros(F.col("first_start")) - micros(F.col("start"))) / 60_000_000
    delay = F.when(late.isNotNull(), F.greatest(F.lit(0.0), late))
    fragments = F.coalesce("fragments", F.lit(0))
    window_stats = judged.groupBy(*group).agg(
        F.count("*").alias("n_true_windows"), F.count("fragments").alias("n_true_positive_windows"),
        F.min(delay).alias("ttd_min"), F.percentile(delay, literal_array([0.25, 0.5, 0.75])).alias("ttd"),
        F.max(delay).alias("ttd_max"), F.avg(delay).alias("ttd_mean"),
        F.avg(fragments).alias("mean_fragments"), F.percentile(fragments, F.lit(0.5)).alias("median_fragments"),
        F.max(fragments).alias("max_fragments"), F.avg((fragments > 1).cast("double")).alias("share_fragmented"),
    )
    incident_stats = incidents.groupBy(*group).agg(F.count("*").alias("n_detected_incidents"))
    confirmed = confirmed_incidents(incidents, tagged_windows, scope).groupBy(*group).agg(
        F.count("*").alias("n_true_positive_incidents")
    )
    totals = truth.groupBy("split").agg(F.sum("labelled").alias("labelled"), F.sum("background").alias("background"))
    inside = buckets.select("detector", "split", *[F.col(k).alias(f"m_{k}") for k in keys], F.col("idx").alias("m_idx"))
    on = (truth["split"] == inside["split"]) & (F.col("idx") == F.col("m_idx"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"m_{k}"))
    covered = truth.join(inside, on).groupBy("detector", truth["split"]).agg(
        F.sum("labelled").alias("labelled_inside"), F.sum("background").alias("background_inside")
    )
    n_entities = truth.select("split", *keys).distinct().groupBy("split").agg(F.count("*").alias("n_entities"))
    base = totals.select("*", F.explode(tags).alias("detector")).join(n_entities, "split")
    report = base
    for part in (window_stats, incident_stats, confirmed, covered):
        report = report.join(part, group, "left")

    def count(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    precision = ratio(count("n_true_positive_incidents"), count("n_detected_incidents"))
    recall = ratio(count("n_true_positive_windows"), count("n_true_windows"))
    return report.select(
        "detector", "split", "n_entities", count("n_true_windows").alias("n_true_windows"),
        count("n_detected_incidents").alias("n_detected_incidents"),
        count("n_true_positive_windows").alias("n_true_positive_windows"),
        count("n_true_positive_incidents").alias("n_true_positive_incidents"),
        precision.alias("precision"), recall.alias("recall"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).alias("f1"),
        ratio(count("labelled_inside"), F.col("labelled")).alias("event_attribution_accuracy"),
        ratio(count("background_inside"), F.col("background")).alias("background_false_positive_rate"),
        "ttd_min", F.get("ttd", F.lit(0)).alias("ttd_p25"), F.get("ttd", F.lit(1)).alias("ttd_median"),
        F.get("ttd", F.lit(2)).alias("ttd_p75"), "ttd_max", "ttd_mean",
        "mean_fragments", "median_fragments", "max_fragments", "share_fragmented",
    )


def select_winner(report: DataFrame, split: str = "test") -> DataFrame:
    """Best F1 on the given split, ties by fewer background false positives, then by name."""
    return (
        report.filter(F.col("split") == split)
        .orderBy(
            F.coalesce("f1", F.lit(-1.0)).desc(), F.coalesce("background_false_positive_rate", F.lit(1.0)), "detector"
        )
        .limit(1)
    )


def declared_downtimes(windows: DataFrame) -> DataFrame:
    """Declared downtimes as an operator would have published them for the windows."""
    seconds = (micros(F.col("end")) - micros(F.col("start"))) / 1_000_000
    severity = F.when(seconds >= 7200, "high").when(seconds >= 3600, "medium").otherwise("low")
    return windows.filter(F.col("method").isin(K.DOWNTIME_METHODS)).select(
        F.concat(F.lit("down_"), "window_id").alias("id"), "method", "bank", F.col("start").alias("begin"), "end",
        F.lit("resolved").alias("status"), F.lit(False).alias("scheduled"), severity.alias("severity"),
        F.col("window_id").alias("ordinal"),
    )


def corroboration_summary(detected: DataFrame, downtimes: DataFrame, incident_key: Sequence[str]) -> DataFrame:
    """How many incidents a declared downtime confirms, among those a downtime could confirm."""
    matched = correlate_downtimes(detected, downtimes, incident_key)
    possible = F.col("method").isin(K.DOWNTIME_METHODS)
    counts = matched.agg(
        F.count("*").alias("n_detected_incidents"), F.count_if(possible).alias("n_correlatable"),
        F.count_if(~possible).alias("n_never_correlatable"), F.count("downtime_id").alias("n_corroborated"),
    )
    declared = downtimes.agg(F.count("*").alias("n")).scalar()
    return counts.select(
        declared.alias("n_declared_downtimes"), "*",
        ratio(F.col("n_corroborated"), F.col("n_correlatable")).alias("corroboration_rate"),
    )
