"""Agreement of predicted clusters with true labels, from contingency counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.operators.scoring import ratio


def cluster_metrics(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Purity, NMI (arithmetic mean), ARI and cluster counts per group of ``by``.

    ``labels`` has true_label and pred_label (-1 = noise, an ordinary cluster for purity, NMI
    and ARI). Rows are only counted; everything after works on label pairs.
    """
    keys = list(by) or ["_all"]
    if not by:
        labels = labels.withColumn("_all", F.lit(1))
    pairs = labels.groupBy(*keys, "pred_label", "true_label").agg(F.count("*").alias("n"))
    pred = pairs.groupBy(*keys, "pred_label").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    true = pairs.groupBy(*keys, "true_label").agg(F.sum("n").alias("n"))

    def sums(table: DataFrame, tag: str, *more: Column) -> DataFrame:
        n = F.col("n").cast("double")
        return table.groupBy(*keys).agg(
            F.sum(n * n).alias(f"sq_{tag}"), F.sum(n * F.log(n)).alias(f"nlogn_{tag}"),
            F.count("*").alias(f"k_{tag}"), *more,
        )

    joined = (
        sums(pairs, "pair", F.sum("n").alias("n_events"))
        .join(sums(pred, "pred", F.sum("top").alias("correct"), F.count_if(F.col("pred_label") != -1).alias("n_pred")), keys)
        .join(sums(true, "true"), keys)
    )
    n = F.col("n_events").cast("double")
    h_pred = F.log(n) - F.col("nlogn_pred") / n
    h_true = F.log(n) - F.col("nlogn_true") / n
    mutual = F.greatest(
        F.lit(0.0), F.log(n) + (F.col("nlogn_pair") - F.col("nlogn_pred") - F.col("nlogn_true")) / n
    )
    nmi = (
        F.when((F.col("k_pred") == 1) & (F.col("k_true") == 1), 1.0)
        .when(mutual <= 2.3e-16, 0.0).otherwise(mutual / ((h_pred + h_true) / 2))
    )
    both, only_true, only_pred = F.col("sq_pair"), F.col("sq_true"), F.col("sq_pred")
    tp, fn, fp = both - n, only_true - both, only_pred - both
    tn = n * n - only_true - only_pred + both
    ari = F.when((fn == 0) & (fp == 0), 1.0).otherwise(
        2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    )
    return joined.select(
        *by, (F.col("correct") / F.col("n_events")).alias("purity"), nmi.alias("nmi"), ari.alias("ari"),
        F.col("n_pred").alias("n_predicted_clusters"), F.col("k_true").alias("n_true_clusters"), "n_events",
    )


def noise_handling(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Do noise labels hit the outliers? Needs is_outlier and pred_label."""
    outlier, noise = F.col("is_outlier"), F.col("pred_label") == -1
    counts = labels.groupBy(*by).agg(
        F.count_if(outlier).alias("n_true_outliers"), F.count_if(noise).alias("n_predicted_noise"),
        F.count_if(outlier & noise).alias("n_correctly_noised"),
        F.count_if(outlier & ~noise).alias("n_forced_into_cluster"),
    )
    return counts.select(
        "*", ratio(F.col("n_correctly_noised"), F.col("n_true_outliers")).alias("noise_recall"),
        ratio(F.col("n_correctly_noised"), F.col("n_predicted_noise")).alias("noise_precision"),
    )


def blended_metric(share: Column, catchall: Column, narrow: Column) -> Column:
    return share * catchall + (1 - share) * narrow


def crossover_shares(
    rows: DataFrame, by: Sequence[str], resolution: int = 1001
) -> DataFrame:
    """Smallest catch-all share at which the candidate beats the baseline, NULL if none.

    ``rows`` has candidate_catchall, candidate_narrow, baseline_catchall and baseline_narrow.
    """
    if resolution < 2:
        raise ValueError("resolution must be at least 2")
    share = F.col("step") / (resolution - 1)
    ours = blended_metric(share, F.col("candidate_catchall"), F.col("candidate_narrow"))
    theirs = blended_metric(share, F.col("baseline_catchall"), F.col("baseline_narrow"))
    wins = (
        rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(resolution - 1))).alias("step"))
        .filter(ours > theirs).groupBy(*by).agg((F.min("step") / (resolution - 1)).alias("crossover_share"))
    )
    return rows.join(wins, list(by), "left")
