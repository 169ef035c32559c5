"""Clusterer comparison: candidates on two description arms, scored per stratum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions.taxonomy import true_label
from tillwatch.functions.text import mask_description
from tillwatch.operators.clustering import CLUSTERERS, ROOT_CAUSE
from tillwatch.operators.corpus import opaque_description, tag_outliers
from tillwatch.operators.metrics import cluster_metrics, crossover_shares, noise_handling
from tillwatch.session import checkpointed
from tillwatch.sources.dimensions import reason_explanation

GROUP = ["candidate", "arm", "stratum"]


def label_table(failures: DataFrame, candidates: tuple[str, ...] = tuple(CLUSTERERS)) -> DataFrame:
    """Long table (candidate, arm, stratum, true_label, pred_label, is_outlier).

    The structured grouping labels every failure; text clusterers only the catch-all stratum.
    The masked texts and each candidate's labels are checkpointed: eight plans over one input
    would otherwise be planned, and on a lost executor recomputed, as a single one.
    """
    tagged = tag_outliers(failures)
    opaque = opaque_description(tagged, {r: reason_explanation(r) for r in K.CATCH_ALL_REASONS})
    stratum = F.when(F.col("latent_subcause_id").isNotNull(), "catchall").otherwise("narrow")
    rows = checkpointed(tagged.select(
        "payment_id", "created_at", *ROOT_CAUSE, "is_outlier", stratum.alias("stratum"), true_label().alias("true_label"),
        mask_description(F.col("description")).alias("transparent"), mask_description(opaque).alias("opaque"),
    ))
    parts = []
    for arm in ("transparent", "opaque"):
        for name in candidates:
            source = rows if name == "groupby_reason" else rows.filter(F.col("stratum") == "catchall")
            labels = source.withColumn("masked_description", F.col(arm)).transform(CLUSTERERS[name])
            parts.append(checkpointed(
                labels.join(rows, "payment_id").select(
                    F.lit(name).alias("candidate"), F.lit(arm).alias("arm"), "stratum", "true_label", "pred_label",
                    "is_outlier",
                )
            ))
    return reduce(DataFrame.unionByName, parts)


def bakeoff_metrics(labels: DataFrame) -> DataFrame:
    return cluster_metrics(labels, GROUP).join(noise_handling(labels, GROUP), GROUP)


def bakeoff_crossovers(metrics: DataFrame) -> DataFrame:
    """Share of catch-all traffic from which a text clusterer would beat the grouping."""
    long = metrics.select(
        *GROUP, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("purity", "nmi", "ari")]))
    )
    baseline = long.filter(F.col("candidate") == "groupby_reason").groupBy("arm", "metric").agg(
        F.max(F.when(F.col("stratum") == "catchall", F.col("value"))).alias("baseline_catchall"),
        F.max(F.when(F.col("stratum") == "narrow", F.col("value"))).alias("baseline_narrow"),
    )
    rows = (
        long.filter((F.col("candidate") != "groupby_reason") & (F.col("stratum") == "catchall"))
        .withColumnRenamed("value", "candidate_catchall").drop("stratum").join(baseline, ["arm", "metric"])
        .withColumn("candidate_narrow", F.col("baseline_narrow"))
    )
    return crossover_shares(rows, ["candidate", "arm", "metric"])
