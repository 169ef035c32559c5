"""From reason codes to remediation classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.session import inline_table
from tillwatch.sources.dimensions import default_answers, default_reasons, reviewed_classes


def classify_rows(reviewed: DataFrame) -> DataFrame:
    """A row is ambiguous with several candidate classes or a defect note."""
    ambiguous = (F.size("candidate_classes") != 1) | F.col("note").isNotNull()
    return reviewed.withColumn("is_ambiguous", ambiguous).withColumn(
        "remediation_class", F.when(~ambiguous, F.element_at("candidate_classes", 1))
    )


def drifted_rows(reasons: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Positions where the dimension and the reviewed table name different reasons."""
    left = reasons.select("row_index", F.col("reason").alias("dimension_reason"))
    right = reviewed.select("row_index", F.col("reason").alias("reviewed_reason"))
    return left.join(right, "row_index", "full_outer").filter(
        ~F.col("dimension_reason").eqNullSafe(F.col("reviewed_reason"))
    )


def reason_table(reasons: DataFrame, reviewed: DataFrame) -> DataFrame:
    """One row per reason: its class when every row settles on the same one, otherwise NULL
    with all row contexts as evidence for an external answer."""
    rows = classify_rows(reviewed).join(reasons.drop("reason"), "row_index")
    context = F.struct("row_index", "explanation", "next_steps", "candidate_classes", "note")
    grouped = rows.groupBy("reason").agg(
        F.bool_or("is_ambiguous").alias("any_ambiguous"),
        F.min("remediation_class").alias("lowest"), F.max("remediation_class").alias("highest"),
        F.array_sort(F.collect_list(context)).alias("contexts"),
    )
    settled = ~F.col("any_ambiguous") & (F.col("lowest") == F.col("highest"))
    return grouped.select(
        "reason", F.when(settled, F.col("lowest")).alias("remediation_class"),
        (~settled).alias("is_escalated"), F.when(~settled, F.col("contexts")).alias("contexts"),
    )


def pending_answers(table: DataFrame, answers: DataFrame) -> DataFrame:
    """Escalated reasons nobody answered yet: the work list for an external answerer."""
    return table.filter("is_escalated").join(answers, "reason", "left_anti").select("reason", "contexts")


def pending_calls(failures: DataFrame, table: DataFrame, answers: DataFrame) -> DataFrame:
    """Pending reasons that occur in the failures: one external call each, however often seen."""
    seen = failures.select(F.col("error_reason").alias("reason")).distinct()
    return pending_answers(table, answers).join(seen, "reason", "left_semi")


def merge_diagnoses(table: DataFrame, answers: DataFrame) -> DataFrame:
    """Settled reasons and stored answers as one diagnosis per reason; a gap is an error."""
    settled = table.filter(~F.col("is_escalated")).select(
        "reason", F.lit("deterministic").alias("tier"), "remediation_class",
        F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("rationale"),
    )
    answered = answers.select(
        "reason", F.col("remediation_class").alias("answer"), "confidence", "rationale"
    )
    missing = F.raise_error(F.concat(F.lit("no stored diagnosis for reason "), F.col("reason")))
    escalated = table.filter("is_escalated").select("reason").join(answered, "reason", "left").select(
        "reason", F.lit("llm").alias("tier"),
        F.when(F.col("answer").isNull(), missing.cast("string")).otherwise(F.col("answer")).alias("remediation_class"),
        "confidence", "rationale",
    )
    return settled.unionByName(escalated)


def default_reason_table(spark: SparkSession) -> DataFrame:
    return reason_table(default_reasons(spark), reviewed_classes(spark))


def default_diagnoses(spark: SparkSession) -> DataFrame:
    return merge_diagnoses(default_reason_table(spark), default_answers(spark))


def attach_by_reason(failures: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Left join on the reason. Any caller may pass diagnoses, so Spark decides by their measured
    size whether to broadcast them."""
    renamed = {
        "reason": "error_reason", "tier": "diagnosis_tier", "confidence": "diagnosis_confidence",
        "rationale": "diagnosis_rationale",
    }
    return failures.join(diagnoses.withColumnsRenamed(renamed), "error_reason", "left")


def diagnose(failures: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Attach tier, class, confidence and rationale; a reason without a diagnosis is an error."""
    unknown = F.raise_error(F.concat(F.lit("no diagnosis for reason "), F.col("error_reason"))).cast("string")
    return attach_by_reason(failures, diagnoses).select(
        *failures.columns, F.coalesce("diagnosis_tier", unknown).alias("diagnosis_tier"),
        F.coalesce("remediation_class", unknown).alias("remediation_class"),
        "diagnosis_confidence", "diagnosis_rationale",
    )


def routing_stats(failures: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Events per tier and the escalated reasons; counts reasons first, so it joins 110 rows."""
    per_reason = failures.groupBy("error_reason").agg(F.count("*").alias("n"))
    routed = diagnose(per_reason, diagnoses)
    external = F.col("diagnosis_tier") == "llm"
    totals = routed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum(F.when(~external, F.col("n"))), F.lit(0)).alias("deterministic_events"),
        F.coalesce(F.sum(F.when(external, F.col("n"))), F.lit(0)).alias("external_events"),
        F.count("*").alias("distinct_reasons_seen"),
        F.count_if(external).alias("external_calls_made"),
        F.array_sort(F.collect_set(F.when(external, F.col("error_reason")))).alias("escalated_reasons"),
    )

    def share(name: str) -> Column:
        return F.when(F.col("total_events") > 0, F.col(name) / F.col("total_events")).otherwise(0.0)

    return totals.withColumn("deterministic_fraction", share("deterministic_events")).withColumn(
        "external_fraction", share("external_events")
    )


def coverage_report(reviewed: DataFrame) -> DataFrame:
    """Unambiguous rows per class with explicit zeros, and the ambiguous rows as class NULL."""
    classes = inline_table(reviewed.sparkSession, ["remediation_class"], [[c] for c in K.REMEDIATION_CLASSES])
    rows = classify_rows(reviewed)
    counts = rows.groupBy("remediation_class").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("reason")).alias("reasons")
    )
    known = classes.join(counts.filter("remediation_class is not null"), "remediation_class", "left")
    return known.unionByName(counts.filter("remediation_class is null")).select(
        "remediation_class", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
    )
