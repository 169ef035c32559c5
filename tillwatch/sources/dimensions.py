"""Reason dimension, reviewed classes and stored external answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.schemas import EXTERNAL_ANSWERS, REASONS
from tillwatch.session import inline_table


def class_table_rows() -> list[tuple[int, str, list[str], str | None]]:
    rows = []
    for index, (reason, classes, flag) in enumerate(K.REASON_CLASS_TABLE):
        note = "next steps contradict the explanation" if flag == "defect" else None
        rows.append((index, reason, sorted(classes), note))
    return rows


def unique_reasons() -> list[str]:
    return list(dict.fromkeys(row[1] for row in class_table_rows()))


def reason_explanation(reason: str) -> str:
    """Stand-in text for reasons whose published explanation is not available."""
    words = reason.replace("_", " ")
    return f"The payment stopped with {words}. See the processor log for details."


def default_reasons(spark: SparkSession) -> DataFrame:
    """The built-in reason dimension (row_index, reason, explanation, next_steps)."""
    rows = [
        (index, reason, reason_explanation(reason), "Recommended: " + " or ".join(classes) + ".")
        for index, reason, classes, _ in class_table_rows()
    ]
    return inline_table(spark, ["row_index", "reason", "explanation", "next_steps"], rows)


def reviewed_classes(spark: SparkSession) -> DataFrame:
    """The reviewed class table (row_index, reason, candidate_classes, note)."""
    return inline_table(
        spark, ["row_index", "reason", "candidate_classes", "note"],
        [(index, reason, classes, note) for index, reason, classes, note in class_table_rows()],
    ).withColumn("note", F.col("note").cast("string"))


def default_answers(spark: SparkSession) -> DataFrame:
    """Stored answers for the escalated reasons, with a short rationale."""
    return inline_table(
        spark, ["reason", "remediation_class", "confidence", "rationale"],
        [(r, c, conf, f"stored answer for {r}") for r, c, conf in K.EXTERNAL_ANSWER_TABLE],
    )


def load_reasons(spark: SparkSession, path: str, expected_rows: int | None = 114) -> DataFrame:
    """Read a reason dimension from CSV (header ``Reason,Explanation,Next Steps`` with a
    leading ``row_index``) or Parquet, dropping rows without a reason.

    Raises when a text is blank or the row count differs: the file was truncated or refetched.
    """
    if path.endswith(".csv"):
        raw = spark.read.csv(path, header=True, enforceSchema=False, schema=REASONS, multiLine=True)
    else:
        raw = spark.read.schema(REASONS).parquet(path)
    kept = raw.filter(F.col("reason").isNotNull())
    checks = kept.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("explanation").isNull() | F.col("next_steps").isNull()).alias("blank"),
    ).first()
    if checks["blank"]:
        raise ValueError(f"{checks['blank']} reason rows lack an explanation or next steps")
    if expected_rows is not None and checks["n"] != expected_rows:
        raise ValueError(f"read {checks['n']} reason rows, expected {expected_rows}")
    return kept


def first_row_per_reason(reasons: DataFrame) -> DataFrame:
    """Keep the earliest row of each reason."""
    others = [name for name in reasons.columns if name != "reason"]
    picked = reasons.groupBy("reason").agg(F.min_by(F.struct(*others), "row_index").alias("row"))
    return picked.select("reason", *[F.col(f"row.{name}").alias(name) for name in others])


def load_external_answers(spark: SparkSession, path: str) -> DataFrame:
    """Stored answers from a JSON report; the last entry of a reason wins."""
    entries = spark.read.json(path, multiLine=True).select(
        F.posexplode("ambiguous_reason_results").alias("position", "entry")
    )
    fields = [field.name for field in EXTERNAL_ANSWERS.fields if field.name != "reason"]
    return (
        entries.groupBy(F.col("entry.reason").alias("reason"))
        .agg(F.max_by("entry", "position").alias("entry"))
        .select("reason", *[F.col(f"entry.{name}").alias(name) for name in fields])
    )
