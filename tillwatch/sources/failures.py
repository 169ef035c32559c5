"""Failed-payment events: the table scan and a view derived from a raw event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions import taxonomy as tx
from tillwatch.functions.literals import literal_array, sql_literal
from tillwatch.functions.timegrid import scoped_bank
from tillwatch.schemas import FAILURES, assert_schema
from tillwatch.session import inline_table, pin_utc
from tillwatch.sources.dimensions import class_table_rows, reason_explanation, unique_reasons

METHOD_CUTS = [("upi", 64), ("card", 84), ("netbanking", 92), ("wallet", 97), ("cardless_emi", 99), ("emandate", 100)]
SUBCAUSES = ["no_response", "maintenance", "limit_reached", "risk_hold"]


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Scan a stored failures table. Rows carry ``created_at``; order is never implied."""
    pin_utc(spark)
    return assert_schema(spark.read.parquet(path), FAILURES)


def row_classes() -> list[str | None]:
    """Per distinct reason the class of its first reviewed row, NULL when undecided."""
    classes: dict[str, str | None] = {}
    for _, reason, candidates, note in class_table_rows():
        classes.setdefault(reason, candidates[0] if len(candidates) == 1 and note is None else None)
    return [classes[reason] for reason in unique_reasons()]


def hash_percent(key: Column) -> Column:
    """A stable value in 0..99 from the first 32 bits of the key's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(100))


def root_causes(spark: SparkSession) -> DataFrame:
    """Code, source, step and first sentence per (reason, method, flow): a closed table of 1,320 rows,
    so the texts are searched there and not once per failure."""
    reasons = unique_reasons()
    rows = [(i, reason, reason_explanation(reason), row_class) for i, (reason, row_class) in enumerate(zip(reasons, row_classes(), strict=True))]
    table = inline_table(spark, ["reason_pos", "reason", "explanation", "row_class"], rows)
    every = table.withColumn("method", F.explode(literal_array([name for name, _ in METHOD_CUTS]))).withColumn(
        "upi_flow", F.explode(literal_array(["collect", "intent"]))
    )
    return every.select(
        "reason_pos", "method", "upi_flow",
        tx.infer_error_code(F.col("reason"), F.col("explanation")).alias("error_code"),
        tx.infer_source(F.col("row_class"), F.col("method")).alias("error_source"),
        tx.infer_step(F.col("explanation"), F.col("method"), F.col("upi_flow")).alias("error_step"),
        first_sentence(F.col("explanation")).alias("sentence"),
    )


def derive_failures(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Map raw events (event_id, ts, user_id, value, props) onto failed payments.

    All columns are row-wise except ``attempt_number`` (a rank within the order); a query that
    does not read it pays for no shuffle.
    """
    pin_utc(spark)
    reasons = unique_reasons()
    base = spark.sql(f"""
        SELECT *, date_format(created_at, 'yyyyMMdd') AS day, user_id % 12 AS bank_pos,
          element_at({sql_literal(K.BANK_NAMES)}, CAST(user_id % 12 AS INT) + 1) AS bank,
          element_at({sql_literal(reasons)}, reason_pos + 1) AS error_reason,
          IF(user_id % 2 = 0, 'collect', 'intent') AS upi_flow,
          IF(event_id % 5 = 0, 'paraphrase_wording', 'canonical') AS description_variant,
          lpad(CAST(event_id * 37 AS STRING), 12, '0') AS rrn
        FROM (
          SELECT event_id, user_id, CAST(ts AS TIMESTAMP_NTZ) AS created_at, CAST(round(value * 100) AS BIGINT) AS amount,
            concat('pay_', lpad(CAST(event_id AS STRING), 14, '0')) AS payment_id,
            concat('cust_', lpad(CAST(user_id AS STRING), 8, '0')) AS customer_id,
            CASE WHEN k < 64 THEN 'upi' WHEN k < 84 THEN 'card' WHEN k < 92 THEN 'netbanking' WHEN k < 97 THEN 'wallet'
              WHEN k < 99 THEN 'cardless_emi' ELSE 'emandate' END AS method,
            CAST((event_id * 7) % {len(reasons)} AS INT) AS reason_pos
          FROM (SELECT *, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {{events}})
        )""", events=events)
    shaped = spark.sql(f"""
        SELECT *, concat('order_', substring(md5(concat_ws('|', customer_id, method, day)), 1, 14)) AS order_id,
          IF(method = 'upi', concat('user', lpad(CAST(user_id AS STRING), 6, '0'), '@okbank'), NULL) AS vpa,
          IF(method = 'card', CAST(400000 + user_id % 99999 AS STRING), NULL) AS card_bin,
          IF(error_reason IN {sql_tuple(K.CATCH_ALL_REASONS)},
            element_at({sql_literal(SUBCAUSES)}, CAST((event_id div 110) % 4 AS INT) + 1), NULL) AS subcause,
          IF(method IN {sql_tuple(K.BANK_SCOPED_METHODS)}, bank_pos, 12) AS scoped,
          array_position({sql_literal([name for name, _ in METHOD_CUTS])}, method) AS method_pos
        FROM {{base}}""", base=base)
    labelled = spark.sql("""
        SELECT *, IF(subcause IS NOT NULL, concat_ws('.', error_reason, subcause), NULL) AS latent_subcause_id,
          IF((datediff(to_date(created_at), DATE'1970-01-01') * 5 + scoped * 7 + method_pos * 3) % 9 = 0
              AND hour(created_at) BETWEEN 10 AND 13,
            concat_ws('_', 'win', day, method, CAST(scoped AS STRING)), NULL) AS downtime_window_id
        FROM {shaped}""", shaped=shaped)
    sentence = F.when(
        F.col("subcause").isNotNull(),
        F.concat(F.lit("Payment declined upstream: "), F.translate("subcause", "_", " "), F.lit(".")),
    ).otherwise(F.col("sentence"))
    notice = F.when(F.col("description_variant") == "canonical", "").otherwise("Notice: ")
    typed = labelled.join(F.broadcast(root_causes(spark)), ["reason_pos", "method", "upi_flow"])
    return typed.select(
        "payment_id", "order_id", "customer_id", "amount", "method", "created_at",
        F.row_number().over(W.partitionBy("order_id").orderBy("created_at", "payment_id")).alias("attempt_number"),
        "bank", "vpa", "card_bin",
        "error_code", "error_source", "error_step",
        "error_reason", F.concat(notice, sentence, method_clause(F.col("rrn"))).alias("description"),
        "latent_subcause_id", "description_variant", F.lit(False).alias("is_outlier"), "downtime_window_id",
        F.when(hash_percent(F.coalesce("downtime_window_id", "payment_id")) < int(100 * K.TEST_FRACTION), "test")
        .otherwise("train").alias("split"),
    )


def sql_tuple(values: list[str]) -> str:
    return "(" + ", ".join(sql_literal(value) for value in values) + ")"


def first_sentence(explanation: Column) -> Column:
    """Text up to the first sentence break, closed by one full stop."""
    return F.concat(F.regexp_replace(F.substring_index(explanation, ". ", 1), r"\.+$", ""), F.lit("."))


def method_clause(rrn: Column) -> Column:
    """Identifiers a description carries for its method."""
    head = F.concat(
        F.lit(" (payment "), F.col("payment_id"), F.lit(", order "), F.col("order_id"), F.lit(", Rs."),
        rupees(F.col("amount")),
    )
    middle = (
        F.when(F.col("method") == "card", F.concat(F.lit(", card BIN "), F.coalesce("card_bin", F.lit(""))))
        .when(F.col("method") == "upi",
              F.concat(F.lit(", VPA "), F.coalesce("vpa", F.lit("")), F.lit(", RRN "), rrn))
        .when(F.col("method").isin("netbanking", "emandate"), F.concat(F.lit(", via "), F.col("bank")))
        .otherwise(F.lit(""))
    )
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(head, middle, F.lit(", at "), at, F.lit(")"))


def rupees(paise: Column) -> Column:
    """Paise as rupees with two decimals, without passing through floating point."""
    return F.concat(
        F.floor(paise / 100).cast("string"), F.lit("."), F.lpad(F.pmod(paise, F.lit(100)).cast("string"), 2, "0")
    )


def failures_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures over the ``events`` table.

    A file of few row groups is read by as few tasks, and texts cost far more than rows to move: the raw rows are dealt out
    first, by key and not in turn, so that a repeated task deals them the same way.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return derive_failures(spark, events.repartition(2 * spark.sparkContext.defaultParallelism, "event_id"))


def with_entity(failures: DataFrame) -> DataFrame:
    """Replace ``bank`` by the entity's bank (NULL for methods without bank scope)."""
    return failures.withColumn("bank", scoped_bank(F.col("method"), F.col("bank")))
