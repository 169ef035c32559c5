"""Streams over the tables, run to their end, and loaders over stored files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.catalog.base import SQL, query, significant, sql_stamp, stamp
from tillwatch.catalog.incident_queries import FV, incident_rows
from tillwatch.catalog.policy_queries import DECIDED, DF
from tillwatch.catalog.text_queries import DOWN, downtime_webhooks
from tillwatch.functions.policy import PolicyConfig
from tillwatch.operators import audit, execution, guardrails
from tillwatch.operators import diagnosis as D
from tillwatch.operators.incidents import flag_active_incidents
from tillwatch.session import shared_folder
from tillwatch.sources.audit_log import append_audit, append_stream, read_audit
from tillwatch.sources.dimensions import default_answers, default_reasons, load_external_answers, load_reasons
from tillwatch.sources.failures import failures_from_tables, read_failures
from tillwatch.sources.payloads import parse_downtime_webhooks, valid_rows
from tillwatch.streaming import operators as S
from tillwatch.streaming.replay import fed, newest, replayed

BUCKET_US = K.BUCKET_SECONDS * 1_000_000


def timed(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, F.col(name).cast("timestamp"))


# --- streams ----------------------------------------------------------------------------------


@query("stream_deduplicated_webhooks", SQL["deduplicated_webhooks"])
def stream_deduplicated_webhooks(spark, sf):
    deliveries = spark.read.parquet(f"{sf}/events.parquet").select(
        F.concat(F.lit("evt_"), F.col("user_id"), F.lit("_"), F.col("event_type")).alias("event_id"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )
    return replayed(deliveries, S.first_sightings, order=F.col("received_at")).select("event_id", stamp("received_at"))


@query("stream_bucket_counts", (
    f"{FV}, e AS (SELECT method, CASE WHEN method NOT IN ('wallet', 'cardless_emi') THEN bank END AS bank, us // {BUCKET_US} AS b, count(*) AS n FROM failures GROUP BY ALL) "
    f"SELECT method, bank, {sql_stamp(f'make_timestamp(b * {BUCKET_US})', 'bucket_start')}, n FROM e "
    f"WHERE (b + 1) * {BUCKET_US} <= (SELECT max(us) FROM failures) - 1800000000"
))
def stream_bucket_counts(spark, sf):
    rows = timed(failures_from_tables(spark, sf).select("method", "bank", "created_at"), "created_at")
    return replayed(rows, S.tumbling_counts, order=F.col("created_at")).select("method", "bank", stamp("bucket_start"), "n")


#: Failures arrive out of order by less than this, and buckets close that much later.
LATE_SECONDS = 1800
WATERMARK_US = f"((SELECT max(us) FROM failures) // 1000 * 1000 - {LATE_SECONDS}000000)"


def arriving(moment: str, key: str, seconds: int) -> Column:
    """Arrival time: up to ``seconds`` after the event, by a hash of the key."""
    late = F.pmod(F.xxhash64(key), F.lit(seconds * 1_000_000 - 1_000_000))
    return F.timestamp_micros(F.unix_micros(moment) + late)


def _arriving_failures(spark, sf) -> tuple[DataFrame, int]:
    rows = timed(failures_from_tables(spark, sf).select("payment_id", "method", "bank", "created_at"), "created_at")
    origin = rows.agg(F.min(F.unix_micros("created_at"))).first()[0] or 0
    return rows, origin // BUCKET_US * BUCKET_US


@query("stream_burst_calls", f"{SQL['burst_scores_poisson_surprise']} AND (idx + 1) * {BUCKET_US} <= {WATERMARK_US}")
def stream_burst_calls(spark, sf):
    rows, origin = _arriving_failures(spark, sf)
    out = replayed(rows, lambda s: S.watch_bursts(S.tumbling_counts(s, f"{LATE_SECONDS} seconds"), origin), order=arriving("created_at", "payment_id", LATE_SECONDS))
    idx = F.call_function("div", F.unix_micros("bucket_start"), F.lit(BUCKET_US)).alias("idx")
    return out.select("method", "bank", idx, "n", "is_burst", significant("score"))


@query("stream_incidents", (
    f"{SQL['incidents_poisson_surprise']} WHERE epoch_us(end_at) + {(K.MAX_GAP_BUCKETS + 1) * BUCKET_US} <= {WATERMARK_US}"
))
def stream_incidents(spark, sf):
    rows, origin = _arriving_failures(spark, sf)
    build = lambda s: S.incidents_from_failures(s, origin, lateness=f"{LATE_SECONDS} seconds")
    out = replayed(rows, build, order=arriving("created_at", "payment_id", LATE_SECONDS))
    return incident_rows(out)


@query("stream_contact_log", f"{DECIDED} SELECT customer_id, pid AS id FROM log WHERE us <= (SELECT max(us) FROM rq) // 1000 * 1000 - 3600000000")
def stream_contact_log(spark, sf):
    config = PolicyConfig()
    rows = guardrails.candidates(flag_active_incidents(failures_from_tables(spark, sf)), D.default_diagnoses(spark), config)
    requests = timed(rows.filter(F.col("_a4").isin(K.CHASE_ACTIONS)).select("customer_id", "payment_id", "created_at"), "created_at")
    out = replayed(requests, lambda s: S.contact_verdicts(s, config, "1 hour"), order=arriving("created_at", "payment_id", 3600))
    return out.filter("verdict = 'accepted'").select("customer_id", F.col("payment_id").alias("id"))


@query("stream_diagnosed_failures", SQL["diagnosed_failures"])
def stream_diagnosed_failures(spark, sf):
    rows = failures_from_tables(spark, sf).select("payment_id", "error_reason")
    diagnoses = D.default_diagnoses(spark)
    return replayed(rows, lambda s: S.diagnose_stream(s, diagnoses)).select(
        "payment_id", F.col("diagnosis_tier").alias("tier"), "remediation_class",
        F.col("diagnosis_confidence").alias("confidence"), F.col("diagnosis_rationale").alias("rationale"))


@query("stream_current_downtimes", (
    f"{DOWN} SELECT id, method, bank, status, {sql_stamp('make_timestamp(e * 1000000)', 'updated_at')} FROM dk "
    f"WHERE status = 'resolved' AND method IN ({', '.join(repr(m) for m in K.DOWNTIME_METHODS)})"
))
def stream_current_downtimes(spark, sf):
    build = lambda s: S.current_downtimes(valid_rows(parse_downtime_webhooks(s)).drop("payload", "instrument"))
    sent = F.timestamp_seconds(F.get_json_object("payload", "$.created_at").cast("long"))
    return newest(replayed(downtime_webhooks(spark, sf), build, "update", order=sent), ["id"]).select("id", "method", "bank", "status", stamp("updated_at"))


# --- loaders ----------------------------------------------------------------------------------


@query("stored_failures", f"{FV} SELECT payment_id, method, amount, error_reason FROM failures")
def stored_failures(spark, sf):
    folder = shared_folder(spark)
    failures_from_tables(spark, sf).withColumn("attempt_number", F.col("attempt_number").cast("int")).write.parquet(folder)
    return read_failures(spark, folder).select("payment_id", "method", "amount", "error_reason")


@query("stored_reason_usage", (
    f"{DF} SELECT r.row_index, r.reason, r.explanation, (SELECT count(*) FROM failures f WHERE f.error_reason = r.reason) AS n_failures FROM reason_rows r"
))
def stored_reason_usage(spark, sf):
    folder = shared_folder(spark)
    default_reasons(spark).write.parquet(folder)
    counts = failures_from_tables(spark, sf).groupBy(F.col("error_reason").alias("reason")).agg(F.count("*").alias("n_failures"))
    return load_reasons(spark, folder).join(counts, "reason", "left").select(
        F.col("row_index").cast("int").alias("row_index"), "reason", "explanation", F.coalesce("n_failures", F.lit(0)).alias("n_failures"))


@query("stored_answer_usage", (
    f"{DF} SELECT a.reason, a.remediation_class, a.confidence, (SELECT count(*) FROM failures f WHERE f.error_reason = a.reason) AS n_failures FROM answers a"
))
def stored_answer_usage(spark, sf):
    folder = shared_folder(spark)
    answers = default_answers(spark)
    report = answers.agg(F.sort_array(F.collect_list(F.struct(*answers.columns))).alias("ambiguous_reason_results"))
    report.coalesce(1).write.json(folder)
    counts = failures_from_tables(spark, sf).groupBy(F.col("error_reason").alias("reason")).agg(F.count("*").alias("n_failures"))
    return load_external_answers(spark, folder).join(counts, "reason", "left").select(
        "reason", "remediation_class", "confidence", F.coalesce("n_failures", F.lit(0)).alias("n_failures"))


def appended_log(spark, sf) -> DataFrame:
    """The decision log appended in two batches, the second one twice."""
    path = f"{shared_folder(spark)}/log"
    rows = _audit_rows(spark, sf)
    early = F.substring("created_at", 12, 2) < "12"
    for batch, part in (("a", rows.filter(early)), ("b", rows.filter(~early)), ("b", rows.filter(~early))):
        append_audit(part, path, 4, batch)
    return read_audit(spark, path)


def _audit_rows(spark, sf) -> DataFrame:
    failures, diagnoses = failures_from_tables(spark, sf), D.default_diagnoses(spark)
    decided = execution.execution_records(guardrails.decide_batch(failures, diagnoses, keep=audit.ERROR_CODES))
    rows = audit.audit_rows(decided, failures, diagnoses, "2026-01-01T00:00:00Z")
    folder = shared_folder(spark)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


@query("audit_resume", (
    f"{FV}, c AS (SELECT payment_id, strftime(created_at, '%Y-%m-%d') || '/' || lpad((('0x' || substr(md5(payment_id), 1, 8))::BIGINT % 4)::VARCHAR, 5, '0') AS chain_id, "
    "hour(created_at) >= 12 AS late, created_at FROM failures) "
    "SELECT chain_id, row_number() OVER (PARTITION BY chain_id ORDER BY late, created_at, payment_id) - 1 AS sequence, payment_id, "
    "row_number() OVER (PARTITION BY chain_id ORDER BY late, created_at, payment_id) > 1 AS linked, NULL::VARCHAR AS problem FROM c"
))
def audit_resume(spark, sf):
    log = appended_log(spark, sf)
    checks = audit.verify_chains(log).select("chain_id", F.col("detail").alias("problem"))
    return log.join(checks, "chain_id").select("chain_id", "sequence", "payment_id", F.col("prev_hash").isNotNull().alias("linked"), "problem")


CHAINED = (
    f"{FV}, c AS (SELECT payment_id, strftime(created_at, '%Y-%m-%d') || '/' || lpad((('0x' || substr(md5(payment_id), 1, 8))::BIGINT % 4)::VARCHAR, 5, '0') AS chain_id, "
    "created_at FROM failures) "
)


@query("stream_audit_log", (
    f"{CHAINED} SELECT chain_id, row_number() OVER w - 1 AS sequence, payment_id, row_number() OVER w > 1 AS linked, NULL::VARCHAR AS problem "
    "FROM c WINDOW w AS (PARTITION BY chain_id ORDER BY created_at, payment_id)"
))
def stream_audit_log(spark, sf):
    """The decision log as a stream in three runs from one checkpoint."""
    rows, folder = _audit_rows(spark, sf), shared_folder(spark)
    for source in fed(rows, folder, F.to_timestamp("created_at")):
        stream = spark.readStream.schema(rows.schema).parquet(source)
        append_stream(stream, f"{folder}/log", f"{folder}/state", 4).trigger(availableNow=True).start().awaitTermination()
    log = read_audit(spark, f"{folder}/log")
    checks = audit.verify_chains(log).select("chain_id", F.col("detail").alias("problem"))
    return log.join(checks, "chain_id").select("chain_id", "sequence", "payment_id", F.col("prev_hash").isNotNull().alias("linked"), "problem")


AUDITED = ["payment_id", "order_id", "customer_id", "amount", "method", "bank", "attempt_number", "error_code", "error_reason", "error_source", "error_step",
           "remediation_class", "base_action", "candidate_action", "final_action", "in_active_incident", "ladder_terminal_state"]


@query("audit_rows", (
    f"{DECIDED} SELECT {', '.join(AUDITED)}, tier AS diagnosis_tier, confidence AS diagnosis_confidence, rationale AS diagnosis_rationale, "
    "strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at, strftime(created_at, '%Y-%m-%d') AS chain_day, '2026-01-01T00:00:00Z' AS recorded_at, "
    f"{K.AUDIT_SCHEMA_VERSION!r} AS schema_version, 7 AS n_guardrails, b1::INT + b2::INT + b3::INT + b4::INT + b5::INT + b6::INT + b7::INT AS n_blocked, "
    "final_action AS executed_action FROM dd"
))
def audit_rows(spark, sf):
    rows = _audit_rows(spark, sf)
    return rows.select(
        *[F.col(c).cast("long") if c == "attempt_number" else F.col(c) for c in AUDITED], "diagnosis_tier", "diagnosis_confidence", "diagnosis_rationale",
        "created_at", "chain_day", "recorded_at", "schema_version", F.size("guardrail_evaluations").alias("n_guardrails"),
        F.size(F.filter("guardrail_evaluations", lambda e: e["blocked"])).alias("n_blocked"), F.col("execution.action").alias("executed_action"))


def payment_audit_lookup(spark, sf):
    found = failures_from_tables(spark, sf).agg(F.max(F.struct("created_at", "payment_id")).alias("m")).first()["m"]
    log = appended_log(spark, sf)
    rows = audit.records_for_payment(log, found["payment_id"], f"{found['created_at']:%Y-%m-%d}")
    return rows.select("payment_id", "chain_id", "final_action")


query("payment_audit_lookup", (
    f"{DECIDED} SELECT payment_id, strftime(created_at, '%Y-%m-%d') || '/' || lpad((('0x' || substr(md5(payment_id), 1, 8))::BIGINT % 4)::VARCHAR, 5, '0') AS chain_id, "
    "final_action FROM dd ORDER BY created_at DESC, payment_id DESC LIMIT 1"
))(payment_audit_lookup)
