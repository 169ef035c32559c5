"""Finite replays of the stream operators against their batch forms."""

import datetime as dt
import json
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tillwatch.functions.policy import PolicyConfig
from tillwatch.operators.detectors import DETECTORS
from tillwatch.operators.guardrails import accepted_contacts
from tillwatch.operators.incidents import detect_incidents
from tillwatch.operators.series import bucket_counts
from tillwatch.sources.payloads import parse_downtime_webhooks, valid_rows
from tillwatch.streaming import operators as S

SF = "/root/testdata/sf0.001"


def replay(spark, df, tmp_path, build, mode="append", files=1, closing=None):
    """Write rows as files, stream them through ``build`` and return what came out; a closing row (SQL) moves the watermark on."""
    source = tmp_path / "in"
    df.coalesce(files).write.parquet(str(source))
    if closing:
        spark.sql(closing).select(df.columns).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    name = "t" + uuid.uuid4().hex
    query = (
        build(stream).writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def test_ttl_dedup_matches_hand_case(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    hours = {"a": [0, 5, 23, 24, 47, 48], "b": [1, 2]}
    rows = [(k, start + dt.timedelta(hours=h)) for k, hs in hours.items() for h in hs]
    df = spark.createDataFrame(rows, "event_id string, received_at timestamp")
    out = replay(spark, df, tmp_path, S.first_sightings)
    kept = sorted((r.event_id, int((r.received_at - start).total_seconds() // 3600)) for r in out)
    assert kept == [("a", 0), ("a", 24), ("a", 48), ("b", 1)]


def test_watermark_dedup_drops_redelivery(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", at), ("a", at), ("b", at)], "event_id string, received_at timestamp")
    out = replay(spark, df, tmp_path, S.drop_redeliveries)
    assert sorted(r.event_id for r in out) == ["a", "b"]


def test_tumbling_counts_match_batch(spark, failures, tmp_path):
    rows = failures.select("method", "bank", F.col("created_at").cast("timestamp").alias("created_at"))
    closing = spark.sql("select 'upi' method, 'x' bank, timestamp'2030-01-01' created_at")
    out = replay(spark, rows.unionByName(closing), tmp_path, S.tumbling_counts)
    got = sorted((r.method, r.bank or "", r.bucket_start, r.n) for r in out)
    batch = bucket_counts(failures).select(
        "method", F.coalesce("bank", F.lit("")), F.timestamp_micros(F.col("idx") * 900_000_000), "n"
    ).collect()
    assert got == sorted(tuple(r) for r in batch)


FAR = "timestamp'2035-01-01'"


@pytest.mark.parametrize("detector", ["poisson_surprise", "rolling_zscore", "ewma_zscore", "fixed_threshold"])
def test_burst_watch_matches_batch(spark, failures, tmp_path, detector):
    """Counts in no order of time: every bucket waits for the watermark."""
    counts = bucket_counts(failures, width_seconds=14_400).cache()
    origin = counts.agg(F.min("origin")).first()[0] * 14_400 * 1_000_000
    start = F.col("idx") * 14_400_000_000
    rows = counts.select("method", "bank", F.timestamp_micros(start).alias("bucket_start"), F.timestamp_micros(start + 14_399_999_999).alias("bucket_end"), "n")
    out = replay(spark, rows.orderBy(F.xxhash64("bucket_start", "method", "bank")), tmp_path, lambda s: S.watch_bursts(s.withWatermark("bucket_end", "1000 days"), origin, detector, 14_400),
                 closing=f"select 'upi' method, 'x' bank, {FAR} bucket_start, {FAR} bucket_end, 1L n", files=3)
    got = {(r.method, r.bank, r.bucket_start): (round(r.score, 6), r.is_burst) for r in out}
    batch = DETECTORS[detector](counts).withColumn("at", F.timestamp_micros(F.col("idx") * 14_400_000_000)).collect()
    assert got == {(r.method, r.bank, r["at"]): (round(r.score, 6), r.is_burst) for r in batch}


def test_incident_watch_bridges_gaps_and_closes_once(spark, tmp_path):
    """Bursts b, quiet q: within a gap of one bucket they are one incident; quiet counts count only between bursts."""
    start = dt.datetime(2026, 1, 1)
    marks = {"upi": "bqb.qb..bq..b", "card": "q.b.b.b", "wallet": "qq"}
    rows = [(m, None if m == "wallet" else "Axis Bank", start + dt.timedelta(minutes=15 * i), start + dt.timedelta(minutes=15 * i + 14), i + 1, float(i), c == "b")
            for m, line in marks.items() for i, c in enumerate(line) if c != "."]
    df = spark.createDataFrame(rows, S.BURST_SCHEMA.replace("n long", "n long")).select("method", "bank", "bucket_start", "bucket_end", "n", "score", "is_burst")
    out = replay(spark, df, tmp_path, lambda s: S.watch_incidents(s.withWatermark("bucket_end", "0 seconds")),
                 closing=f"select 'upi' method, 'x' bank, {FAR} bucket_start, {FAR} bucket_end, 1L n, 0D score, false is_burst")
    got = sorted((r.method, r.incident_no, int((r.start - start).total_seconds()) // 900, r.n_buckets, r.total_count, r.peak_score) for r in out)
    assert got == [("card", 1, 2, 5, 3 + 5 + 7, 6.0), ("upi", 1, 0, 3, 1 + 2 + 3, 2.0), ("upi", 2, 5, 1, 6, 5.0), ("upi", 3, 8, 1, 9, 8.0), ("upi", 4, 12, 1, 13, 12.0)]


def test_incidents_from_failures_match_batch(spark, failures, tmp_path):
    rows = failures.select("method", "bank", F.col("created_at").cast("timestamp").alias("created_at"))
    origin = bucket_counts(failures, width_seconds=14_400).agg(F.min("origin")).first()[0] * 14_400_000_000
    build = lambda s: S.incidents_from_failures(s, origin, "rolling_zscore", width_seconds=14_400)
    out = replay(spark, rows, tmp_path, build, closing=f"select 'upi' method, 'x' bank, {FAR} created_at")
    batch = detect_incidents(failures, DETECTORS["rolling_zscore"], width_seconds=14_400)
    shown = lambda rows: sorted((r.method, r.bank or "", r.incident_no, str(r.start), str(r.end), r.total_count, round(r.peak_score, 6)) for r in rows)
    assert shown(out) == shown(batch.collect()) and len(out) > 3


def test_contact_history_matches_batch_in_any_order(spark, failures, tmp_path):
    requests = failures.select("customer_id", "payment_id", F.col("created_at").cast("timestamp").alias("created_at"))
    config = PolicyConfig(cooldown_seconds=3600)
    shuffled = requests.orderBy(F.xxhash64("payment_id"))
    out = replay(spark, shuffled, tmp_path, lambda s: S.contact_verdicts(s, config, "1000 days"), files=3,
                 closing=f"select 'c' customer_id, 'p' payment_id, {FAR} created_at")
    accepted = {r.payment_id for r in out if r.verdict == "accepted"}
    assert accepted == {r.id for r in accepted_contacts(requests, config).collect()}
    assert len(out) == requests.count()


def test_a_request_behind_the_watermark_is_counted_as_late(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    schema = "customer_id string, payment_id string, created_at timestamp"
    hours = [("p1", 0), ("p3", 2), ("p0", -5), ("p2", 1.5), ("p9", 900)]
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    query = (
        S.contact_verdicts(stream, PolicyConfig(cooldown_seconds=600)).writeStream.format("memory").queryName("late_case").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    for name, hour in hours:
        spark.createDataFrame([("c", name, at + dt.timedelta(hours=hour))], schema).coalesce(1).write.mode("append").parquet(str(source))
        query.processAllAvailable()
    verdicts = [(r.payment_id, r.verdict, r.contacts_in_window) for r in spark.table("late_case").orderBy("created_at").collect()]
    late = S.late_rows(query)
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    query.stop()
    assert verdicts == [("p1", "accepted", 0), ("p2", "accepted", 1), ("p3", "accepted", 2)]
    assert late == 1 and sizes[-1] < max(sizes)


def test_stream_diagnosis(spark, failures, diagnoses, tmp_path):
    rows = failures.select("payment_id", "error_reason")
    out = replay(spark, rows, tmp_path, lambda s: S.diagnose_stream(s, diagnoses))
    assert len(out) == failures.count() and all(r.remediation_class for r in out)


def test_current_downtimes_keep_newest(spark, tmp_path):
    def webhook(kind, updated, end):
        entity = {"id": "down_1", "entity": "payment.downtime", "method": "upi", "begin": 1591946222, "end": end,
                  "status": kind, "scheduled": False, "severity": "high", "instrument": {"bank": "Axis Bank"},
                  "created_at": 1591946222, "updated_at": updated}
        return json.dumps({"entity": "event", "account_id": "acc", "event": f"payment.downtime.{kind}",
                           "contains": ["payment.downtime"], "payload": {"payment.downtime": {"entity": entity}},
                           "created_at": updated})

    rows = [(webhook("started", 1591946230, None),), (webhook("resolved", 1591950000, 1591949999),)]
    df = spark.createDataFrame(rows, "payload string")
    out = replay(
        spark, df, tmp_path,
        lambda s: S.current_downtimes(valid_rows(parse_downtime_webhooks(s)).drop("payload", "instrument")), mode="update",
    )
    final = max(out, key=lambda r: r.updated_at)
    assert final.status == "resolved" and final.begin == dt.datetime(2020, 6, 12, 7, 17, 2)


def test_state_of_a_resolved_downtime_expires(spark, tmp_path):
    """A redelivery is told from news by state within the lateness, by the watermark after it; open downtimes stay."""
    at = dt.datetime(2024, 1, 1)
    schema = "id string, method string, status string, updated_at timestamp_ntz"
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    query = (
        S.current_downtimes(stream, "1 hour").writeStream.format("memory").queryName("expiry_case").outputMode("update")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )

    def send(*rows):
        spark.createDataFrame([(i, "upi", s, at + dt.timedelta(minutes=m)) for i, s, m in rows], schema).coalesce(1).write.mode("append").parquet(str(source))
        query.processAllAvailable()
        return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1]

    full = send(("a", "started", 0), ("b", "started", 0), ("a", "resolved", 5), ("c", "started", 1), ("c", "resolved", 2))
    send(("a", "started", 1))
    send(("d", "started", 500))
    left = send(("a", "started", 1))
    late = S.late_rows(query)
    query.stop()
    assert {(r.id, r.status) for r in spark.table("expiry_case").collect()} == {("a", "resolved"), ("b", "started"), ("c", "resolved"), ("d", "started")}
    assert late == 1 and left < full + 1


@pytest.mark.parametrize("name", ["sightings", "contacts", "bursts", "incidents"])
def test_timers_grow_with_groups_not_with_rows(spark, tmp_path, name):
    """400 rows of 40 ids, or of one entity: a timer per row would call Python and read the state 400 times."""
    build = {
        "sightings": lambda s: S.first_sightings(s.select(F.col("id").alias("event_id"), F.col("at").alias("received_at")), 60, shards=4),
        "contacts": lambda s: S.contact_verdicts(
            s.select(F.col("id").alias("customer_id"), F.col("no").cast("string").alias("payment_id"), F.col("at").alias("created_at")),
            PolicyConfig(cooldown_seconds=60), shards=4),
        "bursts": lambda s: S.watch_bursts(s.withWatermark("bucket_end", "1 hour"), 0),
        "incidents": lambda s: S.watch_incidents(s.withWatermark("bucket_end", "1 hour")),
    }[name]
    rows = spark.range(400).selectExpr(
        "concat('c', id % 40) id", "id no", "timestamp_seconds(1700000000 + id * 900) at", "'upi' method", "'Axis Bank' bank",
        "timestamp_seconds(1700000000 + id * 900) bucket_start", "timestamp_seconds(1700000899 + id * 900) bucket_end", "1L n", "1D score", "true is_burst")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = (
        build(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("noop").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    query.processAllAvailable()
    registered = sum(p.stateOperators[0].customMetrics["numRegisteredTimers"] for p in query.recentProgress if p.stateOperators)
    query.stop()
    assert 0 < registered <= 12
