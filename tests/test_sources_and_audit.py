import datetime as dt
import hashlib
import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillwatch import schemas
from tillwatch.functions.outbound import reference_id
from tillwatch.operators import audit, execution, guardrails
from tillwatch.operators.dedup import first_deliveries
from tillwatch.sources import audit_log, dimensions, payloads, reports
from tillwatch.sources.failures import read_failures


def signals(spark, *bodies):
    df = spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b),) for b in bodies], "payload string")
    return payloads.parse_signals(df).collect()


GOOD = {"code": "GATEWAY_ERROR", "description": "d", "source": "bank", "step": "payment_capture", "reason": "r"}


def test_signal_shapes_and_quarantine(spark):
    webhook = {f"error_{k}": v for k, v in GOOD.items()}
    rows = signals(
        spark, GOOD, webhook, {**GOOD, "error_code": "SERVER_ERROR", "metadata": {"order_id": "o"}}, {**GOOD, "reason": ""},
        {**GOOD, "step": "nowhere"}, {k: v for k, v in GOOD.items() if k != "source"}, "not json",
    )
    assert [r.problem for r in rows] == [None, None, None, "empty reason", "unknown step", "missing source", rows[-1].problem]
    assert rows[-1].problem in ("not an object", "missing code")
    assert rows[0].code == rows[1].code == rows[2].code == "GATEWAY_ERROR" and rows[2].metadata == {"order_id": "o"}


def test_downtime_snapshot(spark):
    body = {"id": "d", "method": "netbanking", "begin": 1591946222, "end": None, "status": "started", "scheduled": True, "severity": "low",
            "instrument": {"bank": "HDFC"}, "created_at": 1591946222, "updated_at": 1591946222}
    rows = payloads.parse_downtimes(spark.createDataFrame([(json.dumps(body),), (json.dumps({**body, "method": "wallet"}),)], "payload string")).collect()
    assert rows[0].begin == dt.datetime(2020, 6, 12, 7, 17, 2) and rows[0].bank == "HDFC" and rows[0].end is None
    assert rows[0].problem is None and rows[1].problem == "unsupported method"


def test_reason_dimension_checks(spark, tmp_path):
    path = str(tmp_path / "reasons.csv")
    with open(path, "w", encoding="utf-8") as handle:
        handle.write('row_index,reason,explanation,next_steps\n0,a,"first, text",do\n1,,skip,skip\n2,a,second,do\n')
    df = dimensions.load_reasons(spark, path, expected_rows=2)
    assert dimensions.first_row_per_reason(df).first().explanation == "first, text"
    with pytest.raises(ValueError, match="expected 114"):
        dimensions.load_reasons(spark, path)
    blank = str(tmp_path / "blank")
    spark.createDataFrame([(0, "a", None, "x")], schemas.REASONS).write.parquet(blank)
    with pytest.raises(ValueError, match="lack an explanation"):
        dimensions.load_reasons(spark, blank, 1)


def test_external_answers_last_entry_wins(spark, tmp_path):
    entry = {"reason": "r", "remediation_class": "wait", "confidence": "low", "rationale": "one"}
    path = tmp_path / "answers.json"
    path.write_text(json.dumps({"ambiguous_reason_results": [entry, {**entry, "rationale": "two"}]}, indent=1))
    assert [r.rationale for r in dimensions.load_external_answers(spark, str(path)).collect()] == ["two"]


def test_failure_scan_checks_schema(spark, failures, tmp_path):
    path = str(tmp_path / "failures")
    failures.withColumn("attempt_number", F.col("attempt_number").cast("int")).write.parquet(path)
    assert read_failures(spark, path).count() == failures.count()
    bad = str(tmp_path / "bad")
    failures.withColumn("amount", F.col("amount").cast("string")).write.parquet(bad)
    with pytest.raises(ValueError, match="amount"):
        read_failures(spark, bad)


def test_dedup_repeat_does_not_extend_ttl(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [("e", start + dt.timedelta(hours=h), str(h)) for h in (0, 23, 24, 30, 47, 48)]
    df = spark.createDataFrame(rows, "event_id string, received_at timestamp_ntz, delivery_id string")
    for hot in (1000, 2):
        kept = sorted(int(r.delivery_id) for r in first_deliveries(df, hot_rows=hot).collect())
        assert kept == [0, 24, 48]


@pytest.fixture(scope="module")
def rows(failures, diagnoses):
    decided = guardrails.decide_batch(failures, diagnoses)
    return audit.audit_rows(execution.execution_records(decided), failures, diagnoses, "2026-01-01T00:00:00Z").cache()


@pytest.fixture(scope="module")
def log(rows):
    return audit.build_chain(rows, shards_per_day=8).cache()


def test_chain_is_valid_and_bounded(rows, log):
    checks = audit.verify_chains(log).collect()
    assert all(c.valid for c in checks) and sum(c.n_records for c in checks) == rows.count()
    assert log.filter("sequence = 0 and prev_hash is not null").count() == 0


def first_break(log, chain, change):
    return audit.verify_chains(change(log.filter(F.col("chain_id") == chain))).first()


def test_tampering_is_found(log):
    chain = log.groupBy("chain_id").count().orderBy(F.desc("count")).first().chain_id
    altered = first_break(log, chain, lambda c: c.withColumn("amount", F.when(F.col("sequence") == 3, F.col("amount") + 1).otherwise(F.col("amount"))))
    assert (altered.valid, altered.first_broken_sequence, altered.detail) == (False, 3, "altered content")
    deleted = first_break(log, chain, lambda c: c.filter("sequence <> 5"))
    assert (deleted.first_broken_sequence, deleted.detail) == (6, "broken link")
    nested = first_break(log, chain, lambda c: c.withColumn("guardrail_evaluations", F.when(F.col("sequence") == 2, F.slice("guardrail_evaluations", 1, 6)).otherwise(F.col("guardrail_evaluations"))))
    assert nested.first_broken_sequence == 2


def test_append_resumes_chains_and_lookup(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    early, late = rows.filter("hour(created_at) < 12"), rows.filter("hour(created_at) >= 12")
    audit_log.append_audit(early, path, batch_id="one")
    audit_log.append_audit(late, path, batch_id="two")
    audit_log.append_audit(late, path, batch_id="two")
    stored = audit_log.read_audit(spark, path)
    checks = audit.verify_chains(stored).collect()
    assert all(c.valid for c in checks) and stored.count() == rows.count()
    both = stored.groupBy("chain_id").agg(F.min("sequence").alias("a"), F.max("sequence").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 for r in both)
    one = rows.first().payment_id
    assert [r.payment_id for r in audit.records_for_payment(stored, one).collect()] == [one]
    day = rows.first().chain_day
    plan = audit.records_for_payment(stored, one, day)._jdf.queryExecution().executedPlan().toString()
    assert "(chain_day" in plan.split("PartitionFilters: [")[1].split("]")[0] and [r.payment_id for r in audit.records_for_payment(stored, one, day).collect()] == [one]
    with pytest.raises(Exception, match="no audit record"):
        audit.records_for_payment(stored, "pay_missing").collect()
    at_once = {r.payment_id: r.chain_id for r in audit.build_chain(rows).select("payment_id", "chain_id").collect()}
    assert {r.payment_id: r.chain_id for r in stored.select("payment_id", "chain_id").collect()} == at_once


def test_json_export_round_trip(spark, log, tmp_path):
    path = str(tmp_path / "json")
    audit_log.export_audit_json(log, path)
    back = audit_log.read_audit_json(spark, path, log.schema)
    assert back.count() == log.count() and all(c.valid for c in audit.verify_chains(back).collect())


def test_replays_are_not_sent_again(failures, diagnoses):
    requests = execution.outbound_requests(guardrails.decide_batch(failures, diagnoses)).cache()
    sent = failures.filter("hour(created_at) < 12").select(reference_id(F.col("payment_id")).alias("reference_id"))
    fresh, again = execution.split_replays(requests, sent)
    assert fresh.count() + again.count() == requests.count() and again.count() > 0
    assert execution.reference_id_check(failures).first().collision_free
    assert requests.select(F.max(F.length("reference_id"))).first()[0] == 40


def test_report_sink(spark, tmp_path):
    table = spark.sql("select 'a' k, cast(null as int) n")
    reports.write_report({"one": table}, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r" / "one")).first().value == '{"k":"a","n":null}'


def python_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        line = levels[-1]
        levels.append([hashlib.sha256((line[i] + line[i + 1]).encode()).hexdigest() if i + 1 < len(line) else line[i] for i in range(0, len(line), 2)])
    return levels


def test_hash_tree_equals_a_plain_one_and_proves_its_leaves(spark):
    rows = [(f"c{n}", i, hashlib.sha256(f"{n}-{i}".encode()).hexdigest()) for n in (1, 2, 3, 8, 9, 37) for i in range(n)]
    leaves = spark.createDataFrame(rows, "chain_id string, sequence long, leaf string")
    tree = audit.hash_tree(leaves, levels=2).cache()
    roots = {r.chain_id: (r.n_records, r.root) for r in audit.tree_roots(tree).collect()}
    assert roots == {f"c{n}": (n, python_tree([x for c, _, x in rows if c == f"c{n}"])[-1][0]) for n in (1, 2, 3, 8, 9, 37)}
    wanted = leaves.select("chain_id", F.col("sequence").alias("position"))
    proofs = audit.inclusion_proofs(tree, wanted).withColumn("root", audit.proven_root(F.col("leaf"), F.col("siblings"))).collect()
    assert len(proofs) == len(rows) and all(p.root == roots[p.chain_id][1] for p in proofs)
    assert max(len(p.siblings) for p in proofs) == 6
    assert audit.tree_roots(audit.hash_tree(leaves.limit(0))).count() == 0


def test_old_tampering_is_found_by_the_root_and_new_by_the_increment(log):
    chain = log.groupBy("chain_id").count().orderBy(F.desc("count")).first().chain_id
    own = log.where(F.col("chain_id") == chain).cache()
    known, verified = audit.tree_roots(audit.hash_tree(audit.record_leaves(own))).first().root, audit.chain_tips(own.where("sequence < 6"))
    change = lambda at: own.withColumn("amount", F.when(F.col("sequence") == at, F.col("amount") + 1).otherwise(F.col("amount")))
    assert audit.verify_since(own, verified).first().valid
    assert audit.verify_since(change(2), verified).first().valid
    assert audit.tree_roots(audit.hash_tree(audit.record_leaves(change(2)))).first().root != known
    assert audit.verify_since(change(7), verified).first().first_broken_sequence == 7
    gap = audit.verify_since(own.where("sequence <> 6"), verified).first()
    assert (gap.first_broken_sequence, gap.detail) == (7, "broken link")


def test_stream_appends_once_over_restarts_and_lost_commits(spark, rows, tmp_path):
    """Batches resume from the tip index; a batch whose tips were lost is written anew, one that is there is left alone."""
    source, path, state = (str(tmp_path / name) for name in ("in", "log", "state"))
    parts = [rows.where(F.pmod(F.xxhash64("payment_id"), F.lit(19)) == k) for k in range(19)]

    def run(part):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        audit_log.append_stream(stream, path, state, 4).trigger(availableNow=True).start().awaitTermination()

    for part in parts[:2]:
        run(part)
    before = audit_log.read_audit(spark, path).count()
    shutil.rmtree(f"{path}/tips/epoch=0/batch_no=1")
    for commit in ("1", ".1.crc"):
        Path(f"{state}/commits/{commit}").unlink(missing_ok=True)
    assert audit_log.read_audit(spark, path).count() == parts[0].count()
    run(rows.limit(0))
    assert audit_log.read_audit(spark, path).count() == before
    audit_log.append_audit(parts[1], path, 4, f"{state}#1")
    for k, part in enumerate(parts[2:]):
        audit_log.append_audit(part, path, 4, f"more-{k}")
    stored = audit_log.read_audit(spark, path).cache()
    assert stored.count() == rows.count() == stored.select("payment_id").distinct().count()
    assert all(c.valid for c in audit.verify_chains(stored).collect())
    index = audit_log.current_tips(spark, path)
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, audit.chain_tips(stored).collect()))
    assert Path(f"{path}/tips/epoch=1").exists()


def test_failures_are_dealt_out_from_a_file_of_one_row_group(spark):
    from tillwatch.sources.failures import failures_from_tables

    rows = failures_from_tables(spark, "/root/testdata/sf0.001").select("description")
    assert "RepartitionByExpression [event_id" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_kept_error_codes_spare_the_join_and_verification_hashes_before_it(spark, failures, diagnoses):
    from tillwatch.operators import audit, execution, guardrails

    decided = execution.execution_records(guardrails.decide_batch(failures, diagnoses, keep=("error_code", "error_source", "error_step")))
    log = audit.build_chain(audit.audit_rows(decided, None, diagnoses, "2026-01-01T00:00:00Z"), 2)
    checks = audit.verify_chains(log)
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("sha2(")
    assert all(r.valid for r in checks.collect())
