import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions import outcome
from tillwatch.functions import policy as P
from tillwatch.functions.policy import PolicyConfig
from tillwatch.operators import backtest, guardrails, reporting
from tillwatch.operators import diagnosis as D
from tillwatch.operators.incidents import flag_active_incidents
from tillwatch.operators.spacing import possible_intervals, prune_hot, select_spaced
from tillwatch.sources.dimensions import default_answers, default_reasons, reviewed_classes

NOON = dt.datetime(2026, 1, 1, 12)
HOUR = 3_600_000_000


def naive_spaced(times, rules):
    kept = []
    for us in sorted(times):
        if all(len(kept) < back or us - kept[-back] >= gap for back, gap in rules):
            kept.append(us)
    return kept


RULES = [(1, 4 * HOUR), (3, 24 * HOUR + 1)]


@pytest.mark.parametrize("seed", range(6))
def test_possible_intervals_contain_every_selection(seed):
    rng = random.Random(seed)
    times = sorted(rng.randrange(0, 30 * 24 * HOUR) for _ in range(rng.choice([5, 400, 5000])))
    for width in (1, 60_000_000, HOUR):
        slots = {}
        for us in times:
            slots.setdefault(us // width, []).append(us)
        first = np.array([min(v) for _, v in sorted(slots.items())])
        last = np.array([max(v) for _, v in sorted(slots.items())])
        spans = possible_intervals(first, last, RULES)
        inside = [us for us in times if any(a <= us <= b for a, b in spans)]
        assert naive_spaced(inside, RULES) == naive_spaced(times, RULES)
        if width == 1:
            assert len(set(inside)) == len(naive_spaced(times, RULES))


def test_hot_customers_take_the_pruned_path_with_equal_result(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(0, 20 * 24 * HOUR), f"p{i:06d}") for i in range(6000)]
    rows += [("calm", rng.randrange(0, 20 * 24 * HOUR), f"q{i:06d}") for i in range(40)]
    rows += [("hot", rows[0][1], "a-tie")]
    df = spark.createDataFrame(rows, "customer_id string, us long, id string")
    whole = sorted(map(tuple, select_spaced(df, ["customer_id"], RULES).collect()))
    split = sorted(map(tuple, select_spaced(df, ["customer_id"], RULES, hot_rows=500).collect()))
    assert whole == split
    assert [us for c, us, _ in whole if c == "hot"] == naive_spaced([us for c, us, _ in rows if c == "hot"], RULES)
    assert prune_hot(df.filter("customer_id = 'hot'"), ["customer_id"], RULES, 500).count() <= 500


def flagged(spark, rows):
    """Rows (payment, customer, hours after noon, amount, attempt, reason, incident)."""
    data = [(p, "o" + p, c, a, "upi", NOON + dt.timedelta(hours=h), n, "Axis Bank", r, i) for p, c, h, a, n, r, i in rows]
    return spark.createDataFrame(
        data, "payment_id string, order_id string, customer_id string, amount long, method string, created_at timestamp_ntz, "
        "attempt_number int, bank string, error_reason string, in_active_incident boolean"
    )


def finals(spark, diagnoses, rows, config=PolicyConfig()):
    out = guardrails.decide(flagged(spark, rows), diagnoses, config).collect()
    return {r.payment_id: r for r in out}


def test_chain_by_hand(spark, diagnoses):
    rows = [
        ("dup", "c1", 0, 90_000, 1, "order_already_paid", False), ("inc", "c2", 0, 90_000, 1, "incorrect_cvv", True),
        ("low", "c3", 0, 4_999, 1, "incorrect_cvv", False), ("cap", "c4", 0, 90_000, 5, "incorrect_cvv", False),
        ("ok", "c5", 0, 90_000, 1, "incorrect_cvv", False), ("night", "c6", 10, 90_000, 1, "insufficient_funds", False),
        ("back", "c7", 0, 90_000, 2, "incorrect_cvv", False), ("human", "c8", 0, 90_000, 1, "invalid_amount", True),
    ]
    got = finals(spark, diagnoses, rows)
    assert {k: v.final_action for k, v in got.items()} == {
        "dup": "reconcile", "inc": "wait_bank_recovery", "low": "no_action", "cap": "no_action", "ok": "recovery_link_now",
        "night": "recovery_link_backoff", "back": "recovery_link_backoff", "human": "escalate_human",
    }
    assert got["cap"].ladder_terminal_state == "gave_up" and got["low"].ladder_terminal_state == "no_action_other"
    assert got["night"].disallowed_method is None and got["night"].scheduled_delay_seconds == 11 * 3600.0
    assert got["back"].scheduled_delay_seconds == 6 * 3600.0
    assert [e.name for e in got["ok"].guardrail_evaluations] == K.GUARDRAILS
    assert "amount_floor" in got["low"].justification and "No guardrail intervened" in got["ok"].justification


def test_blocked_contacts_do_not_extend_cooldown(spark, diagnoses):
    rows = [(f"p{h}", "c", h, 90_000, 1, "incorrect_cvv", False) for h in (0, 3, 4)]
    got = finals(spark, diagnoses, rows)
    assert [got[p].final_action for p in ("p0", "p3", "p4")] == ["recovery_link_now", "no_action", "recovery_link_now"]


def test_contact_cap_counts_the_window_edge(spark, diagnoses):
    config = PolicyConfig(cooldown_seconds=3600, quiet_start_hour=0, quiet_end_hour=0)
    rows = [(f"p{h:02d}", "c", h, 90_000, 1, "incorrect_cvv", False) for h in (0, 1, 2, 3, 24, 25)]
    got = finals(spark, diagnoses, rows, config)
    assert [got[p].final_action for p in sorted(got)] == ["recovery_link_now"] * 3 + ["no_action", "no_action", "recovery_link_now"]


def test_hot_path_of_decisions(failures, diagnoses):
    def count(hot):
        rows = guardrails.decide_batch(failures, diagnoses, hot_rows=hot).groupBy("final_action").count().collect()
        return {r.final_action: r["count"] for r in rows}

    assert count(5) == count(1_000_000)


def test_ladder_and_actions(spark):
    df = spark.createDataFrame([(a, n) for a in K.ACTIONS for n in (0, 1, 2, 3, 9)], "base string, n int")
    for row in df.withColumn("x", P.ladder_action(F.col("base"), F.col("n"))).collect():
        expected = row.base
        if row.base in K.LADDER:
            expected = K.LADDER[min(K.LADDER.index(row.base) + max(row.n - 1, 0), 3)]
        assert row.x == expected
    with pytest.raises(Exception, match="no base action"):
        df.select(P.base_action(F.lit("nonsense"))).collect()


def test_diagnosis_table_counts(spark, diagnoses):
    assert {r.tier: r["count"] for r in diagnoses.groupBy("tier").count().collect()} == {"deterministic": 95, "llm": 15}
    assert D.drifted_rows(default_reasons(spark), reviewed_classes(spark)).isEmpty()
    shifted = default_reasons(spark).withColumn("row_index", F.col("row_index") + 1)
    assert D.drifted_rows(shifted, reviewed_classes(spark)).count() > 100
    assert D.coverage_report(reviewed_classes(spark)).agg(F.sum("n")).first()[0] == 114


def test_missing_answer_and_unknown_reason_fail(spark):
    table = D.default_reason_table(spark)
    answers = default_answers(spark).filter("reason <> 'server_error'")
    assert [r.reason for r in D.pending_answers(table, answers).collect()] == ["server_error"]
    with pytest.raises(Exception, match="no stored diagnosis"):
        D.merge_diagnoses(table, answers).collect()
    with pytest.raises(Exception, match="no diagnosis for reason"):
        D.diagnose(spark.sql("select 'made_up' error_reason"), D.default_diagnoses(spark)).collect()


def test_draw_and_probabilities(spark):
    ids = [f"pay_{i}" for i in range(50)]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", outcome.unit_draw(F.col("id"), "s").alias("d")).collect()
    for r in rows:
        assert r.d == int(hashlib.sha256(f"s:{r.id}".encode()).hexdigest()[:16], 16) / 2**64
    for level in K.LEVELS:
        assert outcome.recovery_probability("retry_same", "reconcile", level) == 0.0
    assert outcome.recovery_probability("retry_same", "recovery_link_now", "central") == pytest.approx(0.8)
    assert outcome.recovery_probability("retry_same", "switch_method", "central") == pytest.approx(0.3 + 0.35 * 0.5)
    assert outcome.recovery_probability("terminal", "wait_bank_recovery", "optimistic") == pytest.approx(0.94)


def naive_replay(rows, policy, level, config=PolicyConfig()):
    """Row-by-row replay of the whole log in time order."""
    orders, contacts = {}, {}
    totals = dict(contacts=0, attempts=0, prevented=0, processed=0)
    for r in sorted(rows, key=lambda r: (r.us, r.payment_id)):
        o = orders.setdefault(r.order_id, dict(settled=False, money=0, recovered=False, attempts=0, seen=0))
        if o["settled"]:
            continue
        totals["processed"] += 1
        gave_up = False
        if policy == "guarded":
            base = K.BASE_ACTION_BY_CLASS[r.remediation_class]
            attempt = o["attempts"] + 1
            candidate = K.LADDER[min(K.LADDER.index(base) + attempt - 1, 3)] if base in K.LADDER else base
            action, gave_up = backtest.guarded_action(
                candidate, r.is_duplicate, r.remediation_class == "terminal", r.in_active_incident, r.amount, attempt, r.hour, r.us,
                contacts.setdefault(r.customer_id, []), config)
            if action in K.CHASE_ACTIONS:
                contacts[r.customer_id].append(r.us)
            totals["prevented"] += candidate in K.LADDER and action not in K.LADDER
        elif policy == "do_nothing":
            action = "no_action"
        else:
            action = "recovery_link_now" if policy == "notify_all" or o["seen"] == 0 else "no_action"
        o["seen"] += 1
        totals["contacts"] += action in K.CHASE_ACTIONS
        if action in K.LADDER:
            totals["attempts"] += 1
            o["attempts"] += 1
        if r.draw < outcome.recovery_probability(r.remediation_class, action, level):
            o.update(settled=True, recovered=True, money=r.amount)
        elif gave_up or (policy == "guarded" and action == "reconcile"):
            o["settled"] = True
    return dict(orders=len(orders), recovered=sum(o["recovered"] for o in orders.values()), money=sum(o["money"] for o in orders.values()), **totals)


def test_backtest_matches_row_by_row_replay(failures, diagnoses):
    flags = flag_active_incidents(failures)
    rows = backtest.replay_rows(flags, diagnoses).collect()
    outcomes = backtest.policy_outcomes(flags, diagnoses).collect()
    assert len(outcomes) == 12
    for o in outcomes:
        naive = naive_replay(rows, o.policy, o.level)
        assert (o.orders_total, o.orders_recovered, o.money_recovered_paise, o.contacts_sent, o.attempts_made,
                o.guardrail_prevented_contacts, o.raw_events_processed) == (
            naive["orders"], naive["recovered"], naive["money"], naive["contacts"], naive["attempts"], naive["prevented"], naive["processed"])


def test_opportunity_cost_and_bands(failures, diagnoses):
    flags = flag_active_incidents(failures)
    log = backtest.guarded_log(backtest.replay_rows(flags, diagnoses)).cache()
    cost = {r.level: r for r in backtest.opportunity_cost(log).collect()}
    for level in K.LEVELS:
        rows = [r for r in log.collect() if r.level == level]
        blocked = [r for r in rows if r.candidate_action in K.LADDER and r.final_action not in K.LADDER]
        would = [r for r in blocked if r.draw < outcome.recovery_probability(r.remediation_class, r.candidate_action, level)]
        lost = {r.order_id for r in would} - {r.order_id for r in rows if r.recovered}
        assert (cost[level].blocked, cost[level].would_have_recovered, cost[level].orders_never_recovered) == (len(blocked), len(would), len(lost))


def test_band_findings_null_costs(spark):
    rows = [("guarded", "central", 5.0, None), ("do_nothing", "central", 4.0, None), ("notify_all", "central", 6.0, 0.5), ("notify_all_once", "central", 0.0, None)]
    df = spark.createDataFrame(rows, "policy string, level string, money_recovered_rupees double, contacts_per_rupee double")
    row = backtest.band_findings(df).first()
    assert row.beats_do_nothing and not row.recovers_at_least_notify_all
    assert not row.cheaper_than_notify_all and row.cheaper_than_notify_all_once


def test_summaries_on_empty_input(failures, diagnoses):
    nothing = guardrails.decide_batch(failures.filter("false"), diagnoses)
    assert reporting.over_contact(nothing).first().reduction_rate == 0.0
    assert {r.final_count for r in reporting.action_distribution(nothing).collect()} == {0}


def test_decisions_read_stored_candidates(failures, diagnoses):
    assert not any("events" in path for path in guardrails.decide_batch(failures, diagnoses).inputFiles())


def test_examples_are_picked_without_their_rows(failures, diagnoses):
    plan = reporting.example_decisions(guardrails.decide_batch(failures, diagnoses))._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan
