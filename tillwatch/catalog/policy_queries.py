"""Diagnosis, decisions, outcomes and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.catalog.base import query, rounded, sql_rounded, stamp
from tillwatch.catalog.incident_queries import ACTIVE, ACTIVE_JOIN, FV
from tillwatch.catalog.sql_views import case_of, quoted, reason_rows_cte, sql_list
from tillwatch.functions.outcome import score_recovery, unit_draw
from tillwatch.functions.policy import PolicyConfig, base_action, ladder_action
from tillwatch.functions.prompts import reason_evidence
from tillwatch.functions.timegrid import micros
from tillwatch.operators import backtest, guardrails, reporting
from tillwatch.operators import diagnosis as D
from tillwatch.operators.incidents import flag_active_incidents
from tillwatch.session import stored
from tillwatch.sources.dimensions import default_answers, default_reasons, first_row_per_reason, reviewed_classes
from tillwatch.sources.failures import failures_from_tables

ANSWER_ROWS = K.EXTERNAL_ANSWER_TABLE
DIAG = f"""{reason_rows_cte()},
answers(reason, remediation_class, confidence, rationale) AS (SELECT * FROM (VALUES {', '.join(
    f"({quoted(r)}, {quoted(c)}, {quoted(f)}, {quoted('stored answer for ' + r)})" for r, c, f in ANSWER_ROWS)}) v),
rt AS (SELECT reason, bool_and(len(candidate_classes) = 1 AND note IS NULL) AND count(DISTINCT candidate_classes[1]) = 1 AS settled,
  min(candidate_classes[1]) AS cls, count(*) AS n_rows FROM reason_rows GROUP BY 1),
diag AS (SELECT reason, 'deterministic' AS tier, cls AS remediation_class, 'high' AS confidence, NULL::VARCHAR AS rationale FROM rt WHERE settled
  UNION ALL SELECT rt.reason, 'llm', a.remediation_class, a.confidence, a.rationale FROM rt JOIN answers a USING (reason) WHERE NOT settled)"""
DF = f"{FV}, {DIAG}"
CHASE, EFFORT = sql_list(K.CHASE_ACTIONS), sql_list(K.LADDER)
CAND = f"""
c0 AS (SELECT f.*, d.tier, d.remediation_class, d.confidence, d.rationale, {case_of(K.BASE_ACTION_BY_CLASS, 'd.remediation_class')} AS base_action
  FROM failures f JOIN diag d ON d.reason = f.error_reason),
c1 AS (SELECT *, CASE WHEN list_position([{EFFORT}], base_action) > 0 THEN
  ([{EFFORT}])[least(list_position([{EFFORT}], base_action) + greatest(attempt_number - 1, 0), 4)] ELSE base_action END AS candidate_action FROM c0)"""
CHAIN = f"""
fl AS (SELECT f.*, inc.incident_no IS NOT NULL AS in_active_incident FROM c1 f {ACTIVE_JOIN}),
k1 AS (SELECT *, (error_reason IN ({sql_list(K.RECONCILE_REASONS)}) AND candidate_action IN ({EFFORT}))
  OR (error_reason NOT IN ({sql_list(K.RECONCILE_REASONS)}) AND remediation_class = 'terminal' AND candidate_action <> 'no_action') AS b1 FROM fl),
k1a AS (SELECT *, CASE WHEN NOT b1 THEN candidate_action WHEN error_reason IN ({sql_list(K.RECONCILE_REASONS)}) THEN 'reconcile' ELSE 'no_action' END AS a1 FROM k1),
k2 AS (SELECT *, in_active_incident AND a1 IN ({CHASE}) AS b2 FROM k1a),
k2a AS (SELECT *, CASE WHEN b2 THEN 'wait_bank_recovery' ELSE a1 END AS a2 FROM k2),
k3 AS (SELECT *, amount < 5000 AND a2 IN ({EFFORT}) AS b3 FROM k2a),
k3a AS (SELECT *, CASE WHEN b3 THEN 'no_action' ELSE a2 END AS a3 FROM k3),
k4 AS (SELECT *, attempt_number > 4 AND a3 IN ({EFFORT}) AS b4 FROM k3a),
k4a AS (SELECT *, CASE WHEN b4 THEN 'no_action' ELSE a4_in END AS a4 FROM (SELECT *, a3 AS a4_in FROM k4)),
rq AS (SELECT customer_id, us, min(payment_id) AS pid FROM k4a WHERE a4 IN ({CHASE}) GROUP BY ALL),
kl AS (SELECT customer_id, list_reduce(list(us ORDER BY us), lambda acc, x: CASE
    WHEN (len(acc) = 0 OR x - acc[len(acc)] >= 14400000000) AND (len(acc) < 3 OR x - acc[len(acc) - 2] >= 86400000001)
    THEN list_append(acc, x) ELSE acc END, []::BIGINT[]) AS kept FROM rq GROUP BY 1),
ku AS (SELECT customer_id, unnest(kept) AS us FROM kl),
log AS (SELECT ku.customer_id, ku.us, rq.pid FROM ku JOIN rq USING (customer_id, us)),
st AS (SELECT k.payment_id, count(l.us) FILTER (l.us >= k.us - 86400000000) AS contacts_in_window, max(l.us) AS last_us FROM k4a k LEFT JOIN log l ON l.customer_id = k.customer_id
  AND (l.us < k.us OR (l.us = k.us AND l.pid < k.payment_id)) GROUP BY 1),
k5 AS (SELECT k.*, contacts_in_window, (us - last_us) / 1000000.0 AS since, contacts_in_window >= 3 AND a4 IN ({CHASE}) AS b5 FROM k4a k JOIN st USING (payment_id)),
k5a AS (SELECT *, CASE WHEN b5 THEN 'no_action' ELSE a4 END AS a5 FROM k5),
k6 AS (SELECT *, coalesce(since < 14400, false) AND a5 IN ({CHASE}) AS b6 FROM k5a),
k6a AS (SELECT *, CASE WHEN b6 THEN 'no_action' ELSE a5 END AS a6 FROM k6),
k7 AS (SELECT *, (hour(created_at) >= 21 OR hour(created_at) < 9) AND a6 IN ('recovery_link_now', 'switch_method') AS b7 FROM k6a),
dec AS (SELECT *, CASE WHEN b7 THEN 'recovery_link_backoff' ELSE a6 END AS final_action FROM k7),
dd AS (SELECT *, CASE final_action WHEN 'recovery_link_now' THEN 'in_progress_link_now' WHEN 'recovery_link_backoff' THEN 'in_progress_backoff'
    WHEN 'switch_method' THEN 'in_progress_switch_method' WHEN 'escalate_human' THEN 'escalated_to_human' WHEN 'reconcile' THEN 'reconciled'
    WHEN 'wait_bank_recovery' THEN 'waiting_on_bank' ELSE CASE WHEN b4 THEN 'gave_up' ELSE 'no_action_other' END END AS ladder_terminal_state,
  CASE WHEN final_action = 'recovery_link_backoff' THEN CASE WHEN b7 THEN
      (epoch_us(date_trunc('day', created_at)) + 32400000000 + CASE WHEN hour(created_at) < 9 THEN 0 ELSE 86400000000 END - us) / 1000000.0
    ELSE greatest(attempt_number, 1) * 10800.0 END END AS scheduled_delay_seconds,
  CASE WHEN final_action = 'switch_method' THEN method END AS disallowed_method FROM dec)"""
DECIDED = f"{DF}, {ACTIVE}, {CAND}, {CHAIN}"
ACTIONS = ["candidate_action", "a1", "a2", "a3", "a4", "a5", "a6", "final_action"]


def decisions(spark, sf):
    return guardrails.decide_batch(failures_from_tables(spark, sf), D.default_diagnoses(spark))


# --- diagnosis --------------------------------------------------------------------------------


@query("reason_table_usage", (
    f"{DF} SELECT rt.reason, CASE WHEN settled THEN cls END AS remediation_class, NOT settled AS is_escalated, "
    "CASE WHEN NOT settled THEN n_rows END AS n_contexts, (SELECT count(*) FROM failures f WHERE f.error_reason = rt.reason) AS n_failures FROM rt"
))
def reason_table_usage(spark, sf):
    counts = failures_from_tables(spark, sf).groupBy(F.col("error_reason").alias("reason")).agg(F.count("*").alias("n_failures"))
    return D.default_reason_table(spark).join(counts, "reason", "left").select(
        "reason", "remediation_class", "is_escalated", F.when(F.col("is_escalated"), F.size("contexts").cast("bigint")).alias("n_contexts"),
        F.coalesce("n_failures", F.lit(0)).alias("n_failures"),
    )


@query("class_coverage", (
    f"{DF}, rc AS (SELECT CASE WHEN len(candidate_classes) = 1 AND note IS NULL THEN candidate_classes[1] END AS cls, reason FROM reason_rows), "
    f"cl AS (SELECT unnest([{sql_list(K.REMEDIATION_CLASSES)}]) AS cls UNION ALL SELECT NULL), "
    "fc AS (SELECT error_reason, count(*) AS n FROM failures GROUP BY 1) "
    "SELECT cl.cls AS remediation_class, count(rc.reason) AS n_rows, coalesce(sum(fc.n), 0)::BIGINT AS n_failures FROM cl "
    "LEFT JOIN rc ON rc.cls IS NOT DISTINCT FROM cl.cls LEFT JOIN fc ON fc.error_reason = rc.reason GROUP BY 1"
))
def class_coverage(spark, sf):
    counts = failures_from_tables(spark, sf).groupBy(F.col("error_reason").alias("reason")).agg(F.count("*").alias("f"))
    covered = D.coverage_report(reviewed_classes(spark))
    exploded = covered.select("remediation_class", "n", F.explode_outer("reasons").alias("reason"))
    return exploded.join(counts, "reason", "left").groupBy("remediation_class").agg(
        F.max("n").cast("bigint").alias("n_rows"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_failures")
    )


@query("first_failure_per_reason", (
    f"{FV} SELECT error_reason AS reason, arg_min(payment_id, (us, payment_id)) AS payment_id FROM failures GROUP BY 1"
))
def first_failure_per_reason(spark, sf):
    f = failures_from_tables(spark, sf)
    rows = f.select(F.col("error_reason").alias("reason"), F.struct(micros(F.col("created_at")), "payment_id").alias("row_index"), "payment_id")
    return first_row_per_reason(rows).select("reason", "payment_id")


@query("diagnosed_failures", f"{DF} SELECT payment_id, d.tier, d.remediation_class, d.confidence, d.rationale FROM failures f JOIN diag d ON d.reason = f.error_reason")
def diagnosed_failures(spark, sf):
    rows = D.diagnose(failures_from_tables(spark, sf), D.default_diagnoses(spark))
    return rows.select("payment_id", F.col("diagnosis_tier").alias("tier"), "remediation_class",
                       F.col("diagnosis_confidence").alias("confidence"), F.col("diagnosis_rationale").alias("rationale"))


@query("merged_diagnoses", f"{DF} SELECT d.*, (SELECT count(*) FROM failures f WHERE f.error_reason = d.reason) AS n_failures FROM diag d")
def merged_diagnoses(spark, sf):
    counts = failures_from_tables(spark, sf).groupBy(F.col("error_reason").alias("reason")).agg(F.count("*").alias("n_failures"))
    return D.default_diagnoses(spark).join(counts, "reason", "left").withColumn("n_failures", F.coalesce("n_failures", F.lit(0)))


PARTIAL = "remediation_class <> 'customer_fix'"


@query("pending_external_calls", (
    f"{DF} SELECT rt.reason, n_rows AS n_contexts FROM rt WHERE NOT settled AND reason NOT IN (SELECT reason FROM answers WHERE {PARTIAL}) "
    "AND reason IN (SELECT error_reason FROM failures)"
))
def pending_external_calls(spark, sf):
    pending = D.pending_calls(failures_from_tables(spark, sf), D.default_reason_table(spark), default_answers(spark).filter(PARTIAL))
    return pending.select("reason", F.size("contexts").cast("bigint").alias("n_contexts"))


@query("reason_evidence", (
    f"{DF}, x AS (SELECT reason, row_number() OVER (PARTITION BY reason ORDER BY row_index) AS i, explanation, next_steps, candidate_classes, note FROM reason_rows "
    "WHERE reason IN (SELECT reason FROM rt WHERE NOT settled) AND reason IN (SELECT error_reason FROM failures)) "
    "SELECT reason, 'Reason: ' || reason || chr(10) || string_agg('Row ' || i || ' explanation: ' || explanation || chr(10) || 'Row ' || i || ' next steps: ' || next_steps "
    "|| chr(10) || 'Row ' || i || ' candidates: ' || array_to_string(candidate_classes, ', ') || coalesce(chr(10) || 'Note: ' || note, ''), chr(10) ORDER BY i) "
    f"|| chr(10) || 'Classes: {', '.join(sorted(K.REMEDIATION_CLASSES))}' AS evidence FROM x GROUP BY reason"
))
def reason_evidence_query(spark, sf):
    nothing = default_answers(spark).filter("false")
    pending = D.pending_calls(failures_from_tables(spark, sf), D.reason_table(default_reasons(spark), reviewed_classes(spark)), nothing)
    return pending.select("reason", reason_evidence().alias("evidence"))


@query("routing_stats", (
    f"{DF}, r AS (SELECT error_reason, tier, count(*) AS n FROM failures f JOIN diag d ON d.reason = f.error_reason GROUP BY ALL) "
    "SELECT sum(n)::BIGINT AS total_events, sum(n) FILTER (tier <> 'llm')::BIGINT AS deterministic_events, sum(n) FILTER (tier = 'llm')::BIGINT AS external_events, "
    "count(*) AS distinct_reasons_seen, count(*) FILTER (tier = 'llm') AS external_calls_made, "
    "string_agg(error_reason, ',' ORDER BY error_reason) FILTER (tier = 'llm') AS escalated_reasons, "
    "round(sum(n) FILTER (tier <> 'llm') / sum(n)::DOUBLE, 6) AS deterministic_fraction, round(sum(n) FILTER (tier = 'llm') / sum(n)::DOUBLE, 6) AS external_fraction FROM r"
))
def routing_stats(spark, sf):
    stats = D.routing_stats(failures_from_tables(spark, sf), D.default_diagnoses(spark))
    return stats.withColumn("escalated_reasons", F.array_join("escalated_reasons", ",")).withColumns(
        {c: F.round(c, 6) for c in ("deterministic_fraction", "external_fraction")}
    )


# --- decisions --------------------------------------------------------------------------------


@query("ladder_candidates", f"{DF}, {CAND} SELECT remediation_class, attempt_number::BIGINT AS attempt_number, base_action, candidate_action, count(*) AS n FROM c1 GROUP BY ALL")
def ladder_candidates(spark, sf):
    rows = D.diagnose(failures_from_tables(spark, sf), D.default_diagnoses(spark))
    rows = rows.withColumn("base_action", base_action(F.col("remediation_class")))
    rows = rows.withColumn("candidate_action", ladder_action(F.col("base_action"), F.col("attempt_number")))
    return rows.groupBy("remediation_class", F.col("attempt_number").cast("bigint").alias("attempt_number"), "base_action", "candidate_action").agg(F.count("*").alias("n"))


EVALS = " || ';' || ".join(
    f"'{name}:' || b{i} || ':' || {ACTIONS[i - 1]} || '>' || {ACTIONS[i]}" for i, name in enumerate(K.GUARDRAILS, start=1)
)


@query("decisions", (
    f"{DECIDED} SELECT payment_id, base_action, candidate_action, {EVALS} AS evaluations, in_active_incident, final_action, "
    "ladder_terminal_state, round(scheduled_delay_seconds::DOUBLE, 3) AS scheduled_delay_seconds, disallowed_method FROM dd"
))
def decisions_query(spark, sf):
    text = F.array_join(F.transform("guardrail_evaluations", lambda e: F.concat(
        e["name"], F.lit(":"), e["blocked"].cast("string"), F.lit(":"), e["action_before"], F.lit(">"), e["action_after"])), ";")
    return decisions(spark, sf).select(
        "payment_id", "base_action", "candidate_action", text.alias("evaluations"), "in_active_incident", "final_action",
        "ladder_terminal_state", F.round("scheduled_delay_seconds", 3).alias("scheduled_delay_seconds"), "disallowed_method",
    )


WHY = {
    1: f"CASE WHEN error_reason IN ({sql_list(K.RECONCILE_REASONS)}) THEN 'the payment is a duplicate or already paid and needs reconciling' ELSE 'the class is terminal' END",
    2: "'the method and bank are inside a detected incident'",
    3: "'amount ' || amount || ' is below 5000 paise'",
    4: "'attempt ' || attempt_number || ' exceeds the cap of 4'",
    5: "'the customer already had ' || contacts_in_window || ' contacts in the window, cap 3'",
    6: "'the last contact was ' || floor(since)::BIGINT || ' s ago, cooldown 14400 s'",
    7: "'hour ' || hour(created_at) || ' is within quiet hours'",
}
FIRED = " || ".join(
    f"CASE WHEN b{i} THEN ' {name}: ' || {ACTIONS[i - 1]} || ' -> ' || {ACTIONS[i]} || ' because ' || {WHY[i]} || '.' ELSE '' END"
    for i, name in enumerate(K.GUARDRAILS, start=1)
)


@query("decision_justifications", (
    f"{DECIDED} SELECT payment_id, 'Reason ' || error_reason || ' (' || tier || ') maps to class ' || remediation_class || ', base action ' || base_action "
    f"|| '. Ladder candidate: ' || candidate_action || '.' || CASE WHEN {' OR '.join(f'b{i}' for i in range(1, 8))} THEN {FIRED} ELSE ' No guardrail intervened.' END "
    "|| ' Final: ' || final_action || '.' AS justification FROM dd"
))
def decision_justifications(spark, sf):
    return decisions(spark, sf).select("payment_id", "justification")


@query("contact_log", f"{DECIDED} SELECT customer_id, us, pid AS id FROM log")
def contact_log(spark, sf):
    f = flag_active_incidents(failures_from_tables(spark, sf))
    config = PolicyConfig()
    rows = guardrails.candidates(f, D.default_diagnoses(spark), config)
    return guardrails.accepted_contacts(rows.filter(F.col("_a4").isin(K.CHASE_ACTIONS)), config)


@query("contact_history", f"{DECIDED} SELECT payment_id, contacts_in_window, round(since::DOUBLE, 3) AS seconds_since_last_contact FROM k5")
def contact_history(spark, sf):
    f = flag_active_incidents(failures_from_tables(spark, sf))
    config = PolicyConfig()
    rows = guardrails.candidates(f, D.default_diagnoses(spark), config)
    log = guardrails.accepted_contacts(rows.filter(F.col("_a4").isin(K.CHASE_ACTIONS)), config)
    return guardrails.with_contact_stats(rows, log, config).select(
        "payment_id", F.col("contacts_in_window").cast("bigint").alias("contacts_in_window"),
        F.round("seconds_since_last_contact", 3).alias("seconds_since_last_contact"),
    )


@query("action_distribution", (
    f"{DECIDED} SELECT action, (SELECT count(*) FROM dd WHERE candidate_action = action) AS candidate_count, "
    f"(SELECT count(*) FROM dd WHERE final_action = action) AS final_count FROM (SELECT unnest([{sql_list(K.ACTIONS)}]) AS action)"
))
def action_distribution(spark, sf):
    return reporting.action_distribution(decisions(spark, sf))


FIRES = " UNION ALL ".join(
    f"SELECT '{name}' AS name, {i}::BIGINT AS position, b{i} AS b, {ACTIONS[i - 1]} || '->' || {ACTIONS[i]} AS t FROM dd"
    for i, name in enumerate(K.GUARDRAILS, start=1)
)


@query("guardrail_fires", (
    f"{DECIDED}, e AS ({FIRES}), t AS (SELECT name, t, count(*) AS n FROM e WHERE b GROUP BY ALL) "
    "SELECT name, position, count(*) FILTER (b) AS fired, count(*) FILTER (NOT b) AS passed, "
    "coalesce((SELECT string_agg(t || '=' || n, ',' ORDER BY t) FROM t WHERE t.name = e.name), '') AS overrides FROM e GROUP BY name, position"
))
def guardrail_fires(spark, sf):
    text = F.array_join(F.transform(F.map_entries("overrides"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return reporting.guardrail_fires(decisions(spark, sf)).select(
        "name", F.col("position").cast("bigint").alias("position"), "fired", "passed", text.alias("overrides")
    )


@query("over_contact", (
    f"{DECIDED}, o AS (SELECT count(*) FILTER (candidate_action IN ({CHASE})) AS a, count(*) FILTER (final_action IN ({CHASE})) AS b FROM dd) "
    "SELECT a AS contacts_without_guardrails, b AS contacts_with_guardrails, a - b AS reduction, round(coalesce((a - b) / nullif(a, 0)::DOUBLE, 0), 6) AS reduction_rate FROM o"
))
def over_contact(spark, sf):
    return reporting.over_contact(decisions(spark, sf)).withColumn("reduction_rate", F.round("reduction_rate", 6))


@query("terminal_states", f"{DECIDED} SELECT ladder_terminal_state, count(*) AS n FROM dd GROUP BY 1")
def terminal_states(spark, sf):
    return reporting.terminal_states(decisions(spark, sf))


@query("waiting_count", f"{DECIDED} SELECT count(*) AS wait_bank_recovery_count FROM dd WHERE final_action = 'wait_bank_recovery'")
def waiting_count(spark, sf):
    return reporting.waiting_count(decisions(spark, sf))


LABELS = " UNION ALL ".join(
    [f"SELECT '{name}_block' AS label, us, payment_id FROM dd WHERE b{i}" for i, name in enumerate(K.GUARDRAILS, start=1)]
    + ["SELECT 'final_action_' || final_action, us, payment_id FROM dd"]
)


@query("example_payment_ids", f"{DECIDED}, l AS ({LABELS}) SELECT label, arg_min(payment_id, (us, payment_id)) AS payment_id FROM l GROUP BY 1")
def example_payment_ids(spark, sf):
    return reporting.example_payment_ids(decisions(spark, sf))


@query("representative_sample", (
    f"{DECIDED}, l AS ({LABELS}) SELECT arg_min(payment_id, (us, payment_id)) AS payment_id FROM l GROUP BY label "
    "UNION SELECT payment_id FROM (SELECT payment_id FROM dd ORDER BY us, payment_id LIMIT 200)"
))
def representative_sample(spark, sf):
    return reporting.representative_sample(decisions(spark, sf), 200)


CLEAN = " AND ".join(f"NOT b{i}" for i in range(1, 8))
KINDS = " UNION ALL ".join(
    [f"SELECT '{name}' AS kind, us, payment_id FROM dd WHERE b{i}" for i, name in enumerate(K.GUARDRAILS, start=1)]
    + [f"SELECT 'all_guardrails_passed', us, payment_id FROM dd WHERE {CLEAN}"]
)


@query("example_decisions", (
    f"{DECIDED}, l AS ({KINDS}), m AS (SELECT kind, arg_min(payment_id, (us, payment_id)) AS payment_id FROM l GROUP BY 1) "
    "SELECT kind, payment_id, final_action, ladder_terminal_state FROM m JOIN dd USING (payment_id)"
))
def example_decisions(spark, sf):
    return reporting.example_decisions(decisions(spark, sf)).select("kind", "payment_id", "final_action", "ladder_terminal_state")


# --- outcomes ---------------------------------------------------------------------------------

MODEL = f"""
cls(remediation_class, fl_, ce_) AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {K.SELF_RECOVERY[c]}::DOUBLE, {K.ACTION_CEILING[c]}::DOUBLE)" for c in K.REMEDIATION_CLASSES)}) v),
lev(level, um, fm) AS (SELECT * FROM (VALUES {', '.join(f"('{lv}', {K.UPLIFT_MULTIPLIER[lv]}::DOUBLE, {K.FLOOR_MULTIPLIER[lv]}::DOUBLE)" for lv in K.LEVELS)}) v)"""
DRAW = f"('0x' || substr(sha256('{K.DRAW_SALT}:' || payment_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE"


def prob_sql(action: str) -> str:
    base = case_of(K.BASE_ACTION_BY_CLASS, "remediation_class")
    return (
        f"greatest(0.0, least(1.0, CASE WHEN {action} = 'reconcile' THEN 0.0 WHEN {action} = 'wait_bank_recovery' THEN 0.2::DOUBLE * fm + 0.5::DOUBLE * um "
        f"WHEN {action} = 'no_action' THEN fl_ * fm ELSE fl_ * fm + (CASE WHEN {base} = {action} THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END) * (ce_ - fl_) * um END))"
    )


@query("recovery_scores", (
    f"{DECIDED}, {MODEL} SELECT payment_id, level, round({DRAW}, 9) AS draw, round({prob_sql('final_action')}, 6) AS probability, "
    f"{DRAW} < {prob_sql('final_action')} AS recovered FROM dd JOIN cls USING (remediation_class) CROSS JOIN lev"
))
def recovery_scores(spark, sf):
    decided = stored(decisions(spark, sf).select("payment_id", "remediation_class", "final_action"))
    parts = None
    for level in K.LEVELS:
        part = score_recovery(decided, level).select(
            "payment_id", F.lit(level).alias("level"), F.round("draw", 9).alias("draw"), *rounded("probability"), "recovered"
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query("self_recovery_draws", (
    f"{DF}, {MODEL} SELECT level, d.remediation_class, count(*) AS n, count(*) FILTER ({DRAW} < fl_ * fm) AS self_recovered FROM failures f "
    "JOIN diag d ON d.reason = f.error_reason JOIN cls USING (remediation_class) CROSS JOIN lev GROUP BY ALL"
))
def self_recovery_draws(spark, sf):
    from tillwatch.functions.outcome import self_recovery_rates

    rows = D.diagnose(failures_from_tables(spark, sf), D.default_diagnoses(spark)).select(
        "remediation_class", unit_draw(F.col("payment_id")).alias("draw")
    )
    joined = rows.join(F.broadcast(self_recovery_rates(spark)), "remediation_class")
    return joined.groupBy("level", "remediation_class").agg(
        F.count("*").alias("n"), F.count_if(F.col("draw") < F.col("probability")).alias("self_recovered")
    )


def replay(spark, sf):
    return backtest.replay_rows(flag_active_incidents(failures_from_tables(spark, sf)), D.default_diagnoses(spark))


BASELINES = f"""
rr AS (SELECT level, f.order_id, us, payment_id, amount, row_number() OVER (PARTITION BY level, order_id ORDER BY us, payment_id) AS pos,
    {DRAW} < {prob_sql("'no_action'")} AS ok_floor, {DRAW} < {prob_sql("'recovery_link_now'")} AS ok_link
  FROM (SELECT f.*, d.remediation_class FROM failures f JOIN diag d ON d.reason = f.error_reason) f JOIN cls USING (remediation_class) CROSS JOIN lev),
rp AS (SELECT 'do_nothing' AS policy, *, ok_floor AS ok, 0 AS contact FROM rr UNION ALL SELECT 'notify_all', *, ok_link, 1 FROM rr
  UNION ALL SELECT 'notify_all_once', *, CASE WHEN pos = 1 THEN ok_link ELSE ok_floor END, CASE WHEN pos = 1 THEN 1 ELSE 0 END FROM rr),
rs AS (SELECT policy, level, order_id, min(pos) FILTER (ok) AS hit FROM rp GROUP BY ALL),
rx AS (SELECT rp.*, hit FROM rp JOIN rs USING (policy, level, order_id)),
ro AS (SELECT policy, level, count(DISTINCT order_id) AS orders_total, count(*) FILTER (pos = hit) AS orders_recovered,
  coalesce(sum(amount) FILTER (pos = hit), 0)::BIGINT AS money_recovered_paise, coalesce(sum(contact) FILTER (hit IS NULL OR pos <= hit), 0)::BIGINT AS contacts_sent,
  count(*) FILTER (hit IS NULL OR pos <= hit) AS raw_events_processed, count(*) AS raw_events_total FROM rx GROUP BY ALL)"""


@query("baseline_policy_outcomes", (
    f"{DF}, {MODEL}, {BASELINES} SELECT policy, level, orders_total, orders_recovered, round(orders_recovered / orders_total::DOUBLE, 6) AS recovery_rate, "
    "money_recovered_paise, contacts_sent, contacts_sent AS attempts_made, round(contacts_sent / nullif(money_recovered_paise / 100.0::DOUBLE, 0), 6) AS contacts_per_rupee, "
    "raw_events_processed, raw_events_total FROM ro"
))
def baseline_policy_outcomes(spark, sf):
    out = backtest.baseline_outcomes(replay(spark, sf))
    return out.select(
        "policy", "level", "orders_total", "orders_recovered", *rounded("recovery_rate"), "money_recovered_paise", "contacts_sent",
        "attempts_made", *rounded("contacts_per_rupee"), "raw_events_processed", "raw_events_total",
    )


@query("policy_outcomes")
def policy_outcomes(spark, sf):
    return backtest.policy_outcomes(flag_active_incidents(failures_from_tables(spark, sf)), D.default_diagnoses(spark))


@query("band_findings")
def band_findings(spark, sf):
    return backtest.band_findings(policy_outcomes(spark, sf))


@query("guardrail_opportunity_cost")
def guardrail_opportunity_cost(spark, sf):
    return backtest.opportunity_cost(backtest.guarded_log(replay(spark, sf)))


__all__ = ["CHASE", "DECIDED", "DF", "decisions", "sql_rounded", "stamp"]
