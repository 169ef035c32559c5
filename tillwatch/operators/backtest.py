"""Replay of the failure log under competing policies.

The three simple policies only look inside an order, so they are aggregates over orders. The
guarded policy also depends on the contacts its customer received on other orders and on the
attempts it made itself; its rows stream through Python sorted by customer and time, holding
one customer's open state at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions import policy as P
from tillwatch.functions.literals import lookup
from tillwatch.functions.outcome import recovery_probability, unit_draw
from tillwatch.functions.policy import PolicyConfig
from tillwatch.functions.timegrid import micros
from tillwatch.operators.diagnosis import attach_by_reason
from tillwatch.operators.scoring import ratio


def replay_rows(flagged: DataFrame, diagnoses: DataFrame, salt: str = K.DRAW_SALT) -> DataFrame:
    """Narrow rows with what any policy needs: order, moment, amount, class, flags and draw."""
    rows = attach_by_reason(flagged, diagnoses.select("reason", "tier", "remediation_class"))
    unknown = F.raise_error(F.concat(F.lit("no diagnosis for reason "), F.col("error_reason")))
    return rows.select(
        "customer_id", "order_id", "payment_id", micros(F.col("created_at")).alias("us"),
        F.hour("created_at").alias("hour"), "amount",
        F.coalesce("remediation_class", unknown.cast("string")).alias("remediation_class"),
        F.col("error_reason").isin(K.RECONCILE_REASONS).alias("is_duplicate"), "in_active_incident",
        unit_draw(F.col("payment_id"), salt).alias("draw"),
    )


def _by_class(action: str, level: str) -> Column:
    table = {cls: recovery_probability(cls, action, level) for cls in K.REMEDIATION_CLASSES}
    return lookup(table, F.col("remediation_class"))


def baseline_outcomes(rows: DataFrame) -> DataFrame:
    """Outcome of do_nothing, notify_all and notify_all_once per level.

    One pass finds where each order settles under each policy and level (smallest matching
    moment, combined map-side); a second counts the failures up to there.
    """
    at = F.struct("us", "payment_id", "amount")
    settles = []
    for level in K.LEVELS:
        settles.append(F.min(F.when(F.col("draw") < _by_class("no_action", level), at)).alias(f"floor_{level}"))
        settles.append(F.min(F.when(F.col("draw") < _by_class("recovery_link_now", level), at)).alias(f"link_{level}"))
    orders = rows.groupBy("order_id").agg(F.min(at).alias("first"), *settles)
    once = {
        level: F.when(F.col("first").eqNullSafe(F.col(f"link_{level}")), F.col("first")).otherwise(F.col(f"floor_{level}"))
        for level in K.LEVELS
    }
    settled = orders.select(
        "order_id",
        *[F.col(f"floor_{level}").alias(f"do_nothing__{level}") for level in K.LEVELS],
        *[F.col(f"link_{level}").alias(f"notify_all__{level}") for level in K.LEVELS],
        *[once[level].alias(f"notify_all_once__{level}") for level in K.LEVELS],
    )
    runs = [name for name in settled.columns if name != "order_id"]
    per_order = settled.agg(
        F.count("*").alias("orders_total"),
        *[F.count(name).alias(f"n_{name}") for name in runs],
        *[F.coalesce(F.sum(F.col(f"{name}.amount")), F.lit(0)).alias(f"m_{name}") for name in runs],
    )
    here = F.struct("us", "payment_id", "amount")
    per_row = rows.join(settled, "order_id").agg(
        F.count("*").alias("raw_events_total"),
        *[F.count_if(F.col(name).isNull() | (here <= F.col(name))).alias(f"p_{name}") for name in runs],
    )
    tables = [(per_order, "n"), (per_order, "m"), (per_row, "p")]
    longs = []
    for table, kind in tables:
        total = "orders_total" if kind == "n" else "raw_events_total" if kind == "p" else None
        entries = F.array(*[
            F.struct(
                F.lit(name.split("__")[0]).alias("policy"), F.lit(name.split("__")[1]).alias("level"),
                F.col(f"{kind}_{name}").alias(kind), *([F.col(total)] if total else []),
            ) for name in runs
        ])
        longs.append(table.select(F.inline(entries)))
    joined = reduce(lambda a, b: a.join(b, ["policy", "level"]), longs)
    contacts = (
        F.when(F.col("policy") == "do_nothing", 0).when(F.col("policy") == "notify_all", F.col("p"))
        .otherwise(F.col("orders_total"))
    )
    return _outcome_columns(joined.select(
        "policy", "level", "orders_total", F.col("n").alias("orders_recovered"), F.col("m").alias("money_recovered_paise"),
        contacts.cast("long").alias("contacts_sent"), contacts.cast("long").alias("attempts_made"),
        F.lit(0).cast("long").alias("guardrail_prevented_contacts"), F.col("p").alias("raw_events_processed"),
        "raw_events_total",
    ))


def _outcome_columns(outcome: DataFrame) -> DataFrame:
    money = F.col("money_recovered_paise") / 100
    return outcome.select(
        "policy", "level", "orders_total", "orders_recovered",
        F.coalesce(ratio(F.col("orders_recovered"), F.col("orders_total")), F.lit(0.0)).alias("recovery_rate"),
        "money_recovered_paise", money.alias("money_recovered_rupees"), "contacts_sent", "attempts_made",
        "guardrail_prevented_contacts", ratio(F.col("contacts_sent"), money).alias("contacts_per_rupee"),
        "raw_events_processed", "raw_events_total",
    )


GUARDED_LOG = (
    "level string, customer_id string, order_id string, payment_id string, amount long, "
    "remediation_class string, draw double, attempt_number int, candidate_action string, "
    "final_action string, recovered boolean"
)


def guarded_action(
    candidate: str, duplicate: bool, terminal: bool, incident: bool, amount: int, attempt: int, hour: int,
    us: int, contacts: list[int], config: PolicyConfig,
) -> tuple[str, bool]:
    """The guardrail chain on one row; also tells whether the attempt cap blocked."""
    chase, effort = candidate in K.CHASE_ACTIONS, candidate in K.LADDER
    if duplicate and effort:
        return "reconcile", False
    if terminal and not duplicate:
        return "no_action", False
    if incident and chase:
        return "wait_bank_recovery", False
    if effort and amount < config.amount_floor_paise:
        return "no_action", False
    if effort and attempt > config.attempt_cap:
        return "no_action", True
    if chase:
        window = us - config.contact_window_seconds * 1_000_000
        if sum(1 for moment in contacts if moment >= window) >= config.contact_cap:
            return "no_action", False
        if contacts and us - contacts[-1] < config.cooldown_seconds * 1_000_000:
            return "no_action", False
        start, end = config.quiet_start_hour, config.quiet_end_hour
        quiet = (hour >= start or hour < end) if start > end else start <= hour < end
        if quiet and candidate != "recovery_link_backoff":
            return "recovery_link_backoff", False
    return candidate, False


def guarded_log(rows: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Decisions of the guarded policy on every failure of a not yet settled order, per level.

    Attempts count the policy's own chase or escalate decisions on the order. An order settles
    when it recovers, when the attempt cap gives it up, or when it goes to reconciliation.
    """
    probability = {
        (level, cls, action): recovery_probability(cls, action, level)
        for level in K.LEVELS for cls in K.REMEDIATION_CLASSES for action in K.ACTIONS
    }
    ladder_from = {
        cls: K.LADDER[K.LADDER.index(base):] if base in K.LADDER else [base]
        for cls, base in K.BASE_ACTION_BY_CLASS.items()
    }

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        customer = None
        contacts: dict[str, list[int]] = {}
        attempts: dict[str, dict[str, int]] = {}
        settled: dict[str, set[str]] = {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.customer_id != customer:
                    customer = row.customer_id
                    contacts = {level: [] for level in K.LEVELS}
                    attempts = {level: {} for level in K.LEVELS}
                    settled = {level: set() for level in K.LEVELS}
                rungs = ladder_from[row.remediation_class]
                for level in K.LEVELS:
                    if row.order_id in settled[level]:
                        continue
                    attempt = attempts[level].get(row.order_id, 0) + 1
                    candidate = rungs[min(attempt, len(rungs)) - 1]
                    final, gave_up = guarded_action(
                        candidate, row.is_duplicate, row.remediation_class == "terminal", row.in_active_incident,
                        row.amount, attempt, row.hour, row.us, contacts[level], config,
                    )
                    if final in K.CHASE_ACTIONS:
                        contacts[level] = [*contacts[level], row.us][-max(config.contact_cap, 1):]
                    if final in K.LADDER:
                        attempts[level][row.order_id] = attempt
                    recovered = row.draw < probability[level, row.remediation_class, final]
                    if recovered or gave_up or final == "reconcile":
                        settled[level].add(row.order_id)
                        attempts[level].pop(row.order_id, None)
                    out.append((
                        level, row.customer_id, row.order_id, row.payment_id, row.amount, row.remediation_class,
                        row.draw, attempt, candidate, final, bool(recovered),
                    ))
            yield pd.DataFrame(out, columns=[part.split()[0] for part in GUARDED_LOG.split(", ")]).astype(
                {"attempt_number": np.int32}
            )

    ordered = rows.repartition("customer_id").sortWithinPartitions("customer_id", "us", "payment_id")
    return ordered.mapInPandas(replay, GUARDED_LOG)


def guarded_outcomes(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Outcome of the guarded policy per level from its decision log."""
    totals = rows.groupBy("order_id").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("orders_total"), F.sum("n").alias("raw_events_total")
    )
    per_level = log.groupBy("level").agg(
        F.count_if("recovered").alias("orders_recovered"),
        F.coalesce(F.sum(F.when(F.col("recovered"), F.col("amount"))), F.lit(0)).alias("money_recovered_paise"),
        F.count_if(P.is_chase(F.col("final_action"))).alias("contacts_sent"),
        F.count_if(P.costs_effort(F.col("final_action"))).alias("attempts_made"),
        F.count_if(prevented()).alias("guardrail_prevented_contacts"),
        F.count("*").alias("raw_events_processed"),
    )
    return _outcome_columns(per_level.select(
        F.lit("guarded").alias("policy"), "*", totals.select("orders_total").scalar().alias("orders_total"),
        totals.select("raw_events_total").scalar().alias("raw_events_total"),
    ))


def prevented() -> Column:
    """A guardrail turned an attempt into something that is none."""
    return P.costs_effort(F.col("candidate_action")) & ~P.costs_effort(F.col("final_action"))


def policy_outcomes(flagged: DataFrame, diagnoses: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Four policies on three sensitivity levels, side by side."""
    rows = replay_rows(flagged, diagnoses)
    guarded = guarded_outcomes(rows, guarded_log(rows, config))
    baseline = baseline_outcomes(rows)
    return baseline.unionByName(guarded)


def band_findings(outcomes: DataFrame) -> DataFrame:
    """Per level: does the guarded policy beat the others on money and on contact cost?"""
    wide = outcomes.groupBy("level").pivot("policy", K.POLICIES).agg(
        F.first("money_recovered_rupees").alias("money"), F.first("contacts_per_rupee").alias("cost")
    )

    def cheaper(other: str) -> Column:
        ours, theirs = F.col("guarded_cost"), F.col(f"{other}_cost")
        return F.when(ours.isNull(), theirs.isNull()).otherwise(theirs.isNull() | (ours <= theirs))

    return wide.select(
        "level", *[F.col(f"{name}_money") for name in K.POLICIES],
        (F.col("guarded_money") > F.col("do_nothing_money")).alias("beats_do_nothing"),
        (F.col("guarded_money") >= F.col("notify_all_money")).alias("recovers_at_least_notify_all"),
        cheaper("notify_all").alias("cheaper_than_notify_all"),
        cheaper("notify_all_once").alias("cheaper_than_notify_all_once"),
    )


def opportunity_cost(log: DataFrame) -> DataFrame:
    """What the guardrails gave up: blocked attempts scored as if the candidate had run."""
    candidate_odds = None
    for level in K.LEVELS:
        for action in K.LADDER:
            hit = (F.col("level") == level) & (F.col("candidate_action") == action)
            odds = _by_class(action, level)
            candidate_odds = F.when(hit, odds) if candidate_odds is None else candidate_odds.when(hit, odds)
    per_order = log.groupBy("level", "order_id").agg(
        F.count_if(prevented()).alias("blocked"),
        F.count_if(prevented() & (F.col("draw") < candidate_odds)).alias("would_recover"),
        F.bool_or("recovered").alias("recovered"),
    )
    return per_order.groupBy("level").agg(
        F.sum("blocked").alias("blocked"), F.sum("would_recover").alias("would_have_recovered"),
        F.count_if(F.col("would_recover") > 0).alias("orders_affected"),
        F.count_if((F.col("would_recover") > 0) & ~F.col("recovered")).alias("orders_never_recovered"),
    )


__all__ = [
    "band_findings", "baseline_outcomes", "guarded_log", "guarded_outcomes",
    "opportunity_cost", "policy_outcomes", "replay_rows",
]
