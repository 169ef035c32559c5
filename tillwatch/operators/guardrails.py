"""The guardrail chain and the whole recovery decision.

The first four guardrails read only the row. The contact cap and the cooldown read the
contacts accepted earlier, which the chain itself decides; those come from one recurrence per
customer over narrow rows (``spacing``). Quiet hours turn one contact into a later one, so they
never change which contacts are accepted and can be applied last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions import policy as P
from tillwatch.functions.policy import PolicyConfig
from tillwatch.functions.timegrid import micros
from tillwatch.operators.diagnosis import attach_by_reason
from tillwatch.operators.incidents import flag_active_incidents
from tillwatch.operators.spacing import HOT_ROWS, select_spaced
from tillwatch.session import stored


@dataclass(frozen=True)
class Guardrail:
    """What one guardrail says about an action: when it blocks, what it puts in its place, why."""

    name: str
    blocked: Column
    replacement: Column
    why: Column
    passed: Column


def evaluation(number: int, rule: Guardrail, before: str) -> Column:
    """The record of guardrail ``number``: name, blocked, action before and after, reason."""
    return F.struct(
        F.lit(rule.name).alias("name"), F.col(f"_b{number}").alias("blocked"),
        F.col(before).alias("action_before"), F.col(f"_a{number}").alias("action_after"),
        F.when(F.col(f"_b{number}"), rule.why).otherwise(rule.passed).alias("reason"),
    )


def terminal_reason(action: Column) -> Guardrail:
    duplicate = F.col("error_reason").isin(K.RECONCILE_REASONS)
    hit_duplicate = duplicate & P.costs_effort(action)
    hit_terminal = ~duplicate & (F.col("remediation_class") == "terminal") & (action != "no_action")
    return Guardrail(
        "terminal_reason_blocklist", hit_duplicate | hit_terminal,
        F.when(hit_duplicate, "reconcile").otherwise("no_action"),
        F.when(hit_duplicate, "the payment is a duplicate or already paid and needs reconciling")
        .otherwise("the class is terminal"),
        F.lit("reason is not blocked or the action contacts nobody"),
    )


def active_incident(action: Column) -> Guardrail:
    return Guardrail(
        "active_incident_suppression", F.col("in_active_incident") & P.is_chase(action),
        F.lit("wait_bank_recovery"), F.lit("the method and bank are inside a detected incident"),
        F.lit("no active incident or no customer contact"),
    )


def amount_floor(action: Column, config: PolicyConfig) -> Guardrail:
    floor = config.amount_floor_paise
    return Guardrail(
        "amount_floor", (F.col("amount") < floor) & P.costs_effort(action), F.lit("no_action"),
        F.concat(F.lit("amount "), F.col("amount").cast("string"), F.lit(f" is below {floor} paise")),
        F.lit("amount is high enough or nothing is spent"),
    )


def attempt_cap(action: Column, config: PolicyConfig) -> Guardrail:
    cap = config.attempt_cap
    return Guardrail(
        "attempt_cap", (F.col("attempt_number") > cap) & P.costs_effort(action), F.lit("no_action"),
        F.concat(F.lit("attempt "), F.col("attempt_number").cast("string"), F.lit(f" exceeds the cap of {cap}")),
        F.lit("attempts remain or this is no attempt"),
    )


def contact_cap(action: Column, config: PolicyConfig) -> Guardrail:
    return Guardrail(
        "per_customer_contact_cap", (F.col("contacts_in_window") >= config.contact_cap) & P.is_chase(action),
        F.lit("no_action"),
        F.concat(F.lit("the customer already had "), F.col("contacts_in_window").cast("string"),
                 F.lit(f" contacts in the window, cap {config.contact_cap}")),
        F.lit("under the contact cap or no customer contact"),
    )


def cooldown(action: Column, config: PolicyConfig) -> Guardrail:
    since = F.col("seconds_since_last_contact")
    return Guardrail(
        "contact_cooldown", (since < config.cooldown_seconds) & P.is_chase(action), F.lit("no_action"),
        F.concat(F.lit("the last contact was "), F.floor(since).cast("string"),
                 F.lit(f" s ago, cooldown {config.cooldown_seconds} s")),
        F.lit("no recent contact or no customer contact"),
    )


def quiet_hours(action: Column, config: PolicyConfig) -> Guardrail:
    sends_now = action.isin("recovery_link_now", "switch_method")
    return Guardrail(
        "quiet_hours", P.in_quiet_hours(F.hour("created_at"), config) & sends_now,
        F.lit("recovery_link_backoff"),
        F.concat(F.lit("hour "), F.hour("created_at").cast("string"), F.lit(" is within quiet hours")),
        F.lit("outside quiet hours or nothing is sent now"),
    )


def default_chain(config: PolicyConfig) -> list[Guardrail]:
    """The seven guardrails in order; number n reads the action left by number n - 1."""
    return [
        terminal_reason(F.col("_a0")), active_incident(F.col("_a1")), amount_floor(F.col("_a2"), config),
        attempt_cap(F.col("_a3"), config), contact_cap(F.col("_a4"), config), cooldown(F.col("_a5"), config),
        quiet_hours(F.col("_a6"), config),
    ]


def _apply(rows: DataFrame, chain: list[Guardrail], first: int) -> DataFrame:
    """Add the flag ``_b`` and the resulting action ``_a`` of consecutive guardrails.

    They are plain columns, each reading the one before by name, so that the chain stays a stack
    of small projections instead of one expression that doubles per step.
    """
    columns = []
    for number, rule in enumerate(chain, start=first):
        columns.append(F.coalesce(rule.blocked, F.lit(False)).alias(f"_b{number}"))
        result = F.when(F.col(f"_b{number}"), rule.replacement).otherwise(F.col(f"_a{number - 1}"))
        columns.append(result.alias(f"_a{number}"))
    return rows.select("*", *columns)


def candidates(failures: DataFrame, diagnoses: DataFrame, config: PolicyConfig) -> DataFrame:
    """Diagnosis, base action, ladder candidate and the four row-wise guardrails."""
    actions = diagnoses.withColumn("base_action", P.base_action(F.col("remediation_class")))
    actions = actions.withColumn("rungs", P.rungs(F.col("base_action")))
    rows = attach_by_reason(failures, actions)
    unknown = F.raise_error(F.concat(F.lit("no diagnosis for reason "), F.col("error_reason")))
    rung = F.greatest(F.lit(1), F.least(F.col("attempt_number"), F.size("rungs"))).cast("int")
    rows = rows.withColumn(
        "candidate_action",
        F.coalesce(F.element_at("rungs", rung), unknown.cast("string")),
    ).drop("rungs")
    rows = rows.withColumn("_a0", F.col("candidate_action"))
    return _apply(rows, default_chain(config)[:4], 1)


def contact_rules(config: PolicyConfig) -> list[tuple[int, int]]:
    """The trailing window includes its edge, so the n-th last contact must be past it."""
    return [
        (1, config.cooldown_seconds * 1_000_000),
        (config.contact_cap, config.contact_window_seconds * 1_000_000 + 1),
    ]


def accepted_contacts(
    requests: DataFrame, config: PolicyConfig, sizes: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Contact log ``(customer_id, us, id)``: the requests that cap and cooldown let through."""
    rows = requests.select("customer_id", micros(F.col("created_at")).alias("us"), F.col("payment_id").alias("id"))
    if config.contact_cap <= 0:
        return rows.filter(F.lit(False))
    return select_spaced(rows, ["customer_id"], contact_rules(config), sizes, hot_rows)


def with_contact_stats(
    rows: DataFrame, log: DataFrame, config: PolicyConfig, moments: DataFrame | None = None
) -> DataFrame:
    """Add ``contacts_in_window`` and ``seconds_since_last_contact`` from the contact log.

    Contacts are looked up by customer and lookback-sized time bin (own and previous), where
    only a handful can lie. Behind these the last moment of all earlier bins is carried forward
    over the customer's bins, one row per bin, so recency has no horizon. The join spreads one
    customer over its bins; AQE splits a bin that is still too large. ``moments`` is a table with at
    least the customers and moments of ``rows`` that is cheaper to scan.
    """
    lookback = max(config.contact_window_seconds, config.cooldown_seconds) * 1_000_000
    window = config.contact_window_seconds * 1_000_000
    bins = log.select(
        "customer_id", F.struct("us", "id").alias("contact"),
        F.explode(F.array(F.floor(F.col("us") / lookback), F.floor(F.col("us") / lookback) + 1)).alias("_bin"),
    ).groupBy("customer_id", "_bin").agg(F.collect_list("contact").alias("_contacts"))
    placed = rows.withColumn("_us", micros(F.col("created_at"))).withColumn("_bin", F.floor(F.col("_us") / lookback))
    forward = W.partitionBy("customer_id").orderBy("_bin")
    ends = log.groupBy("customer_id", F.floor(F.col("us") / lookback).alias("_bin")).agg(F.max("us").alias("_end"))
    times = (rows if moments is None else moments).select("customer_id", micros(F.col("created_at")).alias("_us"))
    asked = times.select("customer_id", F.floor(F.col("_us") / lookback).alias("_bin")).distinct()
    carried = asked.join(ends, ["customer_id", "_bin"], "full").select(
        "customer_id", "_bin",
        F.last("_end", ignorenulls=True).over(forward.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
    )
    joined = placed.join(bins, ["customer_id", "_bin"], "left").join(carried, ["customer_id", "_bin"], "left")
    here = F.struct(F.col("_us").alias("us"), F.col("payment_id").alias("id"))
    earlier = F.filter("_contacts", lambda c: (c < here) & (c["us"] >= F.col("_us") - lookback))
    with_earlier = joined.withColumn("_earlier", earlier)
    last = F.coalesce(F.array_max(F.transform("_earlier", lambda c: c["us"])), F.col("_before"))
    return with_earlier.select(
        *rows.columns,
        F.greatest(F.size(F.filter("_earlier", lambda c: c["us"] >= F.col("_us") - window)), F.lit(0))
        .alias("contacts_in_window"),
        ((F.col("_us") - last) / 1_000_000).alias("seconds_since_last_contact"),
    )


DECISION_COLUMNS = [
    "payment_id", "order_id", "customer_id", "method", "bank", "amount", "created_at", "attempt_number",
    "error_reason", "remediation_class", "diagnosis_tier", "diagnosis_confidence", "in_active_incident",
    "base_action", "candidate_action", "guardrail_evaluations", "final_action", "ladder_terminal_state",
    "scheduled_delay_seconds", "disallowed_method", "justification",
]


def decide(
    flagged: DataFrame, diagnoses: DataFrame, config: PolicyConfig = PolicyConfig(), keep: tuple[str, ...] = (),
    hot_rows: int = HOT_ROWS, sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Decisions for failures that carry ``in_active_incident``; ``keep`` passes columns through.

    ``sizes_from`` is a table with the same customers that is cheaper to count than ``flagged``. The candidates are stored:
    requests, contact statistics and the rest of the chain read them, and all that is before them should run once.
    """
    rows = candidates(flagged, diagnoses, config)
    rows = stored(rows.select(*[c for c in rows.columns if c.startswith("_") or c in DECISION_COLUMNS or c in keep]))
    requests = rows.filter(P.is_chase(F.col("_a4"))).select("customer_id", "created_at", "payment_id")
    sizes = (rows if sizes_from is None else sizes_from).groupBy("customer_id").count()
    log = accepted_contacts(requests, config, sizes, hot_rows)
    rows = with_contact_stats(rows, log, config, sizes_from)
    chain = default_chain(config)
    rows = _apply(rows, chain[4:], 5)
    verdicts = [evaluation(number, rule, f"_a{number - 1}") for number, rule in enumerate(chain, start=1)]
    rows = rows.select("*", F.array(*verdicts).alias("guardrail_evaluations"), F.col("_a7").alias("final_action"))
    final, evaluations = F.col("final_action"), F.col("guardrail_evaluations")
    rows = rows.select(
        "*",
        P.terminal_state(final, F.col("_b4")).alias("ladder_terminal_state"),
        P.scheduled_delay_seconds(
            final, F.col("created_at"), F.col("attempt_number"), F.col("_b7"), config
        ).alias("scheduled_delay_seconds"),
        P.disallowed_method(final, F.col("method")).alias("disallowed_method"),
        P.justification(
            F.col("error_reason"), F.col("diagnosis_tier"), F.col("remediation_class"), F.col("base_action"),
            F.col("candidate_action"), evaluations, final,
        ).alias("justification"),
    )
    return rows.select(*DECISION_COLUMNS, *keep)


def decide_batch(
    failures: DataFrame, diagnoses: DataFrame, config: PolicyConfig = PolicyConfig(), keep: tuple[str, ...] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Flag active incidents over the whole input, then decide."""
    return decide(flag_active_incidents(failures), diagnoses, config, keep, hot_rows)
