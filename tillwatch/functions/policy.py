"""Actions, escalation ladder and the wording of decisions, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions.literals import literal_array, lookup


@dataclass(frozen=True)
class PolicyConfig:
    attempt_cap: int = 4
    contact_cap: int = 3
    contact_window_seconds: int = 24 * 3600
    cooldown_seconds: int = 4 * 3600
    amount_floor_paise: int = 5000
    quiet_start_hour: int = 21
    quiet_end_hour: int = 9
    backoff_step_seconds: int = 3 * 3600


def base_action(remediation_class: Column) -> Column:
    """The action a class starts with; a class without one is an error."""
    unknown = F.raise_error(F.concat(F.lit("no base action for class "), remediation_class)).cast("string")
    return F.coalesce(lookup(K.BASE_ACTION_BY_CLASS, remediation_class), unknown)


def rungs(base: Column) -> Column:
    """Actions of the first, second, ... attempt that starts at ``base``."""
    tails = {action: K.LADDER[start:] for start, action in enumerate(K.LADDER)}
    branch = None
    for action, tail in tails.items():
        value = literal_array(tail)
        branch = F.when(base == action, value) if branch is None else branch.when(base == action, value)
    return branch.otherwise(F.array(base))


def ladder_action(base: Column, attempt: Column) -> Column:
    """Climb one rung per earlier attempt, up to the last; actions off the ladder stay."""
    steps = rungs(base)
    return F.element_at(steps, F.greatest(F.lit(1), F.least(attempt, F.size(steps))).cast("int"))


def is_chase(action: Column) -> Column:
    return action.isin(K.CHASE_ACTIONS)


def costs_effort(action: Column) -> Column:
    """Contacts the customer or a human."""
    return action.isin(K.LADDER)


def in_quiet_hours(hour: Column, config: PolicyConfig) -> Column:
    start, end = config.quiet_start_hour, config.quiet_end_hour
    if start > end:
        return (hour >= start) | (hour < end)
    return (hour >= start) & (hour < end)


def attempts_exhausted(evaluations: Column) -> Column:
    return F.exists(evaluations, lambda e: (e["name"] == "attempt_cap") & e["blocked"])


def terminal_state(final: Column, gave_up: Column) -> Column:
    """Where the ladder stands; no action means giving up only if the attempt cap said so."""
    named = {
        "recovery_link_now": "in_progress_link_now",
        "recovery_link_backoff": "in_progress_backoff",
        "switch_method": "in_progress_switch_method",
        "escalate_human": "escalated_to_human",
        "reconcile": "reconciled",
        "wait_bank_recovery": "waiting_on_bank",
    }
    return F.coalesce(lookup(named, final), F.when(gave_up, "gave_up").otherwise("no_action_other"))


def scheduled_delay_seconds(
    final: Column, created_at: Column, attempt: Column, quiet_blocked: Column, config: PolicyConfig
) -> Column:
    """A quiet-hours deferral runs to the next end hour, any other backoff grows with attempts."""
    moment = F.unix_micros(created_at.cast("timestamp"))
    midnight = F.unix_micros(F.date_trunc("day", created_at.cast("timestamp")))
    end = midnight + F.lit(config.quiet_end_hour * 3_600_000_000)
    target = F.when(F.hour(created_at) < config.quiet_end_hour, end).otherwise(end + F.lit(86_400_000_000))
    backoff = F.greatest(attempt, F.lit(1)) * F.lit(float(config.backoff_step_seconds))
    return F.when(
        final == "recovery_link_backoff",
        F.when(quiet_blocked, (target - moment) / F.lit(1_000_000.0)).otherwise(backoff),
    )


def disallowed_method(final: Column, method: Column) -> Column:
    return F.when(final == "switch_method", method)


def justification(
    reason: Column, tier: Column, remediation_class: Column, base: Column, candidate: Column,
    evaluations: Column, final: Column,
) -> Column:
    """Why the decision came out as it did: the mapping, every guardrail that fired, the result."""
    fired = F.transform(
        F.filter(evaluations, lambda e: e["blocked"]),
        lambda e: F.concat(e["name"], F.lit(": "), e["action_before"], F.lit(" -> "), e["action_after"],
                           F.lit(" because "), e["reason"], F.lit(".")),
    )
    return F.concat_ws(
        " ",
        F.concat(F.lit("Reason "), reason, F.lit(" ("), tier, F.lit(") maps to class "), remediation_class,
                 F.lit(", base action "), base, F.lit(".")),
        F.concat(F.lit("Ladder candidate: "), candidate, F.lit(".")),
        F.when(F.size(fired) == 0, "No guardrail intervened.").otherwise(F.concat_ws(" ", fired)),
        F.concat(F.lit("Final: "), final, F.lit(".")),
    )
