"""The five reports as named summary tables, ready for ``sources.reports.write_report``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.functions.policy import PolicyConfig
from tillwatch.functions.timegrid import REASON_ENTITY
from tillwatch.operators import backtest, diagnosis, execution, reporting, scoring
from tillwatch.operators.audit import audit_rows, build_chain, verify_chains
from tillwatch.operators.detectors import DETECTORS
from tillwatch.operators.guardrails import decide_batch
from tillwatch.operators.incidents import detect_incidents, flag_active_incidents
from tillwatch.plans.bakeoff import bakeoff_crossovers, bakeoff_metrics, label_table
from tillwatch.session import checkpointed

INCIDENT_KEY = ["method", "bank", "incident_no"]


def incident_report(failures: DataFrame, options: Mapping[str, dict] | None = None) -> dict[str, DataFrame]:
    """Detectors per split, the winner's reason-scoped rerun, cross-reason figures and the
    corroboration by declared downtimes on the test split."""
    report = checkpointed(scoring.detector_report(failures, options=options))
    winner = scoring.select_winner(report).first()["detector"]
    settings = (options or {}).get(winner, {})
    windows = checkpointed(scoring.true_windows(failures))
    test = failures.filter(F.col("split") == "test")
    found = detect_incidents(test, DETECTORS[winner], **settings)
    declared = scoring.declared_downtimes(windows.filter(F.col("split") == "test"))
    return {
        "detectors": report,
        "winner": report.filter((F.col("detector") == winner) & (F.col("split") == "test")),
        "reason_scoped": scoring.detector_report(failures, REASON_ENTITY, options, (winner,), "groupby_reason+"),
        "cross_reason": scoring.cross_reason_summary(windows),
        "corroboration": scoring.corroboration_summary(found, declared, INCIDENT_KEY),
    }


def policy_report(failures: DataFrame, diagnoses: DataFrame, config: PolicyConfig = PolicyConfig()) -> dict[str, DataFrame]:
    """Actions, guardrails, contacts, ladder states and example decisions of one pass."""
    decisions = checkpointed(decide_batch(failures, diagnoses, config))
    return {
        "routing": diagnosis.routing_stats(failures, diagnoses),
        "actions": reporting.action_distribution(decisions),
        "guardrails": reporting.guardrail_fires(decisions),
        "over_contact": reporting.over_contact(decisions),
        "terminal_states": reporting.terminal_states(decisions),
        "waiting": reporting.waiting_count(decisions),
        "examples": reporting.example_decisions(decisions),
    }


def simulation_report(failures: DataFrame, diagnoses: DataFrame, config: PolicyConfig = PolicyConfig()) -> dict[str, DataFrame]:
    """Four policies on three levels, the band verdicts and the guardrails' opportunity cost."""
    flagged = flag_active_incidents(failures)
    rows = checkpointed(backtest.replay_rows(flagged, diagnoses))
    log = checkpointed(backtest.guarded_log(rows, config))
    outcomes = checkpointed(backtest.baseline_outcomes(rows).unionByName(backtest.guarded_outcomes(rows, log)))
    return {
        "outcomes": outcomes, "bands": backtest.band_findings(outcomes), "opportunity_cost": backtest.opportunity_cost(log),
    }


def execution_report(
    failures: DataFrame, diagnoses: DataFrame, recorded_at: str, head: int | None = None,
    config: PolicyConfig = PolicyConfig(),
) -> dict[str, DataFrame]:
    """Dry-run outcomes, key audit, and a verified log of every decision (``head`` asks for a
    representative sample with so many first rows instead)."""
    decisions = checkpointed(execution.execution_records(decide_batch(failures, diagnoses, config)))
    chosen = decisions
    if head is not None:
        chosen = decisions.join(reporting.representative_sample(decisions, head), "payment_id", "left_semi")
    log = checkpointed(build_chain(audit_rows(chosen, failures, diagnoses, recorded_at)))
    return {
        "outcomes": execution.outcome_counts(decisions),
        "reference_ids": execution.reference_id_check(failures),
        "examples": reporting.example_payment_ids(chosen),
        "log": log,
        "chains": verify_chains(log),
    }


def clustering_report(failures: DataFrame) -> dict[str, DataFrame]:
    """Clusterer metrics per arm and stratum, and the crossover shares."""
    scores = checkpointed(bakeoff_metrics(label_table(failures)))
    return {"runs": scores, "crossovers": bakeoff_crossovers(scores)}
