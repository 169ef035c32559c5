from pyspark.sql import functions as F

from tillwatch.operators.backtest import policy_outcomes
from tillwatch.operators.guardrails import decide_batch
from tillwatch.operators.incidents import flag_active_incidents
from tillwatch.plans import reports
from tillwatch.sources.reports import write_report


def test_incident_report(spark, failures, tmp_path):
    tables = reports.incident_report(failures, {"fixed_threshold": {"threshold": 1}})
    assert tables["winner"].count() == 1 and tables["reason_scoped"].count() == 2
    assert tables["detectors"].count() == 8 and tables["cross_reason"].count() == 3
    write_report({name: tables[name] for name in ("winner", "corroboration")}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "winner")).first().split == "test"


def test_policy_and_execution_reports(failures, diagnoses):
    n = failures.count()
    policy = reports.policy_report(failures, diagnoses)
    assert policy["actions"].agg(F.sum("final_count")).first()[0] == n
    assert policy["terminal_states"].agg(F.sum("n")).first()[0] == n
    assert policy["guardrails"].filter(F.col("fired") + F.col("passed") != n).isEmpty()
    run = reports.execution_report(failures, diagnoses, "2026-01-01T00:00:00Z", head=50)
    assert run["outcomes"].agg(F.sum("n")).first()[0] == n
    assert 50 <= run["log"].count() < 80 and run["chains"].filter("not valid").isEmpty()
    assert run["examples"].count() >= decide_batch(failures, diagnoses).select("final_action").distinct().count()


def test_simulation_report(failures, diagnoses):
    tables = reports.simulation_report(failures, diagnoses)
    direct = policy_outcomes(flag_active_incidents(failures), diagnoses)
    assert tables["outcomes"].exceptAll(direct).isEmpty() and tables["bands"].count() == 3
    assert tables["opportunity_cost"].count() == 3
