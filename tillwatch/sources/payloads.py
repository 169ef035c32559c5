"""JSON payloads: failure signals and downtime webhooks, parsed with a fixed schema.

All functions take a DataFrame with a string column and work on batch and streaming input.
Invalid rows are kept apart with the reason instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.schemas import DOWNTIME, DOWNTIME_WEBHOOK, SIGNAL_PAYLOAD

ALIASES = ["code", "description", "source", "step", "reason"]


def first_problem(checks: list[tuple[Column, str]]) -> Column:
    """Name of the first failed check, NULL when all hold."""
    branch = None
    for failed, name in checks:
        failed = F.coalesce(failed, F.lit(True))
        branch = F.when(failed, name) if branch is None else branch.when(failed, name)
    return branch


def parse_signals(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One shape for webhook entities (``error_*`` names) and API errors (bare names).

    The bare name wins when both are present. ``problem`` names the first violation: not an
    object, a missing key, a value outside its closed list, or an empty reason.
    """
    def normalise(p: Column) -> Column:
        merged = {name: F.coalesce(p[name], p[f"error_{name}"]) for name in ALIASES}
        checks = [(p.isNull(), "not an object")]
        checks += [(value.isNull(), f"missing {name}") for name, value in merged.items()]
        checks += [
            (~merged["code"].isin(K.ERROR_CODES), "unknown code"), (~merged["source"].isin(K.ERROR_SOURCES), "unknown source"),
            (~merged["step"].isin(K.ERROR_STEPS), "unknown step"), (F.length(merged["reason"]) == 0, "empty reason"),
        ]
        return F.struct(
            *[value.alias(name) for name, value in merged.items()], p["field"].alias("field"),
            p["metadata"].alias("metadata"), first_problem(checks).alias("problem"),
        )

    return with_parsed(payloads, F.from_json(column, SIGNAL_PAYLOAD), normalise)


def with_parsed(payloads: DataFrame, parsed: Column, build: Callable[[Column], Column]) -> DataFrame:
    """Append the fields of ``build(parsed)``. The parsed value is bound once, so a later filter
    on ``problem`` does not multiply the JSON parsing by the number of checks."""
    row = F.transform(F.array(parsed), build)[0]
    return payloads.withColumn("_row", row).select(*payloads.columns, "_row.*")


def valid_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("problem").isNull()).drop("problem")


def quarantined_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("problem").isNotNull())


def _downtime_fields(entity: Column) -> dict[str, Column]:
    def seconds(name: str) -> Column:
        return F.timestamp_seconds(entity[name]).cast("timestamp_ntz")

    return {
        "id": entity["id"], "method": entity["method"], "bank": entity["instrument"]["bank"], "begin": seconds("begin"),
        "end": seconds("end"), "status": entity["status"], "scheduled": entity["scheduled"], "severity": entity["severity"],
        "instrument": F.coalesce(entity["instrument"], F.create_map().cast("map<string,string>")),
        "flow": entity["flow"], "created_at": seconds("created_at"), "updated_at": seconds("updated_at"),
    }


def _downtime_checks(fields: dict[str, Column]) -> list[tuple[Column, str]]:
    required = ["id", "begin", "scheduled", "created_at", "updated_at"]
    return [(fields[name].isNull(), f"missing {name}") for name in required] + [
        (~fields["method"].isin(K.DOWNTIME_METHODS), "unsupported method"),
        (~fields["status"].isin(K.DOWNTIME_STATUSES), "unknown status"),
        (~fields["severity"].isin(K.DOWNTIME_SEVERITIES), "unknown severity"),
    ]


def _as_row(fields: dict[str, Column], checks: list[tuple[Column, str]]) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()], first_problem(checks).alias("problem"))


def parse_downtimes(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Downtime snapshot rows; the bank is read from the instrument map."""
    def build(entity: Column) -> Column:
        fields = _downtime_fields(entity)
        return _as_row(fields, _downtime_checks(fields))

    return with_parsed(payloads, F.from_json(column, DOWNTIME), build)


def parse_downtime_webhooks(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Downtime lifecycle webhooks: the entity sits under the dotted key ``payment.downtime``."""
    def build(webhook: Column) -> Column:
        entity = webhook["payload"].getField("payment.downtime").getField("entity")
        fields = {
            "account_id": webhook["account_id"], "event": webhook["event"],
            "delivered_at": F.timestamp_seconds(webhook["created_at"]).cast("timestamp_ntz"), **_downtime_fields(entity),
        }
        own = [(fields["account_id"].isNull(), "missing account_id"), (~fields["event"].isin(K.DOWNTIME_EVENTS), "unknown event")]
        return _as_row(fields, own + _downtime_checks(fields))

    return with_parsed(payloads, F.from_json(column, DOWNTIME_WEBHOOK), build)


def latest_downtimes(rows: DataFrame) -> DataFrame:
    """Current state per downtime: the row with the newest ``updated_at``."""
    others = [name for name in rows.columns if name != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*others), "updated_at").alias("row")).select(
        "id", *[F.col(f"row.{name}").alias(name) for name in others]
    )
