"""Explicit schemas and the drift check applied at the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

STRING, LONG, INT, BOOL, NTZ = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


FAILURES = _struct(
    ("payment_id", STRING), ("order_id", STRING), ("customer_id", STRING), ("amount", LONG),
    ("method", STRING), ("created_at", NTZ), ("attempt_number", INT), ("bank", STRING),
    ("vpa", STRING), ("card_bin", STRING), ("error_code", STRING), ("error_source", STRING),
    ("error_step", STRING), ("error_reason", STRING), ("description", STRING),
    ("latent_subcause_id", STRING), ("description_variant", STRING), ("is_outlier", BOOL),
    ("downtime_window_id", STRING), ("split", STRING),
)

SIGNAL_PAYLOAD = _struct(
    ("code", STRING), ("error_code", STRING), ("description", STRING), ("error_description", STRING),
    ("source", STRING), ("error_source", STRING), ("step", STRING), ("error_step", STRING),
    ("reason", STRING), ("error_reason", STRING), ("field", STRING),
    ("metadata", T.MapType(STRING, STRING)),
)

DOWNTIME = _struct(
    ("id", STRING), ("entity", STRING), ("method", STRING), ("begin", LONG), ("end", LONG),
    ("status", STRING), ("scheduled", BOOL), ("severity", STRING),
    ("instrument", T.MapType(STRING, STRING)), ("instrument_schema", T.ArrayType(STRING)),
    ("flow", STRING), ("created_at", LONG), ("updated_at", LONG),
)

DOWNTIME_WEBHOOK = _struct(
    ("entity", STRING), ("account_id", STRING), ("event", STRING), ("contains", T.ArrayType(STRING)),
    ("payload", _struct(("payment.downtime", _struct(("entity", DOWNTIME))))),
    ("created_at", LONG),
)

REASONS = _struct(
    ("row_index", INT), ("reason", STRING), ("explanation", STRING), ("next_steps", STRING),
)

EXTERNAL_ANSWERS = _struct(
    ("reason", STRING), ("remediation_class", STRING), ("confidence", STRING), ("rationale", STRING),
)

EVALUATION = _struct(
    ("name", STRING), ("blocked", BOOL), ("action_before", STRING), ("action_after", STRING),
    ("reason", STRING),
)

AUDIT_PAYLOAD = _struct(
    ("amount", LONG), ("attempt_number", INT), ("bank", STRING), ("base_action", STRING),
    ("candidate_action", STRING), ("created_at", STRING), ("customer_id", STRING),
    ("diagnosis_confidence", STRING), ("diagnosis_rationale", STRING), ("diagnosis_tier", STRING),
    ("error_code", STRING), ("error_reason", STRING), ("error_source", STRING),
    ("error_step", STRING), ("execution", STRING), ("final_action", STRING),
    ("guardrail_evaluations", T.ArrayType(EVALUATION)), ("in_active_incident", BOOL),
    ("justification", STRING), ("ladder_terminal_state", STRING), ("method", STRING),
    ("order_id", STRING), ("payment_id", STRING), ("prev_hash", STRING), ("recorded_at", STRING),
    ("remediation_class", STRING), ("schema_version", INT), ("sequence", LONG),
)


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Fail on a missing or differently typed column; extra columns pass through."""
    actual = {field.name: field.dataType for field in df.schema.fields}
    problems = [
        f"{field.name}: expected {field.dataType.simpleString()}, got "
        + (actual[field.name].simpleString() if field.name in actual else "nothing")
        for field in expected.fields
        if actual.get(field.name) != field.dataType
    ]
    if problems:
        raise ValueError("schema drift: " + "; ".join(problems))
    return df
