"""ANSI SQL for the derived inputs, shared by the comparison queries."""

from __future__ import annotations

from tillwatch import constants as K
from tillwatch.sources.dimensions import (
    class_table_rows, reason_explanation, unique_reasons,
)


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return ", ".join(quoted(value) for value in values)


def case_of(mapping: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in mapping.items()) + " END"


def reason_rows_cte() -> str:
    rows = ", ".join(
        f"({i}, {quoted(r)}, {quoted(reason_explanation(r))}, "
        f"{quoted('Recommended: ' + ' or '.join(c) + '.')}, [{sql_list(c)}], {quoted(n)})"
        for i, r, c, n in class_table_rows()
    )
    return (
        "reason_rows(row_index, reason, explanation, next_steps, candidate_classes, note) AS "
        f"(SELECT * FROM (VALUES {rows}) AS v)"
    )


def _reason_dim() -> str:
    classes: dict[str, str | None] = {}
    for _, reason, candidates, note in class_table_rows():
        classes.setdefault(reason, candidates[0] if len(candidates) == 1 and note is None else None)
    rows = ", ".join(
        f"({i}, {quoted(r)}, {quoted(reason_explanation(r))}, {quoted(classes[r])})"
        for i, r in enumerate(unique_reasons())
    )
    return f"reason_dim(reason_pos, error_reason, explanation, row_class) AS (SELECT * FROM (VALUES {rows}) AS v)"


def _steps(method: str, extra: list[str] | None = None) -> str:
    return "[" + sql_list(K.STEPS_BY_METHOD[method] + (extra or [])) + "]"


def step_case(text: str, method: str, flow: str) -> str:
    steps = (
        f"CASE WHEN {method} = 'upi' AND {flow} = 'collect' THEN "
        + _steps("upi", ["payment_authentication_request", "payment_authentication_response"])
        + f" WHEN {method} = 'upi' THEN " + _steps("upi", ["payment_authentication"])
        + "".join(f" WHEN {method} = {quoted(m)} THEN {_steps(m)}" for m in K.STEPS_BY_METHOD if m != "upi")
        + " END"
    )
    branches = []
    for keyword, step in K.STEP_KEYWORDS:
        if step == "payment_authentication":
            branches.append(
                f"WHEN contains({text}, {quoted(keyword)}) AND {method} = 'upi' THEN "
                f"CASE WHEN {flow} = 'collect' THEN 'payment_authentication_request' ELSE 'payment_authentication' END"
            )
        branches.append(
            f"WHEN contains({text}, {quoted(keyword)}) AND list_contains({steps}, {quoted(step)}) THEN {quoted(step)}"
        )
    return "CASE " + " ".join(branches) + " ELSE 'payment_initiation' END"


def failures_cte() -> str:
    """``failures`` over the raw ``events`` table, by the same rules as the Spark view."""
    markers = " OR ".join(f"contains(lower(explanation), {quoted(m)})" for m in K.GATEWAY_ERROR_MARKERS)
    return f"""{_reason_dim()},
fv0 AS (
  SELECT event_id, user_id,
    'pay_' || lpad(event_id::VARCHAR, 14, '0') AS payment_id,
    'cust_' || lpad(user_id::VARCHAR, 8, '0') AS customer_id,
    ts AS created_at, round(value * 100)::BIGINT AS amount,
    CASE WHEN k < 64 THEN 'upi' WHEN k < 84 THEN 'card' WHEN k < 92 THEN 'netbanking'
         WHEN k < 97 THEN 'wallet' WHEN k < 99 THEN 'cardless_emi' ELSE 'emandate' END AS method,
    user_id % 12 AS bank_pos, ([{sql_list(K.BANK_NAMES)}])[(user_id % 12)::INT + 1] AS bank,
    (event_id * 7) % 110 AS reason_pos
  FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)
),
fv1 AS (
  SELECT fv0.*, error_reason, explanation, row_class,
    strftime(created_at, '%Y%m%d') AS day,
    CASE WHEN method IN ('wallet', 'cardless_emi') THEN 12 ELSE bank_pos END AS scoped,
    CASE method WHEN 'upi' THEN 1 WHEN 'card' THEN 2 WHEN 'netbanking' THEN 3 WHEN 'wallet' THEN 4
      WHEN 'cardless_emi' THEN 5 ELSE 6 END AS method_pos,
    CASE WHEN user_id % 2 = 0 THEN 'collect' ELSE 'intent' END AS upi_flow,
    CASE WHEN error_reason IN ({sql_list(K.CATCH_ALL_REASONS)})
      THEN (['no_response', 'maintenance', 'limit_reached', 'risk_hold'])[((event_id // 110) % 4)::INT + 1] END AS subcause,
    CASE WHEN event_id % 5 = 0 THEN 'paraphrase_wording' ELSE 'canonical' END AS description_variant
  FROM fv0 JOIN reason_dim USING (reason_pos)
),
fv2 AS (
  SELECT *,
    'order_' || substr(md5(customer_id || '|' || method || '|' || day), 1, 14) AS order_id,
    CASE WHEN method = 'upi' THEN 'user' || lpad(user_id::VARCHAR, 6, '0') || '@okbank' END AS vpa,
    CASE WHEN method = 'card' THEN (400000 + user_id % 99999)::VARCHAR END AS card_bin,
    CASE WHEN subcause IS NOT NULL THEN error_reason || '.' || subcause END AS latent_subcause_id,
    CASE WHEN (date_diff('day', DATE '1970-01-01', created_at::DATE) * 5 + scoped * 7 + method_pos * 3) % 9 = 0
          AND hour(created_at) BETWEEN 10 AND 13
      THEN 'win_' || day || '_' || method || '_' || scoped END AS downtime_window_id,
    CASE WHEN subcause IS NOT NULL THEN 'Payment declined upstream: ' || replace(subcause, '_', ' ') || '.'
      ELSE split_part(explanation, '. ', 1) || '.' END AS sentence
  FROM fv1
),
failures AS (
  SELECT payment_id, order_id, customer_id, amount, method, created_at,
    row_number() OVER (PARTITION BY order_id ORDER BY created_at, payment_id) AS attempt_number,
    bank, vpa, card_bin,
    CASE WHEN error_reason = 'server_error' OR contains(lower(explanation), '{K.SERVER_ERROR_MARKER.replace("'", "''")}')
      THEN 'SERVER_ERROR' WHEN {markers} THEN 'GATEWAY_ERROR' ELSE 'BAD_REQUEST_ERROR' END AS error_code,
    coalesce({case_of(K.SOURCE_BY_CLASS, 'row_class')}, {case_of(K.SYSTEM_SOURCE_BY_METHOD, 'method')}) AS error_source,
    {step_case('lower(explanation)', 'method', 'upi_flow')} AS error_step,
    error_reason,
    CASE WHEN description_variant = 'canonical' THEN '' ELSE 'Notice: ' END || sentence ||
      {clause_sql("lpad((event_id * 37)::VARCHAR, 12, '0')")} AS description,
    latent_subcause_id, description_variant, downtime_window_id,
    CASE WHEN ('0x' || substr(md5(coalesce(downtime_window_id, payment_id)), 1, 8))::BIGINT % 100 < 20
      THEN 'test' ELSE 'train' END AS split,
    CASE WHEN method IN ({sql_list(K.BANK_SCOPED_METHODS)}) THEN bank END AS ebank,
    epoch_us(created_at) AS us, epoch_us(created_at) // 900000000 AS idx
  FROM fv2
)"""


def clause_sql(rrn: str) -> str:
    return (
        "' (payment ' || payment_id || ', order ' || order_id || ', Rs.' || (amount // 100)::VARCHAR || '.' || "
        "lpad((amount % 100)::VARCHAR, 2, '0') || CASE method WHEN 'card' THEN ', card BIN ' || coalesce(card_bin, '') "
        f"WHEN 'upi' THEN ', VPA ' || coalesce(vpa, '') || ', RRN ' || {rrn} WHEN 'netbanking' THEN ', via ' || bank "
        "WHEN 'emandate' THEN ', via ' || bank ELSE '' END || ', at ' || "
        "strftime(created_at, '%Y-%m-%dT%H:%M:%S') || ')'"
    )
