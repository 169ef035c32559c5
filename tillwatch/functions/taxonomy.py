"""Code, source and step of a failure, inferred from its reason text and class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions.literals import literal_array, lookup


def infer_error_code(reason: Column, explanation: Column) -> Column:
    text = F.lower(explanation)
    gateway = reduce(lambda a, b: a | b, [text.contains(marker) for marker in K.GATEWAY_ERROR_MARKERS])
    return (
        F.when((reason == K.SERVER_ERROR_REASON) | text.contains(K.SERVER_ERROR_MARKER), "SERVER_ERROR")
        .when(gateway, "GATEWAY_ERROR")
        .otherwise("BAD_REQUEST_ERROR")
    )


def infer_source(remediation_class: Column, method: Column) -> Column:
    """Class decides the source; an undecided or system-side class falls back on the method."""
    return F.coalesce(
        lookup(K.SOURCE_BY_CLASS, remediation_class), lookup(K.SYSTEM_SOURCE_BY_METHOD, method)
    )


def valid_steps(method: Column, upi_flow: Column) -> Column:
    """Steps the method may report. UPI depends on the flow, which must then be known."""
    upi = K.STEPS_BY_METHOD["upi"]
    collect = ["payment_authentication_request", "payment_authentication_response"]
    branch = F.when(
        method == "upi",
        F.when(upi_flow == "collect", literal_array([*upi, *collect]))
        .when(upi_flow == "intent", literal_array([*upi, "payment_authentication"]))
        .otherwise(F.raise_error(F.lit("upi_flow is required for upi")).cast("array<string>")),
    )
    for name, steps in K.STEPS_BY_METHOD.items():
        if name != "upi":
            branch = branch.when(method == name, literal_array(steps))
    return branch


def infer_step(explanation: Column, method: Column, upi_flow: Column) -> Column:
    """First keyword whose step the method can report, else initiation.

    An authentication keyword on UPI answers with the flow's own authentication step.
    """
    text = F.lower(explanation)
    authentication = F.when((method == "upi") & (upi_flow == "collect"), "payment_authentication_request").otherwise(
        "payment_authentication"
    )
    hits = [
        F.when(text.contains(keyword), authentication if step == "payment_authentication" else F.lit(step))
        for keyword, step in K.STEP_KEYWORDS
    ]
    steps = valid_steps(method, upi_flow)
    possible = F.filter(F.array(*hits), lambda step: F.array_contains(steps, step))
    return F.coalesce(F.get(possible, F.lit(0)), F.lit("payment_initiation"))


def ground_truth() -> Column:
    return F.struct("error_code", "error_source", "error_step", "error_reason")


def true_label() -> Column:
    """Hidden sub-cause where there is one, else the reason."""
    return F.coalesce("latent_subcause_id", "error_reason")
