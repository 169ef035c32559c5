"""Evidence texts for an external answerer. Building the text is all that happens here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwatch import constants as K


def incident_evidence() -> Column:
    """Over method, bank, detector, start, end, total_count, peak_score and reason_counts (map):
    the incident in words, reasons by falling count and then by name."""
    entries = F.array_sort(
        F.transform(F.map_entries("reason_counts"), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("reason")))
    )
    lines = F.transform(entries, lambda e: F.concat(F.lit("  - "), e["reason"], F.lit(": "), (-e["minus"]).cast("string")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Payment method: "), F.col("method")),
        F.concat(F.lit("Bank: "), F.coalesce("bank", F.lit("(not bank-scoped)"))),
        F.concat(F.lit("Detector: "), F.col("detector")),
        F.concat(F.lit("Start (UTC): "), F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss")),
        F.concat(F.lit("End (UTC): "), F.date_format("end", "yyyy-MM-dd'T'HH:mm:ss")),
        F.concat(F.lit("Failures: "), F.col("total_count").cast("string")),
        F.concat(F.lit("Peak score: "), F.format_string("%.3f", F.col("peak_score"))),
        F.lit("Reasons:"), F.concat_ws("\n", lines),
        F.lit("Postures: " + ", ".join(sorted(K.POSTURES))),
    )


def reason_evidence() -> Column:
    """Over reason and contexts (array of rows): what is known about an escalated reason."""
    rows = F.transform(
        "contexts",
        lambda c, i: F.concat_ws(
            "\n",
            F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(" explanation: "), c["explanation"]),
            F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(" next steps: "), c["next_steps"]),
            F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(" candidates: "), F.concat_ws(", ", c["candidate_classes"])),
            F.when(c["note"].isNotNull(), F.concat(F.lit("Note: "), c["note"])),
        ),
    )
    return F.concat_ws(
        "\n", F.concat(F.lit("Reason: "), F.col("reason")), F.concat_ws("\n", rows),
        F.lit("Classes: " + ", ".join(sorted(K.REMEDIATION_CLASSES))),
    )
