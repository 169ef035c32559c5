"""Time the headline queries on one parquet folder and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tillwatch.session import build_session

HEADLINES = [
    "root_cause_labels", "template_hash_labels", "mined_templates", "density_clusters",
    "burst_scores_fixed_threshold", "burst_scores_rolling_zscore", "burst_scores_poisson_surprise",
    "burst_scores_ewma_zscore", "incidents_poisson_surprise", "incidents_reason_scoped", "detector_report",
    "active_incident_flags", "true_windows", "correlated_downtimes", "routing_stats", "decisions",
    "guardrail_fires", "execution_outcomes", "reference_id_check",
    "audit_verification", "deduplicated_webhooks", "masked_descriptions", "masked_documents", "cluster_metrics",
    "normalised_signals",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINES
    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("OFF")
    from tillwatch.catalog import QUERIES

    seconds, failed = {}, {}
    for name in names:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        except Exception as problem:  # one failing query must not cost the figures of the others
            failed[name] = f"{type(problem).__name__}: {problem}".splitlines()[0][:200]
            continue
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
        **({"failed": failed} if failed else {}),
    }))
    spark.stop()
    if failed:
        sys.exit(1)


if __name__ == "__main__":
    main()
