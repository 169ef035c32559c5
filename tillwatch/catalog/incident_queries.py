"""Series, detectors, incidents and their scoring. The SQL works on the dense grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.catalog.base import query, rounded, significant, sql_rounded, sql_significant, sql_stamp, stamp
from tillwatch.catalog.sql_views import failures_cte, quoted, sql_list
from tillwatch.functions.prompts import incident_evidence
from tillwatch.functions.timegrid import (
    ENTITY, REASON_ENTITY, bucket_index, floor_to_bucket, index_on_grid,
)
from tillwatch.operators import incidents as I
from tillwatch.operators import intervals, scoring
from tillwatch.operators.detectors import DETECTORS, fixed_threshold
from tillwatch.operators.series import bucket_counts, dense_series, reason_histogram
from tillwatch.sources.failures import failures_from_tables, with_entity

LOW = {"threshold": 1}
OPTIONS = {"fixed_threshold": LOW}
FV = "WITH RECURSIVE " + failures_cte()


def dense_cte(split: str | None = None, reason: bool = False, name: str = "dense", base: str = "failures") -> str:
    """``dense(method, bank[, error_reason], idx, n, pos)`` on the grid of the whole input."""
    keys = "method, ebank" + (", error_reason" if reason else "")
    where = f"WHERE split = {quoted(split)}" if split else ""
    return f"""
{name}_src AS (SELECT * FROM {base} {where}),
{name}_cnt AS (SELECT {keys}, idx, count(*) AS n FROM {name}_src GROUP BY ALL),
{name}_grid AS (SELECT unnest(range(lo, hi + 1)) AS idx, lo FROM (SELECT min(idx) AS lo, max(idx) AS hi FROM {name}_src)),
{name} AS (
  SELECT e.*, g.idx, coalesce(c.n, 0) AS n, g.idx - g.lo AS pos
  FROM (SELECT DISTINCT {keys} FROM {name}_src) e CROSS JOIN {name}_grid g
  LEFT JOIN {name}_cnt c ON c.method = e.method AND c.ebank IS NOT DISTINCT FROM e.ebank AND c.idx = g.idx
    {"AND c.error_reason = e.error_reason" if reason else ""}
)"""


def scored_cte(detector: str, source: str = "dense", name: str = "scored", threshold: int = 1, reason: bool = False) -> str:
    part = "method, ebank" + (", error_reason" if reason else "")
    frame = f"OVER (PARTITION BY {part} ORDER BY idx ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING)"
    if detector == "fixed_threshold":
        return f"{name} AS (SELECT *, n::DOUBLE AS score, n > {threshold} AS is_burst FROM {source})"
    if detector == "poisson_surprise":
        return f"""
{name}_h AS (SELECT *, count(*) {frame} AS len, coalesce(sum(n) {frame}, 0) AS total FROM {source}),
{name}_r AS (SELECT *, (total + 1.0::DOUBLE) / (len + 1.0::DOUBLE) AS rate FROM {name}_h),
{name}_p AS (SELECT *, CASE WHEN len < 8 THEN NULL WHEN n = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  1.0::DOUBLE - list_sum(list_transform(range(n), lambda i: exp(i * ln(rate) - rate - lgamma(i + 1)))))) END AS p FROM {name}_r),
{name} AS (SELECT *, CASE WHEN p IS NULL THEN 0.0::DOUBLE ELSE -ln(greatest(p, 1e-300)) END AS score,
  coalesce(p < 0.001, false) AS is_burst FROM {name}_p)"""
    if detector == "rolling_zscore":
        return f"""
{name}_h AS (SELECT *, count(*) {frame} AS len, coalesce(sum(n) {frame}, 0)::DOUBLE AS s, coalesce(sum(n * n) {frame}, 0)::DOUBLE AS q FROM {source}),
{name}_m AS (SELECT *, CASE WHEN len >= 8 THEN s / len END AS mean,
  CASE WHEN len >= 8 THEN sqrt(greatest(0.0::DOUBLE, q / len - (s / len) * (s / len))) END AS sd FROM {name}_h),
{name} AS (SELECT *, CASE WHEN len < 8 THEN 0.0 WHEN sd < 1e-9 THEN n - mean ELSE (n - mean) / sd END AS score,
  CASE WHEN len < 8 THEN false WHEN sd < 1e-9 THEN n > mean ELSE (n - mean) / sd > 3.0 END AS is_burst FROM {name}_m)"""
    return f"""
{name}_w AS (
  SELECT method, ebank, idx, n, pos, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS var FROM {source} WHERE pos = 0
  UNION ALL
  SELECT d.method, d.ebank, d.idx, d.n, d.pos, w.mean + 0.2::DOUBLE * (w.n - w.mean),
    0.8::DOUBLE * (w.var + 0.2::DOUBLE * (w.n - w.mean) * (w.n - w.mean))
  FROM {name}_w w JOIN {source} d ON d.method = w.method AND d.ebank IS NOT DISTINCT FROM w.ebank AND d.pos = w.pos + 1
),
{name} AS (SELECT *, CASE WHEN pos < 8 THEN 0.0::DOUBLE WHEN sqrt(var) < 1e-9 THEN n - mean ELSE (n - mean) / sqrt(var) END AS score,
  CASE WHEN pos < 8 THEN false WHEN sqrt(var) < 1e-9 THEN n > mean ELSE (n - mean) / sqrt(var) > 3.0 END AS is_burst FROM {name}_w)"""


def islands_cte(source: str = "scored", name: str = "inc", reason: bool = False) -> str:
    """Islands of bursts by ``lag``, then totals from the dense rows between their ends."""
    part = "method, ebank" + (", error_reason" if reason else "")
    same = "s.method = i.method AND s.ebank IS NOT DISTINCT FROM i.ebank" + (" AND s.error_reason = i.error_reason" if reason else "")
    cols = "i.method, i.ebank" + (", i.error_reason" if reason else "")
    return f"""
{name}_b AS (SELECT {part}, idx, CASE WHEN idx - lag(idx) OVER (PARTITION BY {part} ORDER BY idx) <= 2 THEN 0 ELSE 1 END AS opens
  FROM {source} WHERE is_burst),
{name}_n AS (SELECT *, sum(opens) OVER (PARTITION BY {part} ORDER BY idx) AS incident_no FROM {name}_b),
{name}_s AS (SELECT {part}, incident_no::BIGINT AS incident_no, min(idx) AS a, max(idx) AS b FROM {name}_n GROUP BY ALL),
{name} AS (
  SELECT {cols}, i.incident_no, i.a, i.b, make_timestamp(i.a * 900000000) AS start_at,
    make_timestamp((i.b + 1) * 900000000) AS end_at, (i.b - i.a + 1)::BIGINT AS n_buckets,
    sum(s.n)::BIGINT AS total_count, max(s.score) AS peak_score
  FROM {name}_s i JOIN {source} s ON {same} AND s.idx BETWEEN i.a AND i.b GROUP BY ALL
)"""


INCIDENT_COLUMNS = ["method", "bank", "detector", "incident_no", "n_buckets", "total_count"]


def incident_rows(incidents):
    return incidents.select(*INCIDENT_COLUMNS, stamp("start"), stamp("end"), significant("peak_score"))


def incident_sql(detector: str) -> str:
    return (
        f"{FV}, {dense_cte()}, {scored_cte(detector)}, {islands_cte()} "
        f"SELECT method, ebank AS bank, '{detector}' AS detector, incident_no, n_buckets, total_count, "
        f"{sql_stamp('start_at', 'start')}, {sql_stamp('end_at', chr(34) + 'end' + chr(34))}, "
        f"{sql_significant('peak_score')} FROM inc"
    )


def _register_detectors() -> None:
    for name, detector in DETECTORS.items():
        def series(spark, sf, name=name, detector=detector):
            scored = detector(bucket_counts(failures_from_tables(spark, sf)), **OPTIONS.get(name, {}))
            return scored.select("method", "bank", "idx", "n", "is_burst", significant("score"))

        def found(spark, sf, name=name, detector=detector):
            return incident_rows(I.detect_incidents(failures_from_tables(spark, sf), detector, **OPTIONS.get(name, {})))

        query(f"burst_scores_{name}", (
            f"{FV}, {dense_cte()}, {scored_cte(name)} SELECT method, ebank AS bank, idx, n::BIGINT AS n, is_burst, "
            f"{sql_significant('score')} FROM scored WHERE n > 0"
        ))(series)
        query(f"incidents_{name}", incident_sql(name))(found)


_register_detectors()


@query("incidents_reason_scoped", (
    f"{FV}, {dense_cte(reason=True)}, {scored_cte('fixed_threshold', reason=True, threshold=0)}, {islands_cte(reason=True)} "
    f"SELECT method, ebank AS bank, error_reason, incident_no, n_buckets, total_count, "
    f"{sql_stamp('start_at', 'start')}, {sql_significant('peak_score')} FROM inc"
))
def incidents_reason_scoped(spark, sf):
    found = I.detect_incidents(failures_from_tables(spark, sf), fixed_threshold, REASON_ENTITY, threshold=0)
    return found.select(*REASON_ENTITY, "incident_no", "n_buckets", "total_count", stamp("start"), significant("peak_score"))


@query("failures_scan", (
    f"{FV} SELECT payment_id, order_id, customer_id, amount, method, {sql_stamp('created_at', 'created_at')}, "
    "attempt_number::BIGINT AS attempt_number, bank, vpa, card_bin, error_code, error_source, error_step, error_reason, "
    "description, latent_subcause_id, description_variant, downtime_window_id, split FROM failures"
))
def failures_scan(spark, sf):
    f = failures_from_tables(spark, sf)
    return f.drop("is_outlier").withColumn("created_at", stamp("created_at")).withColumn(
        "attempt_number", F.col("attempt_number").cast("bigint")
    )


@query("entity_keys", (
    f"{FV} SELECT method, ebank AS bank, error_reason, count(*) AS n FROM failures GROUP BY ALL"
))
def entity_keys(spark, sf):
    return with_entity(failures_from_tables(spark, sf)).groupBy(*REASON_ENTITY).agg(F.count("*").alias("n"))


@query("time_grid", (
    f"{FV} SELECT payment_id, {sql_stamp('make_timestamp(idx * 900000000)', 'bucket')}, idx, "
    "idx - (SELECT min(idx) FROM failures) AS grid_index FROM failures"
))
def time_grid(spark, sf):
    f = failures_from_tables(spark, sf)
    origin = f.agg(F.min(floor_to_bucket(F.col("created_at")))).scalar()
    return f.select(
        "payment_id", floor_to_bucket(F.col("created_at")).alias("bucket"), bucket_index(F.col("created_at")).alias("idx"),
        index_on_grid(F.col("created_at"), origin).alias("grid_index"),
    ).withColumn("bucket", stamp("bucket"))


@query("entity_series_dense", (
    f"{FV}, {dense_cte()} SELECT method, ebank AS bank, {sql_stamp('make_timestamp(idx * 900000000)', 'bucket_start')}, "
    "n::BIGINT AS n FROM dense"
))
def entity_series_dense(spark, sf):
    dense = dense_series(bucket_counts(failures_from_tables(spark, sf)))
    return dense.select("method", "bank", stamp("bucket_start"), F.col("n").cast("bigint").alias("n"))


@query("reason_histogram", (
    f"{FV}, c AS (SELECT method, ebank, idx, error_reason, count(*) AS n FROM failures GROUP BY ALL) "
    "SELECT method, ebank AS bank, idx, string_agg(error_reason || '=' || n, ',' ORDER BY error_reason) AS reasons "
    "FROM c GROUP BY ALL"
))
def reason_histogram_query(spark, sf):
    text = F.array_join(F.transform(F.map_entries("reason_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return reason_histogram(failures_from_tables(spark, sf)).select("method", "bank", "idx", text.alias("reasons"))


ACTIVE = f"{dense_cte()}, {scored_cte('poisson_surprise')}, {islands_cte()}"
ACTIVE_JOIN = (
    "LEFT JOIN inc ON inc.method = f.method AND inc.ebank IS NOT DISTINCT FROM f.ebank AND f.idx BETWEEN inc.a AND inc.b"
)


@query("active_incident_flags", (
    f"{FV}, {ACTIVE} SELECT payment_id, inc.incident_no IS NOT NULL AS in_active_incident, inc.incident_no FROM failures f {ACTIVE_JOIN}"
))
def active_incident_flags(spark, sf):
    return I.flag_active_incidents(failures_from_tables(spark, sf)).select("payment_id", "in_active_incident", "incident_no")


@query("incident_reason_mix", (
    f"{FV}, {ACTIVE} SELECT f.method, f.ebank AS bank, inc.incident_no, error_reason, count(*) AS n FROM failures f "
    f"{ACTIVE_JOIN.replace('LEFT JOIN', 'JOIN')} GROUP BY ALL"
))
def incident_reason_mix(spark, sf):
    f = failures_from_tables(spark, sf)
    return I.incident_reason_mix(f, I.member_buckets(f))


@query("member_bucket_union", (
    f"{FV}, {dense_cte()}, {scored_cte('poisson_surprise', name='s1')}, {islands_cte('s1', 'i1')}, "
    f"{scored_cte('fixed_threshold', name='s2')}, {islands_cte('s2', 'i2')}, "
    "u AS (SELECT d.method, d.ebank, d.idx FROM dense d JOIN i1 ON i1.method = d.method AND i1.ebank IS NOT DISTINCT FROM d.ebank "
    "AND d.idx BETWEEN i1.a AND i1.b WHERE d.n > 0 UNION SELECT d.method, d.ebank, d.idx FROM dense d JOIN i2 ON i2.method = d.method "
    "AND i2.ebank IS NOT DISTINCT FROM d.ebank AND d.idx BETWEEN i2.a AND i2.b WHERE d.n > 0) "
    "SELECT method, ebank AS bank, idx FROM u"
))
def member_bucket_union(spark, sf):
    f = failures_from_tables(spark, sf)
    return I.union_of_members(I.member_buckets(f), I.member_buckets(f, fixed_threshold, **LOW))


WINDOWS = """
w0 AS (SELECT downtime_window_id AS window_id, min(split) AS split, min(method) AS method, min(ebank) AS ebank,
  min(created_at) AS start_at, max(created_at) + INTERVAL 1 MICROSECOND AS end_at, count(*) AS n_events,
  count(DISTINCT error_reason) AS n_distinct_reasons FROM failures WHERE downtime_window_id IS NOT NULL GROUP BY 1),
wr AS (SELECT downtime_window_id AS window_id, error_reason, count(*) AS n, min(created_at) AS fa, arg_min(payment_id, (created_at, payment_id)) AS fp
  FROM failures WHERE downtime_window_id IS NOT NULL GROUP BY ALL),
wt AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY n DESC, fa, fp) AS rn FROM wr),
win AS (SELECT w0.*, error_reason AS majority_reason, n / n_events::DOUBLE AS majority_share, n_events - n AS invisible_events
  FROM w0 JOIN wt USING (window_id) WHERE rn = 1)"""


@query("true_windows", (
    f"{FV}, {WINDOWS} SELECT window_id, split, method, ebank AS bank, {sql_stamp('start_at', 'start')}, "
    f"{sql_stamp('end_at', chr(34) + 'end' + chr(34))}, n_events, n_distinct_reasons, majority_reason, "
    f"{sql_rounded('majority_share')} FROM win"
))
def true_windows(spark, sf):
    return scoring.true_windows(failures_from_tables(spark, sf)).select(
        "window_id", "split", "method", "bank", stamp("start"), stamp("end"), "n_events", "n_distinct_reasons",
        "majority_reason", *rounded("majority_share"),
    )


CROSS = """count(*) AS n_windows, count(*) FILTER (n_distinct_reasons > 1) AS n_multi_reason_windows,
  round((count(*) FILTER (n_distinct_reasons > 1)) / count(*)::DOUBLE, 6) AS multi_reason_fraction,
  round(avg(1 - majority_share) FILTER (n_distinct_reasons > 1), 6) AS mean_invisible_fraction,
  round(quantile_cont(1 - majority_share, 0.5) FILTER (n_distinct_reasons > 1), 6) AS median_invisible_fraction,
  coalesce(sum(n_events) FILTER (n_distinct_reasons > 1), 0)::BIGINT AS multi_reason_events,
  coalesce(sum(invisible_events) FILTER (n_distinct_reasons > 1), 0)::BIGINT AS invisible_events,
  round(sum(invisible_events) FILTER (n_distinct_reasons > 1) / sum(n_events) FILTER (n_distinct_reasons > 1)::DOUBLE, 6)
    AS overall_invisible_fraction"""


@query("cross_reason_summary", (
    f"{FV}, {WINDOWS} SELECT 'all' AS scope, {CROSS} FROM win UNION ALL SELECT split, {CROSS} FROM win GROUP BY split"
))
def cross_reason_summary(spark, sf):
    fractions = ["multi_reason_fraction", "mean_invisible_fraction", "median_invisible_fraction", "overall_invisible_fraction"]
    summary = scoring.cross_reason_summary(scoring.true_windows(failures_from_tables(spark, sf)))
    return summary.select(*[c for c in summary.columns if c not in fractions], *rounded(*fractions))


LOW_INC = f"{dense_cte()}, {scored_cte('rolling_zscore')}, {islands_cte()}"
PAIRS = ("p AS (SELECT win.window_id, inc.* FROM win JOIN inc ON win.method = inc.method AND win.ebank IS NOT DISTINCT FROM inc.ebank "
         "AND inc.start_at < win.end_at AND win.start_at < inc.end_at)")


def _zscore_pair(spark, sf):
    f = failures_from_tables(spark, sf)
    return scoring.true_windows(f), I.detect_incidents(f, DETECTORS["rolling_zscore"])


@query("window_overlaps", (
    f"{FV}, {WINDOWS}, {LOW_INC}, {PAIRS} SELECT window_id, method, ebank AS bank, incident_no, "
    f"{sql_stamp('start_at', 'incident_start')} FROM p"
))
def window_overlaps(spark, sf):
    windows, found = _zscore_pair(spark, sf)
    pairs = intervals.overlap_join(windows, found, ["method", "bank"])
    return pairs.select(
        F.col("l_window_id").alias("window_id"), F.col("r_method").alias("method"), F.col("r_bank").alias("bank"),
        F.col("r_incident_no").alias("incident_no"), F.col("r_start").alias("incident_start"),
    ).withColumn("incident_start", stamp("incident_start"))


@query("confirmed_incidents", (
    f"{FV}, {WINDOWS}, {LOW_INC}, {PAIRS} SELECT DISTINCT method, ebank AS bank, incident_no FROM p"
))
def confirmed_incidents(spark, sf):
    windows, found = _zscore_pair(spark, sf)
    return intervals.confirmed_incidents(found, windows).select("method", "bank", "incident_no")


@query("fragments_per_window", (
    f"{FV}, {WINDOWS}, {LOW_INC}, {PAIRS} SELECT win.window_id, count(p.incident_no) AS fragments FROM win LEFT JOIN p "
    "USING (window_id) GROUP BY 1"
))
def fragments_per_window(spark, sf):
    windows, found = _zscore_pair(spark, sf)
    return intervals.fragments_per_window(windows, found).select("window_id", "fragments")


DECLARED = f"""dec AS (SELECT 'down_' || window_id AS id, method, ebank, start_at AS begin_at, end_at, window_id AS ordinal,
  CASE WHEN epoch_us(end_at) - epoch_us(start_at) >= 7200000000 THEN 'high'
       WHEN epoch_us(end_at) - epoch_us(start_at) >= 3600000000 THEN 'medium' ELSE 'low' END AS severity
  FROM win WHERE method IN ({sql_list(K.DOWNTIME_METHODS)}))"""


@query("declared_downtimes", (
    f"{FV}, {WINDOWS}, {DECLARED} SELECT id, method, ebank AS bank, {sql_stamp('begin_at', chr(34) + 'begin' + chr(34))}, severity FROM dec"
))
def declared_downtimes(spark, sf):
    declared = scoring.declared_downtimes(scoring.true_windows(failures_from_tables(spark, sf)))
    return declared.select("id", "method", "bank", stamp("begin"), "severity")


def _open_ended(declared):
    """Some downtimes without end or bank, so that both wildcards are exercised."""
    still_open = F.pmod(F.length("ordinal") + F.hour("begin"), F.lit(5)) == 0
    return declared.withColumn("end", F.when(~still_open, F.col("end"))).withColumn(
        "bank", F.when(F.minute("begin") >= 10, F.col("bank"))
    )


CORRELATED = """dec2 AS (SELECT id, method, CASE WHEN minute(begin_at) >= 10 THEN ebank END AS ebank, begin_at, ordinal,
  CASE WHEN (length(ordinal) + hour(begin_at)) % 5 = 0 THEN begin_at + INTERVAL 3650 DAYS ELSE end_at END AS until FROM dec),
cor AS (SELECT inc.method, inc.ebank, inc.incident_no, dec2.id, (epoch_us(inc.start_at) - epoch_us(dec2.begin_at)) / 60000000.0 AS lead,
  row_number() OVER (PARTITION BY inc.method, inc.ebank, inc.incident_no
    ORDER BY abs(epoch_us(dec2.begin_at) - epoch_us(inc.start_at)), dec2.ordinal) AS rn
  FROM inc LEFT JOIN dec2 ON dec2.method = inc.method AND (inc.ebank IS NULL OR dec2.ebank IS NULL OR inc.ebank = dec2.ebank)
    AND inc.start_at < dec2.until AND dec2.begin_at < inc.end_at)"""


@query("correlated_downtimes", (
    f"{FV}, {WINDOWS}, {DECLARED}, {LOW_INC}, {CORRELATED} SELECT method, ebank AS bank, incident_no, id AS downtime_id, "
    "round(lead::DOUBLE, 6) AS lead_minutes FROM cor WHERE rn = 1"
))
def correlated_downtimes(spark, sf):
    windows, found = _zscore_pair(spark, sf)
    matched = intervals.correlate_downtimes(found, _open_ended(scoring.declared_downtimes(windows)), ["method", "bank", "incident_no"])
    return matched.select("method", "bank", "incident_no", "downtime_id", *rounded("lead_minutes"))


@query("corroboration_summary", (
    f"{FV}, {WINDOWS}, {DECLARED}, {LOW_INC}, {CORRELATED} SELECT (SELECT count(*) FROM dec) AS n_declared_downtimes, "
    f"count(*) AS n_detected_incidents, count(*) FILTER (method IN ({sql_list(K.DOWNTIME_METHODS)})) AS n_correlatable, "
    f"count(*) FILTER (method NOT IN ({sql_list(K.DOWNTIME_METHODS)})) AS n_never_correlatable, count(id) AS n_corroborated, "
    f"round(count(id) / nullif(count(*) FILTER (method IN ({sql_list(K.DOWNTIME_METHODS)})), 0)::DOUBLE, 6) AS corroboration_rate "
    "FROM cor WHERE rn = 1"
))
def corroboration_summary(spark, sf):
    windows, found = _zscore_pair(spark, sf)
    summary = scoring.corroboration_summary(found, _open_ended(scoring.declared_downtimes(windows)), ["method", "bank", "incident_no"])
    return summary.withColumn("corroboration_rate", F.round("corroboration_rate", 6))


@query("incident_evidence", (
    f"{FV}, {ACTIVE}, m AS (SELECT f.method, f.ebank, inc.incident_no, error_reason, count(*) AS n FROM failures f "
    f"{ACTIVE_JOIN.replace('LEFT JOIN', 'JOIN')} GROUP BY ALL), "
    "t AS (SELECT method, ebank, incident_no, string_agg('  - ' || error_reason || ': ' || n, chr(10) ORDER BY n DESC, error_reason) AS lines "
    "FROM m GROUP BY ALL) SELECT inc.method, inc.ebank AS bank, inc.incident_no, 'Payment method: ' || inc.method || chr(10) || 'Bank: ' || "
    "coalesce(inc.ebank, '(not bank-scoped)') || chr(10) || 'Detector: poisson_surprise' || chr(10) || 'Start (UTC): ' || "
    "strftime(start_at, '%Y-%m-%dT%H:%M:%S') || chr(10) || 'End (UTC): ' || strftime(end_at, '%Y-%m-%dT%H:%M:%S') || chr(10) || "
    "'Failures: ' || total_count || chr(10) || 'Peak score: ' || format('{:.3f}', peak_score) || chr(10) || 'Reasons:' || chr(10) || lines "
    f"|| chr(10) || 'Postures: {', '.join(sorted(K.POSTURES))}' AS evidence FROM inc JOIN t ON t.method = inc.method AND "
    "t.ebank IS NOT DISTINCT FROM inc.ebank AND t.incident_no = inc.incident_no"
))
def incident_evidence_query(spark, sf):
    f = failures_from_tables(spark, sf)
    mix = I.incident_reason_mix(f, I.member_buckets(f)).groupBy("method", "bank", "incident_no").agg(
        F.map_from_entries(F.collect_list(F.struct("error_reason", "n"))).alias("reason_counts")
    )
    renamed = mix.select(F.col("method").alias("m"), F.col("bank").alias("b"), F.col("incident_no").alias("i"), "reason_counts")
    found = I.detect_incidents(f)
    joined = found.join(renamed, (F.col("method") == F.col("m")) & F.col("bank").eqNullSafe(F.col("b")) & (F.col("incident_no") == F.col("i")))
    return joined.select("method", "bank", "incident_no", incident_evidence().alias("evidence"))


REPORT_RATIOS = ["precision", "recall", "f1", "event_attribution_accuracy", "background_false_positive_rate", "ttd_min",
                 "ttd_p25", "ttd_median", "ttd_p75", "ttd_max", "ttd_mean", "mean_fragments", "median_fragments", "share_fragmented"]


def report_parts(prefix: str = "", reason: bool = False, names=tuple(DETECTORS)) -> tuple[str, str]:
    """CTEs and SELECT of the detector report, one branch per detector and split."""
    ctes, selects = [], []
    part = "d.method = i.method AND d.ebank IS NOT DISTINCT FROM i.ebank" + (" AND d.error_reason = i.error_reason" if reason else "")
    for split in ("train", "test"):
        ctes.append(dense_cte(split, reason, f"d_{split}"))
        for name in names:
            tag = f"{name}_{split}"
            ctes.append(scored_cte(name, f"d_{split}", f"s_{tag}", 1, reason))
            ctes.append(islands_cte(f"s_{tag}", f"i_{tag}", reason))
            ctes.append(f"""
p_{tag} AS (SELECT w.window_id, i.* FROM win w JOIN i_{tag} i ON w.split = '{split}' AND w.method = i.method AND w.ebank IS NOT DISTINCT FROM i.ebank
  AND i.start_at < w.end_at AND w.start_at < i.end_at),
j_{tag} AS (SELECT w.window_id, count(p.incident_no) AS fragments, CASE WHEN count(p.incident_no) > 0 THEN
  greatest(0.0, (epoch_us(min(p.start_at)) - epoch_us(min(w.start_at))) / 60000000.0)::DOUBLE END AS delay
  FROM win w LEFT JOIN p_{tag} p USING (window_id) WHERE w.split = '{split}' GROUP BY 1),
e_{tag} AS (SELECT d.payment_id, d.downtime_window_id, bool_or(i.incident_no IS NOT NULL) AS inside FROM failures d
  LEFT JOIN i_{tag} i ON {part} AND d.idx BETWEEN i.a AND i.b WHERE d.split = '{split}' GROUP BY ALL)""")
            distinct = "method, ebank, incident_no" + (", error_reason" if reason else "")
            selects.append(f"""
SELECT '{prefix}{name}' AS detector, '{split}' AS split, (SELECT count(*) FROM (SELECT DISTINCT method, ebank{', error_reason' if reason else ''} FROM d_{split})) AS n_entities,
  (SELECT count(*) FROM j_{tag}) AS n_true_windows, (SELECT count(*) FROM i_{tag}) AS n_detected_incidents,
  (SELECT count(*) FROM j_{tag} WHERE fragments > 0) AS n_true_positive_windows,
  (SELECT count(*) FROM (SELECT DISTINCT {distinct} FROM p_{tag})) AS n_true_positive_incidents,
  (SELECT avg(inside::INT) FROM e_{tag} WHERE downtime_window_id IS NOT NULL) AS event_attribution_accuracy,
  (SELECT avg(inside::INT) FROM e_{tag} WHERE downtime_window_id IS NULL) AS background_false_positive_rate,
  min(delay) AS ttd_min, quantile_cont(delay, 0.25) AS ttd_p25, quantile_cont(delay, 0.5) AS ttd_median,
  quantile_cont(delay, 0.75) AS ttd_p75, max(delay) AS ttd_max, avg(delay) AS ttd_mean, avg(fragments) AS mean_fragments,
  quantile_cont(fragments::DOUBLE, 0.5) AS median_fragments, max(fragments)::BIGINT AS max_fragments, avg((fragments > 1)::INT) AS share_fragmented
FROM j_{tag}""")
    body = " UNION ALL ".join(selects)
    ratios = """rep1 AS (SELECT *, n_true_positive_incidents / nullif(n_detected_incidents, 0)::DOUBLE AS precision,
      n_true_positive_windows / nullif(n_true_windows, 0)::DOUBLE AS recall FROM rep0),
    rep AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM rep1)"""
    return ", ".join(ctes), f"rep0 AS ({body}), {ratios}"


COUNTS = ["n_entities", "n_true_windows", "n_detected_incidents", "n_true_positive_windows", "n_true_positive_incidents", "max_fragments"]
CTES, REP = report_parts()
REPORT_BASE = f"{FV}, {WINDOWS}, {CTES}, {REP}"


def report_rows(report):
    return report.select("detector", "split", *[F.col(c).cast("bigint").alias(c) for c in COUNTS], *rounded(*REPORT_RATIOS))


@query("detector_report", f"{REPORT_BASE} SELECT detector, split, {', '.join(COUNTS)}, {sql_rounded(*REPORT_RATIOS)} FROM rep")
def detector_report(spark, sf):
    return report_rows(scoring.detector_report(failures_from_tables(spark, sf), options=OPTIONS))


@query("detector_winner", (
    f"{REPORT_BASE} SELECT detector, round(f1, 6) AS f1 FROM rep WHERE split = 'test' "
    "ORDER BY coalesce(f1, -1) DESC, coalesce(background_false_positive_rate, 1.0), detector LIMIT 1"
))
def detector_winner(spark, sf):
    report = scoring.detector_report(failures_from_tables(spark, sf), options=OPTIONS)
    return scoring.select_winner(report).select("detector", *rounded("f1"))


R_CTES, R_REP = report_parts("groupby_reason+", True, ("fixed_threshold",))


@query("detector_report_reason_scoped", (
    f"{FV}, {WINDOWS}, {R_CTES}, {R_REP} SELECT detector, split, {', '.join(COUNTS)}, {sql_rounded(*REPORT_RATIOS)} FROM rep"
))
def detector_report_reason_scoped(spark, sf):
    report = scoring.detector_report(
        failures_from_tables(spark, sf), REASON_ENTITY, OPTIONS, ("fixed_threshold",), "groupby_reason+"
    )
    return report_rows(report)


def _members(spark, sf, labelled: bool):
    f = failures_from_tables(spark, sf)
    flagged = I.flag_members(f, I.member_buckets(f, DETECTORS["rolling_zscore"])).filter("in_active_incident")
    return flagged.filter(F.col("downtime_window_id").isNotNull() if labelled else F.col("downtime_window_id").isNull()).select("payment_id")


MEMBERS = f"{FV}, {LOW_INC} SELECT DISTINCT payment_id FROM failures f {ACTIVE_JOIN.replace('LEFT JOIN', 'JOIN')}"


@query("detected_labelled_failures", f"{MEMBERS} WHERE downtime_window_id IS NOT NULL")
def detected_labelled_failures(spark, sf):
    return _members(spark, sf, True)


@query("detected_background_failures", f"{MEMBERS} WHERE downtime_window_id IS NULL")
def detected_background_failures(spark, sf):
    return _members(spark, sf, False)


__all__ = ["ACTIVE", "ACTIVE_JOIN", "ENTITY", "FV"]
