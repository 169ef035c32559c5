import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions.poisson import poisson_tail, poisson_tail_value
from tillwatch.functions.timegrid import floor_to_bucket, index_on_grid
from tillwatch.operators import intervals
from tillwatch.operators.detectors import ewma_step, ewma_zscore, fixed_threshold, poisson_surprise, rolling_zscore
from tillwatch.operators.incidents import detect_incidents, flag_active_incidents, incident_buckets, summarise_incidents
from tillwatch.operators.scoring import select_winner, true_windows
from tillwatch.operators.series import bucket_counts, dense_series

START = dt.datetime(2026, 1, 1)


def sparse(spark, counts, method="upi", bank="Axis Bank"):
    rows = [(method, bank, i, n, 0) for i, n in enumerate(counts) if n]
    return spark.createDataFrame(rows, "method string, bank string, idx long, n long, origin long")


def dense(spark, counts):
    rows = [("upi", "Axis Bank", i, n, 0) for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "method string, bank string, idx long, n long, origin long")


def found(series, detector=fixed_threshold, **options):
    buckets = incident_buckets(detector(series, **options), max_gap=options.get("max_gap", 1))
    rows = summarise_incidents(buckets, detector.__name__).orderBy("start").collect()
    return [(r.total_count, r.n_buckets) for r in rows]


@pytest.mark.parametrize("counts, expected", [
    ([3, 0, 3], [(6, 3)]), ([3, 0, 0, 3], [(3, 1), (3, 1)]), ([5, 0, 0], [(5, 1)]), ([3, 1, 3], [(7, 3)]), ([1, 3, 1, 1, 3], [(3, 1), (3, 1)]),
])
def test_gap_cases(spark, counts, expected):
    assert found(sparse(spark, counts), threshold=2) == expected
    assert found(dense(spark, counts), threshold=2) == expected


def test_wider_gap(spark):
    buckets = incident_buckets(fixed_threshold(sparse(spark, [3, 1, 0, 3, 0, 0, 0, 4]), threshold=2), max_gap=2)
    rows = summarise_incidents(buckets, "x").orderBy("start").collect()
    assert [(r.total_count, r.n_buckets) for r in rows] == [(7, 4), (4, 1)]


def naive_trailing(counts, score):
    out = []
    for i, n in enumerate(counts):
        past = counts[max(0, i - K.HISTORY_BUCKETS):i]
        out.append((0.0, False) if len(past) < K.MIN_HISTORY else score(n, past))
    return out


def naive_z(n, past):
    mean = sum(past) / len(past)
    sd = math.sqrt(max(0.0, sum(x * x for x in past) / len(past) - mean * mean))
    return (n - mean, n > mean) if sd < K.ZERO_SD else ((n - mean) / sd, (n - mean) / sd > K.Z_THRESHOLD)


def naive_poisson(n, past):
    rate = (sum(past) + 1) / (len(past) + 1)
    p = 1.0 - sum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(n))
    p = min(1.0, max(0.0, p))
    return -math.log(max(p, 1e-300)), p < K.P_THRESHOLD


def naive_ewma(counts):
    mean = var = 0.0
    out = []
    for i, n in enumerate(counts):
        sd = math.sqrt(var)
        out.append((0.0, False) if i < K.MIN_HISTORY else (n - mean, n > mean) if sd < K.ZERO_SD else ((n - mean) / sd, (n - mean) / sd > K.Z_THRESHOLD))
        gap = n - mean
        mean += K.EWMA_ALPHA * gap
        var = (1 - K.EWMA_ALPHA) * (var + K.EWMA_ALPHA * gap * gap)
    return out


@pytest.mark.parametrize("detector, naive", [
    (rolling_zscore, lambda c: naive_trailing(c, naive_z)), (poisson_surprise, lambda c: naive_trailing(c, naive_poisson)), (ewma_zscore, naive_ewma),
])
@pytest.mark.parametrize("form", [sparse, dense])
def test_detectors_match_naive(spark, detector, naive, form):
    rng = random.Random(7)
    counts = [rng.choice([0, 0, 0, 1, 2, 5]) for _ in range(90)]
    counts[45] = 80
    counts[60:75] = [0] * 15
    expected = naive(counts)
    for row in detector(form(spark, counts)).collect():
        score, burst = expected[row.idx]
        assert row.is_burst == burst
        if score < 30:
            assert row.score == pytest.approx(score, abs=1e-6)


def test_quiet_buckets_are_never_bursts():
    rng = random.Random(3)
    counts = [rng.choice([0, 0, 1, 4]) for _ in range(300)]
    for naive in (lambda c: naive_trailing(c, naive_z), lambda c: naive_trailing(c, naive_poisson), naive_ewma):
        assert not any(burst for (_, burst), n in zip(naive(counts), counts, strict=True) if n == 0)


def test_ewma_updates_during_warm_up(spark):
    counts = [10] * 8 + [1]
    row = ewma_zscore(sparse(spark, counts)).filter("idx = 8").first()
    assert row.score == pytest.approx(naive_ewma(counts)[8][0]) and row.score < 0


def test_poisson_tail_small_and_large(spark):
    rows = [(k, rate) for k in (0, 1, 7, 100, 101, 400, 5000) for rate in (0.1, 6.0, 95.0, 380.0, 4900.0)]
    df = spark.createDataFrame(rows, "k long, rate double").withColumn("p", poisson_tail(F.col("k"), F.col("rate")))
    for row in df.collect():
        exact = max(0.0, 1.0 - math.fsum(math.exp(i * math.log(row.rate) - row.rate - math.lgamma(i + 1)) for i in range(row.k)))
        assert row.p == pytest.approx(exact, abs=1e-10)
        assert poisson_tail_value(row.k, row.rate) == pytest.approx(exact, abs=1e-10)


def failures_of(spark, rows):
    return spark.createDataFrame(
        rows, "payment_id string, method string, bank string, error_reason string, created_at timestamp_ntz, downtime_window_id string, split string"
    )


def test_wallet_failures_share_one_entity(spark):
    rows = [(f"p{i}", "wallet", bank, "r", START, "w1", "train") for i, bank in enumerate(["Axis Bank", "Yes Bank"])]
    df = failures_of(spark, rows)
    assert [tuple(r) for r in bucket_counts(df).select("method", "bank", "n").collect()] == [("wallet", None, 2)]
    window = true_windows(df).first()
    assert window.bank is None and window.end - window.start == dt.timedelta(microseconds=1)


def test_window_over_two_entities_is_an_error(spark):
    rows = [("p1", "upi", "Axis Bank", "r", START, "w1", "train"), ("p2", "upi", "Yes Bank", "r", START, "w1", "train")]
    with pytest.raises(Exception, match="several entities"):
        true_windows(failures_of(spark, rows)).collect()


def test_dense_series_fills_shared_grid(spark):
    at = [START, START + dt.timedelta(minutes=46), START + dt.timedelta(minutes=16)]
    rows = [("p0", "upi", "Axis Bank", "r", at[0], None, "t"), ("p1", "upi", "Axis Bank", "r", at[1], None, "t"), ("p2", "upi", "Yes Bank", "r", at[2], None, "t")]
    series = dense_series(bucket_counts(failures_of(spark, rows))).orderBy("bank", "bucket_start").collect()
    assert [(r.bank, r.n) for r in series] == [("Axis Bank", n) for n in (1, 0, 0, 1)] + [("Yes Bank", n) for n in (0, 1, 0, 0)]


def test_floor_and_grid_index(spark):
    df = spark.sql("select timestamp_ntz'2026-01-01 00:29:59.999999' a, timestamp_ntz'1969-12-31 23:59:00' b")
    row = df.select(floor_to_bucket(F.col("a")).alias("a"), floor_to_bucket(F.col("b")).alias("b")).first()
    assert row.a == dt.datetime(2026, 1, 1, 0, 15) and row.b == dt.datetime(1969, 12, 31, 23, 45)
    with pytest.raises(Exception, match="precedes the grid"):
        df.select(index_on_grid(F.col("b"), F.col("a"))).collect()


def incident_at(spark, *spans):
    rows = [(m, b, n, s, e) for n, (m, b, s, e) in enumerate(spans)]
    return spark.createDataFrame(rows, "method string, bank string, incident_no long, start timestamp_ntz, end timestamp_ntz")


def test_closest_downtime_wins_and_banks_are_wildcards(spark):
    h = dt.timedelta(hours=1)
    found_at = incident_at(spark, ("upi", "Axis Bank", START + 5 * h, START + 6 * h), ("card", "Yes Bank", START, START + h))
    down = spark.createDataFrame(
        [("far", "upi", "Axis Bank", START, None, 0), ("near", "upi", None, START + 4.5 * h, None, 1), ("other", "upi", "Yes Bank", START + 5 * h, None, 2)],
        "id string, method string, bank string, begin timestamp_ntz, end timestamp_ntz, ordinal int",
    )
    rows = {r.method: r for r in intervals.correlate_downtimes(found_at, down, ["method", "bank", "incident_no"]).collect()}
    assert rows["upi"].downtime_id == "near" and rows["upi"].lead_minutes == 30.0
    assert rows["card"].downtime_id is None and rows["card"].lead_minutes is None


@pytest.mark.parametrize("block", [1, 3, 64])
def test_ewma_scan_equals_the_recurrence(spark, block):
    """Blocks folded apart against one step after the other: long silences, steady counts, rows before the epoch."""
    rng = random.Random(block)
    rows = []
    for bank in ("Axis Bank", None):
        at = -500
        for _ in range(120):
            at += rng.choice([1, 1, 1, 2, 5, 40, 700])
            rows.append(("upi", bank, at, rng.choice([1, 3, 3, 3, 9, 4000]), -510))
    table = spark.createDataFrame(rows, "method string, bank string, idx long, n long, origin long")
    got = {(r.bank, r.idx): (r.score, r.is_burst) for r in ewma_zscore(table, block=block).collect()}
    for bank in ("Axis Bank", None):
        mean = variance = 0.0
        at = -510
        for _, _, idx, n, origin in (r for r in rows if r[1] == bank):
            base, spread, mean, variance = ewma_step(mean, variance, float(n), idx - at, 0.2)
            at, sd = idx + 1, math.sqrt(spread)
            score = (n - base if sd < 1e-9 else (n - base) / sd) if idx - origin >= K.MIN_HISTORY else 0.0
            assert got[bank, idx][0] == pytest.approx(score, rel=1e-7)
    assert len(got) == len(rows)


def test_correlation_equals_brute_force_over_nested_open_and_repeated_downtimes(spark):
    rng = random.Random(9)
    banks, found, down = ["Axis Bank", "HDFC Bank", None], [], []
    for k in range(150):
        s = START + dt.timedelta(minutes=15 * rng.randrange(0, 3000))
        found.append((rng.choice(["upi", "card"]), rng.choice(banks), k, s, s + dt.timedelta(minutes=rng.choice([15, 90, 4000]))))
    for k in range(200):
        s = START + dt.timedelta(minutes=5 * rng.randrange(-500, 9000))
        e = None if k % 9 == 0 else s + dt.timedelta(minutes=rng.choice([0, 1, 20, 60, 700, 30_000, 900_000]))
        down.append((f"d{k:03}", rng.choice(["upi", "card", "wallet"]), rng.choice(banks), s, e, rng.randrange(20) * 1000 + k))
    incidents = spark.createDataFrame(found, "method string, bank string, incident_no long, start timestamp_ntz, end timestamp_ntz")
    declared = spark.createDataFrame(down, "id string, method string, bank string, begin timestamp_ntz, end timestamp_ntz, ordinal long")
    got = {r.incident_no: (r.downtime_id, r.lead_minutes) for r in intervals.correlate_downtimes(incidents, declared, ["method", "bank", "incident_no"]).collect()}
    for method, bank, no, start, end in found:
        near = [
            (abs((b - start).total_seconds()), o, i, (start - b).total_seconds() / 60) for i, m, k, b, e, o in down
            if m == method and (bank is None or k is None or bank == k) and b < end and start < (e or b + dt.timedelta(days=3650))
        ]
        best = min(near, default=None)
        assert got[no] == ((best[2], best[3]) if best else (None, None))


def test_an_open_downtime_takes_few_bins(spark):
    row = spark.sql("SELECT unix_micros(timestamp'2024-02-01') AS a, unix_micros(timestamp'2034-01-29') AS b")
    sizes = row.select(F.size(intervals.at_home(F.col("a"), F.col("b"))), F.size(intervals.at_all_levels(F.col("a"), F.col("b")))).first()
    assert sizes[0] <= 2 and sizes[1] < 10


def test_overlap_join_reports_each_pair_once(spark):
    rng = random.Random(5)
    def spans(n):
        out = []
        for _ in range(n):
            s = START + dt.timedelta(minutes=rng.randrange(0, 20_000))
            out.append((rng.choice(["upi", "wallet"]), rng.choice(["Axis Bank", None]), s, s + dt.timedelta(minutes=rng.choice([1, 700, 4000]))))
        return out
    a, b = spans(60), spans(60)
    got = intervals.overlap_join(incident_at(spark, *a), incident_at(spark, *b), ["method", "bank"]).select("l_incident_no", "r_incident_no").collect()
    expected = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[:2] == y[:2] and x[2] < y[3] and y[2] < x[3]]
    assert sorted(map(tuple, got)) == expected


def test_membership_equals_span_lookup(failures):
    detector = rolling_zscore
    from tillwatch.operators.incidents import flag_members, member_buckets

    flagged = flag_members(failures, member_buckets(failures, detector)).filter("in_active_incident").select("payment_id")
    spans = {}
    for r in detect_incidents(failures, detector).collect():
        spans.setdefault((r.method, r.bank), []).append((r.start, r.end))
    scoped = [(r.payment_id, (r.method, r.bank if r.method in K.BANK_SCOPED_METHODS else None), r.created_at) for r in failures.collect()]
    expected = {p for p, key, at in scoped if any(s <= at < e for s, e in spans.get(key, []))}
    assert {r.payment_id for r in flagged.collect()} == expected
    assert flag_active_incidents(failures).count() == failures.count()


def test_winner_ties(spark):
    rows = [("a", "test", 0.5, 0.2), ("b", "test", 0.5, 0.1), ("c", "test", None, 0.0), ("d", "train", 0.9, 0.0)]
    df = spark.createDataFrame(rows, "detector string, split string, f1 double, background_false_positive_rate double")
    assert select_winner(df).first().detector == "b"
