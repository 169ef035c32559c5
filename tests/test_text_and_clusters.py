import datetime as dt
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions.taxonomy import infer_error_code, infer_source, infer_step
from tillwatch.functions.text import mask_description, normalise_template
from tillwatch.sources.failures import failures_from_tables
from tillwatch.operators import calls, clustering, corpus, metrics
from tillwatch.operators.components import connected_components
from tillwatch.plans import bakeoff

START = dt.datetime(2026, 1, 1)


@pytest.mark.parametrize("text, masked", [
    ("at 2026-01-02T03:04:05Z for Rs.1,234.50", "at <TIMESTAMP>Z for <AMOUNT>"),
    ("pay_ABC123 order_ABC123 cust_ABC123 rfnd_ABC123", "<PAYMENT_ID> <ORDER_ID> <CUSTOMER_ID> <ID>"),
    ("a.b-c@okaxis RRN 123456789012 BIN 400012", "<VPA> RRN <RRN> BIN <CARD_BIN>"),
    ("via Union Bank of India, not UnionBank; inr 10.00", "via <BANK>, not UnionBank; <AMOUNT>"),
    ("12345678901 400012 pay_AB1", "12345678901 400012 pay_AB1"),
])
def test_masking(spark, text, masked):
    row = spark.createDataFrame([(text,)], "t string").select(mask_description(F.col("t")).alias("m")).first()
    # a trailing Z directly after the seconds is part of the timestamp
    assert row.m == masked.replace("<TIMESTAMP>Z", "<TIMESTAMP>")

SF = "/root/testdata/sf0.001"


def test_normalise(spark):
    row = spark.createDataFrame([("  A\t b \n C ",)], "t string").select(normalise_template(F.col("t")).alias("n")).first()
    assert row.n == "a b c"


def test_inference_rules(spark):
    df = spark.createDataFrame([
        ("x", "Bank CBS is down", "card", None, "wait"), ("server_error", "whatever", "upi", "collect", "customer_fix"),
        ("x", "capture of the mandate failed", "upi", "intent", "merchant_action"), ("x", "wrong OTP", "upi", "collect", "merchant_contact_razorpay"),
        ("x", "wrong OTP", "upi", "intent", None), ("x", "enrolled? authorised?", "netbanking", None, "retry_same"), ("x", "nothing", "wallet", None, None),
    ], "reason string, e string, m string, flow string, c string")
    got = df.select(infer_error_code(F.col("reason"), F.col("e")), infer_source(F.col("c"), F.col("m")), infer_step(F.col("e"), F.col("m"), F.col("flow"))).collect()
    assert [tuple(r) for r in got] == [
        ("GATEWAY_ERROR", "issuer_bank", "payment_initiation"), ("SERVER_ERROR", "customer", "payment_initiation"),
        ("BAD_REQUEST_ERROR", "business", "mandate_creation"), ("BAD_REQUEST_ERROR", "internal", "payment_authentication_request"),
        ("BAD_REQUEST_ERROR", "network", "payment_authentication"), ("BAD_REQUEST_ERROR", "issuer_bank", "payment_authorization"),
        ("BAD_REQUEST_ERROR", "issuer", "payment_initiation"),
    ]
    with pytest.raises(Exception, match="upi_flow"):
        spark.sql("select 'otp' e, 'upi' m, cast(null as string) f").select(infer_step(F.col("e"), F.col("m"), F.col("f"))).collect()


def texts(spark, values):
    rows = [(f"p{i:05d}", START + dt.timedelta(seconds=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "payment_id string, created_at timestamp_ntz, masked_description string")


def labels_of(df):
    return {r.payment_id: r.pred_label for r in df.collect()}


def test_template_hash_labels_in_first_seen_order(spark):
    got = labels_of(clustering.group_by_template(texts(spark, ["b x", "A  y", "a y ", "B X", "c"])))
    assert [got[k] for k in sorted(got)] == [0, 1, 1, 0, 2]


def naive_mining(values):
    """Greedy merge over distinct texts in first-seen order, per (length, leading token)."""
    groups, label = defaultdict(list), {}
    for text in dict.fromkeys(values):
        words = text.split()
        lead = "<*>" if re.search(r"\d", words[0]) else words[0]
        leaf = groups[len(words), lead]
        scores = [(sum(a == b for a, b in zip(g["t"], words) if a != "<*>") / len(words), g["t"].count("<*>"), -i) for i, g in enumerate(leaf)]
        best = max(scores, default=(-1, 0, 0))
        if best[0] >= 0.4:
            group = leaf[-best[2]]
            group["t"] = [a if a == b else "<*>" for a, b in zip(group["t"], words)]
        else:
            group = {"t": words, "id": sum(len(g) for g in groups.values()) + 1}
            leaf.append(group)
        label[text] = group["id"]
    return [label[v] for v in values]


def test_mined_templates_match_naive(spark):
    rng = random.Random(4)
    values = [" ".join(rng.choice(["pay", "bank", "7x", "down", "limit", "otp"]) for _ in range(rng.choice([3, 5, 8]))) for _ in range(300)]
    got = labels_of(clustering.cluster_by_mined_template(texts(spark, values)))
    assert [got[k] for k in sorted(got)] == naive_mining(values)


def test_split_leaves_give_the_same_groups(spark):
    """One leaf of families that cannot meet, in parts: same groups as one after the other."""
    rng = random.Random(6)
    values = []
    for _ in range(400):
        family = rng.randrange(25)
        values.append(" ".join(["pay", *[f"f{family}p{at}v{rng.randrange(4)}" for at in range(7)]]))
    frame = clustering.distinct_templates(texts(spark, values)).cache()
    whole, split = clustering.mine_templates(frame), clustering.mine_templates(frame, split_texts=10)
    assert split.select("part").distinct().count() > 10 and whole.select("part").distinct().count() == 1

    def groups(mined):
        found = defaultdict(set)
        for r in mined.collect():
            found[r.leaf, r.part, r.group_no].add(r.masked_description)
        return sorted(map(sorted, found.values()))

    naive = defaultdict(set)
    for text, label in zip(values, naive_mining(values)):
        naive[label].add(text)
    assert groups(split) == groups(whole) == sorted(map(sorted, naive.values()))


def test_a_leaf_of_very_many_groups(spark):
    """Groups are looked up, not scanned: the index compares a text with what it can match only."""
    index = clustering.TemplateIndex(0.4)
    for k in range(60_000):
        assert index.add(["pay", *[f"t{k}x{at}" for at in range(9)]]) == k
    assert index.add(["pay", *[f"t777x{at}" for at in range(6)], "a", "b", "c"]) == 777
    assert index.groups[777][-3:] == ["<*>"] * 3 and (9, "t777x8") in index.posted and not index.posted[9, "t777x8"]


def test_mined_query_equals_naive_on_the_given_table(spark, failures):
    from tillwatch.catalog import QUERIES

    rows = clustering.with_masked(failures_from_tables(spark, SF)).select("payment_id", "created_at", "masked_description")
    ordered = sorted(rows.collect(), key=lambda r: (r.created_at, r.payment_id))
    values = [r.masked_description.strip() for r in ordered]
    naive = dict(zip([r.payment_id for r in ordered], naive_mining(values)))
    assert labels_of(QUERIES["mined_templates"](spark, SF)) == naive


def test_density_clusters_separate_templates_and_noise(spark):
    values = ["gateway timed out waiting for bank"] * 6 + ["gateway timed out waiting for the bank"] * 3
    values += ["customer entered a wrong pin code twice"] * 7 + ["zebra", "quartz violin", "lonely umbrella walks"]
    got = labels_of(clustering.cluster_by_density(texts(spark, values)))
    labels = [got[k] for k in sorted(got)]
    assert set(labels[:9]) == {0} and set(labels[9:16]) == {1} and set(labels[16:]) == {-1}


def test_a_dense_group_is_not_compared_in_pairs(spark, monkeypatch):
    """Texts that are all neighbours of one another: a few comparisons each settle core and cluster."""
    base = " ".join(f"b{k}" for k in range(170))
    values = [f"{base} u{k}q" for k in range(600)] + [f"far away v{k}" for k in range(4)] + [" ".join(f"c{k}" for k in range(9)) + f" z{k % 3}" for k in range(6)]
    asked, plain = [], clustering.close_of

    def counting(candidates, vectors, cut):
        candidates = candidates.cache()
        asked.append(candidates.count())
        return plain(candidates, vectors, cut)

    monkeypatch.setattr(clustering, "close_of", counting)
    got = labels_of(clustering.cluster_by_density(texts(spark, values)))
    labels = [got[k] for k in sorted(got)]
    assert labels[:600] == [0] * 600 and set(labels[600:604]) == {-1} and set(labels[604:]) == {1}
    assert sum(asked) < 600 * 170 * 6


def test_density_equals_brute_force(spark):
    """Random texts around the cut: core, border, noise and chains."""
    rng = random.Random(12)
    values = []
    for _ in range(220):
        topic = rng.randrange(14)
        values.append(" ".join(f"w{topic}x{rng.randrange(9)}" for _ in range(rng.choice([3, 5, 7]))))
    frame = texts(spark, values)
    vectors = defaultdict(dict)
    for r in clustering.tfidf_vectors(clustering.distinct_templates(frame)).collect():
        vectors[r.masked_description][r.term] = r.weight
    order = list(dict.fromkeys(values))
    count, near = Counter(values), defaultdict(set)
    for i, a in enumerate(order):
        for j, b in enumerate(order[:i]):
            if round(sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()), 9) >= 0.7:
                near[i].add(j)
                near[j].add(i)
    core = {i for i, t in enumerate(order) if count[t] + sum(count[order[j]] for j in near[i]) >= 5}
    root = {i: i for i in core}
    for _ in order:
        for i in core:
            root[i] = min([root[i], *(root[j] for j in near[i] & core)])
    for i in set(range(len(order))) - core:
        if near[i] & core:
            root[i] = min(root[j] for j in near[i] & core)
    numbers = {r: k for k, r in enumerate(dict.fromkeys(root[i] for i in range(len(order)) if i in root))}
    want = {t: numbers[root[i]] if i in root else -1 for i, t in enumerate(order)}
    got = labels_of(clustering.cluster_by_density(frame))
    assert [got[k] for k in sorted(got)] == [want[v] for v in values] and len(set(want.values())) > 3


def test_density_edge_cases(spark):
    assert labels_of(clustering.cluster_by_density(texts(spark, ["alone here"]))) == {"p00000": 0}
    assert clustering.cluster_by_density(texts(spark, ["x y"]).filter("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 199)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 199: 199, 200: 199}
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("clusters", [20, 200, 2000])
def test_noise_share_is_flat_in_the_number_of_clusters(spark, clusters):
    """Six near copies per cluster, one word apart: none may become noise, none may merge."""
    rng = random.Random(clusters)
    values = []
    for k in range(clusters):
        base = [f"w{rng.randrange(20 * clusters)}" for _ in range(10)]
        values += [" ".join(base + [f"u{k}x{v}"]) for v in range(6)]
    got = labels_of(clustering.cluster_by_density(texts(spark, values)))
    labels = [got[x] for x in sorted(got)]
    assert labels == [k // 6 for k in range(len(values))]


def naive_metrics(pairs):
    n = len(pairs)
    pred, true, both = Counter(p for _, p in pairs), Counter(t for t, _ in pairs), Counter(pairs)
    tops = defaultdict(int)
    for (_, p), c in both.items():
        tops[p] = max(tops[p], c)
    mi = sum(c / n * math.log(c * n / (true[t] * pred[p])) for (t, p), c in both.items())
    h = [-sum(c / n * math.log(c / n) for c in side.values()) for side in (pred, true)]
    def two(x):
        return x * (x - 1) / 2
    index, a, b = (sum(two(c) for c in side.values()) for side in (both, pred, true))
    expected = a * b / two(n)
    return sum(tops.values()) / n, mi / (sum(h) / 2), (index - expected) / ((a + b) / 2 - expected)


def test_metrics_match_formulas(spark):
    rng = random.Random(2)
    pairs = [(rng.choice("abcd"), rng.choice([-1, 0, 1, 2])) for _ in range(200)]
    df = spark.createDataFrame([(t, p) for t, p in pairs], "true_label string, pred_label long")
    row = metrics.cluster_metrics(df).first()
    assert (row.purity, row.nmi, row.ari) == pytest.approx(naive_metrics(pairs))
    assert row.n_predicted_clusters == 3 and row.n_true_clusters == 4
    same = metrics.cluster_metrics(df.withColumn("pred_label", F.lit(1)).withColumn("true_label", F.lit("a"))).first()
    assert (same.purity, same.nmi, same.ari) == (1.0, 1.0, 1.0)
    assert metrics.cluster_metrics(df.filter("false")).count() == 0


def test_noise_and_crossover(spark):
    df = spark.createDataFrame([(True, -1), (True, 3), (False, -1), (False, 2)], "is_outlier boolean, pred_label long")
    row = metrics.noise_handling(df).first()
    assert (row.noise_recall, row.noise_precision, row.n_forced_into_cluster) == (0.5, 0.5, 1)
    none = metrics.noise_handling(df.filter("false")).first()
    assert none.noise_recall is None and none.noise_precision is None
    rows = spark.createDataFrame([("a", 0.9, 0.5, 0.4, 1.0), ("b", 0.1, 0.5, 0.4, 1.0), ("c", 0.5, 0.9, 0.5, 0.9)],
                                 "k string, candidate_catchall double, candidate_narrow double, baseline_catchall double, baseline_narrow double")
    got = {r.k: r.crossover_share for r in metrics.crossover_shares(rows, ["k"]).collect()}
    assert got == {"a": 0.501, "b": None, "c": None}


def test_bakeoff_shape(failures):
    table = bakeoff.label_table(failures, ("groupby_reason", "template_hash"))
    scores = bakeoff.bakeoff_metrics(table).collect()
    assert {(r.candidate, r.arm, r.stratum) for r in scores} == {
        ("groupby_reason", a, s) for a in ("transparent", "opaque") for s in ("catchall", "narrow")
    } | {("template_hash", a, "catchall") for a in ("transparent", "opaque")}
    catchall = failures.filter("latent_subcause_id is not null").count()
    for r in scores:
        assert r.n_events == (catchall if r.stratum == "catchall" else failures.count() - catchall)
        if r.candidate == "groupby_reason" and r.stratum == "narrow":
            assert r.purity == 1.0


def test_outliers_and_split_invariants(failures):
    tagged = corpus.tag_outliers(failures)
    rare = {(r.method, r.error_reason) for r in corpus.outlier_keys(failures).collect()}
    assert all(r.is_outlier == ((r.method, r.error_reason) in rare) for r in tagged.collect())
    assert not tagged.filter(F.col("is_outlier") & F.col("error_reason").isin(K.CATCH_ALL_REASONS)).count()
    splits = corpus.assign_split(failures).filter("downtime_window_id is not null").groupBy("downtime_window_id").agg(F.countDistinct("split").alias("n"))
    assert splits.agg(F.max("n")).first()[0] == 1


def test_samples_are_stable_and_sized(failures):
    ids = failures.select("payment_id")
    one, two = ({r.payment_id for r in calls.seeded_sample(ids.repartition(n), "payment_id", 25, 3).collect()} for n in (1, 5))
    assert one == two and len(one) == 25
    tagged = corpus.tag_outliers(failures)
    n_out = tagged.filter("is_outlier").count()
    sample = calls.outlier_enriched_sample(tagged, n_out + 10, 1)
    assert sample.count() == n_out + 10 and sample.filter("is_outlier").count() == n_out
