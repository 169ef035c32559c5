"""Sources, text, clustering, metrics, execution, audit, call logs and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.catalog.base import query, rounded, sql_rounded, sql_stamp, stamp
from tillwatch.catalog.incident_queries import FV, WINDOWS
from tillwatch.catalog.policy_queries import CHASE, DECIDED, decisions
from tillwatch.catalog.sql_views import clause_sql, quoted, sql_list
from tillwatch.functions.outbound import masked_contact, reference_id
from tillwatch.functions.taxonomy import true_label
from tillwatch.functions.text import mask_description, normalise_template
from tillwatch.operators import audit, calls, clustering, corpus, execution, guardrails, metrics, reporting, scoring
from tillwatch.operators.dedup import first_deliveries
from tillwatch.operators.diagnosis import default_diagnoses
from tillwatch.plans import bakeoff
from tillwatch.session import checkpointed
from tillwatch.sources import payloads
from tillwatch.sources.dimensions import reason_explanation
from tillwatch.sources.failures import failures_from_tables
from tillwatch.sources.reports import as_json_rows


def mask_sql(text: str) -> str:
    for pattern, placeholder in K.MASK_RULES:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(placeholder.replace('$1', chr(92) + '1'))}, 'g')"
    return text


MASKED = f"{FV}, mf AS (SELECT *, {mask_sql('description')} AS masked FROM failures)"

# --- payloads ---------------------------------------------------------------------------------


def signal_payloads(spark, sf) -> DataFrame:
    """Failure payloads in both wire shapes; some carry both names, some break a rule."""
    f = failures_from_tables(spark, sf).withColumn("no", F.substring("payment_id", 5, 14).cast("long"))
    step = F.when(F.col("no") % 50 == 7, "unheard_of").otherwise(F.col("error_step"))
    reason = F.when(F.col("no") % 60 == 11, "").when(F.col("no") % 70 != 13, F.col("error_reason"))
    webhook = F.to_json(F.struct(
        "error_code", F.col("description").alias("error_description"), "error_source", step.alias("error_step"),
        reason.alias("error_reason"),
    ))
    both = F.when(F.col("no") % 9 == 0, F.lit("business"))
    api = F.to_json(F.struct(
        F.col("error_code").alias("code"), "description", F.col("error_source").alias("source"), both.alias("error_source"),
        step.alias("step"), reason.alias("reason"), F.lit("amount").alias("field"),
        F.create_map(F.lit("order_id"), F.col("order_id")).alias("metadata"),
    ))
    return f.select("payment_id", F.when(F.col("no") % 2 == 0, webhook).otherwise(api).alias("payload"))


@query("normalised_signals", (
    f"{FV}, s AS (SELECT payment_id, order_id, description, error_code, error_source, substr(payment_id, 5)::BIGINT AS no, "
    "CASE WHEN substr(payment_id, 5)::BIGINT % 50 = 7 THEN 'unheard_of' ELSE error_step END AS step, "
    "CASE WHEN substr(payment_id, 5)::BIGINT % 60 = 11 THEN '' WHEN substr(payment_id, 5)::BIGINT % 70 <> 13 THEN error_reason END AS reason FROM failures) "
    "SELECT payment_id, error_code AS code, description, error_source AS source, step, reason, CASE WHEN no % 2 = 1 THEN 'amount' END AS field, "
    "CASE WHEN no % 2 = 1 THEN order_id END AS metadata_order, CASE WHEN reason IS NULL THEN 'missing reason' WHEN step = 'unheard_of' THEN 'unknown step' "
    "WHEN reason = '' THEN 'empty reason' END AS problem FROM s"
))
def normalised_signals(spark, sf):
    parsed = payloads.parse_signals(signal_payloads(spark, sf))
    return parsed.select("payment_id", "code", "description", "source", "step", "reason", "field",
                         F.col("metadata.order_id").alias("metadata_order"), "problem")


@query("quarantined_signals", (
    f"{FV}, s AS (SELECT substr(payment_id, 5)::BIGINT AS no FROM failures), p AS (SELECT CASE WHEN no % 70 = 13 AND no % 60 <> 11 THEN 'missing reason' "
    "WHEN no % 50 = 7 THEN 'unknown step' WHEN no % 60 = 11 THEN 'empty reason' END AS problem FROM s) "
    "SELECT problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1"
))
def quarantined_signals(spark, sf):
    return payloads.quarantined_rows(payloads.parse_signals(signal_payloads(spark, sf))).groupBy("problem").agg(F.count("*").alias("n"))


def downtime_webhooks(spark, sf) -> DataFrame:
    """A started and a resolved webhook per labelled window; wallets are not supported by the feed."""
    windows = scoring.true_windows(failures_from_tables(spark, sf)).select("window_id", "method", "bank", "start", "end")
    events = windows.select("*", F.explode(F.array(F.lit("started"), F.lit("resolved"))).alias("kind"))
    begin, end = F.unix_timestamp(F.col("start").cast("timestamp")), F.unix_timestamp(F.col("end").cast("timestamp")) + 60
    at = F.when(F.col("kind") == "started", begin).otherwise(end)
    entity = F.struct(
        F.col("window_id").alias("id"), F.lit("payment.downtime").alias("entity"), "method", begin.alias("begin"),
        F.when(F.col("kind") == "resolved", end).alias("end"), F.col("kind").alias("status"), F.lit(False).alias("scheduled"),
        F.lit("high").alias("severity"), F.when(F.col("bank").isNotNull(), F.struct("bank")).alias("instrument"),
        begin.alias("created_at"), at.alias("updated_at"),
    )
    body = F.struct(
        F.lit("event").alias("entity"), F.lit("acc_1").alias("account_id"), F.concat(F.lit("payment.downtime."), F.col("kind")).alias("event"),
        F.array(F.lit("payment.downtime")).alias("contains"),
        F.struct(F.struct(entity.alias("entity")).alias("payment.downtime")).alias("payload"), at.alias("created_at"),
    )
    return events.select(F.to_json(body).alias("payload"))


DOWN = f"""{FV}, {WINDOWS}, dk AS (SELECT window_id AS id, method, ebank AS bank, epoch_us(start_at) // 1000000 AS b, epoch_us(end_at) // 1000000 + 60 AS e,
  unnest(['started', 'resolved']) AS status FROM win)"""


@query("downtime_webhooks", (
    f"{DOWN} SELECT id, 'payment.downtime.' || status AS event, method, bank, status, {sql_stamp('make_timestamp(b * 1000000)', chr(34) + 'begin' + chr(34))}, "
    f"CASE WHEN status = 'resolved' THEN strftime(make_timestamp(e * 1000000), '%Y-%m-%d %H:%M:%S.%f') END AS \"end\", "
    f"CASE WHEN method NOT IN ({sql_list(K.DOWNTIME_METHODS)}) THEN 'unsupported method' END AS problem FROM dk"
))
def downtime_webhooks_query(spark, sf):
    parsed = payloads.parse_downtime_webhooks(downtime_webhooks(spark, sf))
    return parsed.select("id", "event", "method", "bank", "status", stamp("begin"), stamp("end"), "problem")


@query("latest_downtimes", (
    f"{DOWN} SELECT id, method, bank, status, {sql_stamp('make_timestamp(e * 1000000)', 'updated_at')} FROM dk WHERE status = 'resolved' AND method IN ({sql_list(K.DOWNTIME_METHODS)})"
))
def latest_downtimes(spark, sf):
    rows = payloads.valid_rows(payloads.parse_downtime_webhooks(downtime_webhooks(spark, sf)))
    return payloads.latest_downtimes(rows.drop("payload")).select("id", "method", "bank", "status", stamp("updated_at"))


@query("deduplicated_webhooks", (
    "WITH d AS (SELECT 'evt_' || user_id || '_' || event_type AS event_id, list(epoch_us(ts) ORDER BY ts) AS l FROM events GROUP BY 1), "
    "k AS (SELECT event_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(acc) = 0 OR x - acc[len(acc)] >= 86400000000 THEN list_append(acc, x) ELSE acc END, []::BIGINT[])) AS us FROM d) "
    f"SELECT event_id, {sql_stamp('make_timestamp(us)', 'received_at')} FROM k"
))
def deduplicated_webhooks(spark, sf):
    deliveries = spark.read.parquet(f"{sf}/events.parquet").select(
        F.concat(F.lit("evt_"), F.col("user_id"), F.lit("_"), F.col("event_type")).alias("event_id"),
        F.col("ts").alias("received_at"), F.col("event_id").cast("string").alias("delivery_id"),
    )
    return first_deliveries(deliveries).select("event_id", stamp("received_at"))


# --- text and clusters ------------------------------------------------------------------------


@query("masked_descriptions", f"{MASKED} SELECT payment_id, masked AS masked_description FROM mf")
def masked_descriptions(spark, sf):
    return clustering.with_masked(failures_from_tables(spark, sf)).select("payment_id", "masked_description")


@query("masked_documents", f"SELECT doc_id, {mask_sql('text')} AS masked FROM documents")
def masked_documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", mask_description(F.col("text")).alias("masked"))


@query("normalised_templates", f"{MASKED} SELECT lower(regexp_replace(trim(masked), '\\s+', ' ', 'g')) AS template, count(*) AS n FROM mf GROUP BY 1")
def normalised_templates(spark, sf):
    masked = clustering.with_masked(failures_from_tables(spark, sf))
    return masked.groupBy(normalise_template(F.col("masked_description")).alias("template")).agg(F.count("*").alias("n"))


@query("ground_truth_groups", f"{FV} SELECT error_code, error_source, error_step, error_reason, count(*) AS n FROM failures GROUP BY ALL")
def ground_truth_groups(spark, sf):
    from tillwatch.functions.taxonomy import ground_truth

    groups = failures_from_tables(spark, sf).groupBy(ground_truth().alias("g")).agg(F.count("*").alias("n"))
    return groups.select("g.*", "n")


ROOT = "error_code, error_source, error_step, error_reason"
ROOT_LABELS = (f"rl AS (SELECT payment_id, dense_rank() OVER (ORDER BY fs) - 1 AS pred_label FROM "
               f"(SELECT payment_id, min((us, payment_id)) OVER (PARTITION BY {ROOT}) AS fs FROM failures))")


@query("root_cause_labels", f"{FV}, {ROOT_LABELS} SELECT * FROM rl")
def root_cause_labels(spark, sf):
    return clustering.group_by_root_cause(failures_from_tables(spark, sf))


@query("template_hash_labels", (
    f"{MASKED} SELECT payment_id, dense_rank() OVER (ORDER BY fs) - 1 AS pred_label FROM (SELECT payment_id, "
    "min((us, payment_id)) OVER (PARTITION BY lower(regexp_replace(trim(masked), '\\s+', ' ', 'g'))) AS fs FROM mf)"
))
def template_hash_labels(spark, sf):
    return clustering.group_by_template(clustering.with_masked(failures_from_tables(spark, sf)))


@query("mined_templates")
def mined_templates(spark, sf):
    return clustering.cluster_by_mined_template(clustering.with_masked(failures_from_tables(spark, sf)))


DENSITY_SQL = f"""{MASKED}, tp AS (SELECT masked, count(*) AS n, min((us, payment_id)) AS first FROM mf GROUP BY 1),
ti AS (SELECT *, row_number() OVER (ORDER BY first) AS id FROM tp),
tk AS (SELECT id, n, unnest(regexp_extract_all(lower(masked), '[a-z0-9_]+')) AS term FROM ti),
tf AS (SELECT id, n, term, count(*) AS tf FROM tk WHERE length(term) >= 2 GROUP BY ALL),
df AS (SELECT term, sum(n) AS df FROM tf GROUP BY 1),
raw AS (SELECT id, n, tf.term, tf * (ln((1 + (SELECT sum(n) FROM tp)) / (1 + df)::DOUBLE) + 1) AS raw FROM tf JOIN df USING (term)),
vec AS (SELECT id, n, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM raw),
near AS (SELECT x.id AS a, y.id AS b FROM vec x JOIN vec y USING (term) WHERE x.id <> y.id GROUP BY ALL HAVING round(sum(x.w * y.w), 9) >= 0.7),
sizes AS (SELECT DISTINCT id, n FROM vec),
core AS (SELECT s.id FROM sizes s LEFT JOIN near ON near.a = s.id LEFT JOIN sizes o ON o.id = near.b GROUP BY s.id, s.n
  HAVING s.n + coalesce(sum(o.n), 0) >= least(5, greatest(2, (SELECT sum(n) FROM tp) // 2))),
links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (WITH RECURSIVE r(id, root) AS (SELECT id, id FROM core UNION SELECT links.b, r.root FROM r JOIN links ON links.a = r.id WHERE r.root < links.b) SELECT id, min(root) AS root FROM r GROUP BY 1),
placed AS (SELECT * FROM reach UNION ALL SELECT near.a, min(reach.root) FROM near JOIN reach ON reach.id = near.b WHERE near.a NOT IN (SELECT id FROM core) GROUP BY 1),
ranked AS (SELECT root, row_number() OVER (ORDER BY min(id)) - 1 AS label FROM placed GROUP BY 1)"""


@query("density_clusters", f"{DENSITY_SQL} SELECT payment_id, coalesce(label, -1) AS pred_label FROM mf JOIN ti USING (masked) LEFT JOIN placed USING (id) LEFT JOIN ranked USING (root)")
def density_clusters(spark, sf):
    return clustering.cluster_by_density(clustering.with_masked(failures_from_tables(spark, sf)))


@query("tfidf_weights", (
    f"{MASKED}, tp AS (SELECT masked, count(*) AS n FROM mf GROUP BY 1), "
    "tk AS (SELECT masked, n, unnest(regexp_extract_all(lower(masked), '[a-z0-9_]+')) AS term FROM tp), "
    "tf AS (SELECT masked, n, term, count(*) AS tf FROM tk WHERE length(term) >= 2 GROUP BY ALL), "
    "df AS (SELECT term, sum(n) AS df, sum(tf * n) AS uses FROM tf GROUP BY 1), "
    "w AS (SELECT masked, tf.term, tf * (ln((1 + (SELECT sum(n) FROM tp)) / (1 + df)::DOUBLE) + 1) AS raw FROM tf JOIN df USING (term)) "
    "SELECT masked AS masked_description, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY masked)), 6) AS weight FROM w"
))
def tfidf_weights(spark, sf):
    masked = clustering.with_masked(failures_from_tables(spark, sf))
    return clustering.tfidf_vectors(clustering.distinct_templates(masked)).select("masked_description", "term", *rounded("weight"))


RARE = (f"rk AS (SELECT method, error_reason FROM failures WHERE downtime_window_id IS NULL AND error_reason NOT IN ({sql_list(K.CATCH_ALL_REASONS)}) "
        "GROUP BY ALL HAVING count(*) <= 2), fo AS (SELECT f.*, rk.method IS NOT NULL AS is_outlier FROM failures f LEFT JOIN rk USING (method, error_reason))")


def labelled_failures(spark, sf) -> DataFrame:
    """Reason codes with the rare ones as noise, against sub-causes: two label sets to compare."""
    f = corpus.tag_outliers(failures_from_tables(spark, sf))
    labels = clustering.first_seen_labels(f, clustering.ROOT_CAUSE).select(*clustering.ROOT_CAUSE, "label")
    short = F.length("error_reason") > 34
    return f.join(labels, clustering.ROOT_CAUSE).select(
        F.when(F.col("latent_subcause_id").isNotNull(), "catchall").otherwise("narrow").alias("stratum"),
        true_label().alias("true_label"), F.when(short, -1).otherwise(F.col("label")).cast("bigint").alias("pred_label"), "is_outlier",
    )


LABELLED = (f"{FV}, {RARE}, {ROOT_LABELS}, lf AS (SELECT CASE WHEN latent_subcause_id IS NOT NULL THEN 'catchall' ELSE 'narrow' END AS stratum, "
            "coalesce(latent_subcause_id, error_reason) AS true_label, CASE WHEN length(error_reason) > 34 THEN -1 ELSE pred_label END AS pred_label, is_outlier "
            "FROM fo JOIN rl USING (payment_id))")
METRIC_SQL = f"""{LABELLED}, pr AS (SELECT stratum, pred_label, true_label, count(*)::DOUBLE AS n FROM lf GROUP BY ALL),
pa AS (SELECT stratum, pred_label, sum(n) AS n, max(n) AS top FROM pr GROUP BY ALL), pb AS (SELECT stratum, true_label, sum(n) AS n FROM pr GROUP BY ALL),
t AS (SELECT stratum, sum(n) AS n FROM pr GROUP BY 1),
mi AS (SELECT pr.stratum, sum(pr.n / t.n * ln(pr.n * t.n / (pa.n * pb.n))) AS mi, sum(pr.n * (pr.n - 1) / 2) AS idx FROM pr JOIN pa USING (stratum, pred_label)
  JOIN pb USING (stratum, true_label) JOIN t USING (stratum) GROUP BY 1),
ha AS (SELECT stratum, -sum(pa.n / t.n * ln(pa.n / t.n)) AS h, sum(pa.n * (pa.n - 1) / 2) AS c, sum(top) AS top, count(*) FILTER (pred_label <> -1) AS k FROM pa JOIN t USING (stratum) GROUP BY 1),
hb AS (SELECT stratum, -sum(pb.n / t.n * ln(pb.n / t.n)) AS h, sum(pb.n * (pb.n - 1) / 2) AS c, count(*) AS k FROM pb JOIN t USING (stratum) GROUP BY 1)"""


@query("cluster_metrics", (
    f"{METRIC_SQL} SELECT stratum, round(ha.top / t.n, 6) AS purity, round(mi / ((ha.h + hb.h) / 2), 6) AS nmi, "
    "round((idx - ha.c * hb.c / (t.n * (t.n - 1) / 2)) / ((ha.c + hb.c) / 2 - ha.c * hb.c / (t.n * (t.n - 1) / 2)), 6) AS ari, "
    "ha.k AS n_predicted_clusters, hb.k AS n_true_clusters, t.n::BIGINT AS n_events FROM mi JOIN ha USING (stratum) JOIN hb USING (stratum) JOIN t USING (stratum)"
))
def cluster_metrics(spark, sf):
    out = metrics.cluster_metrics(labelled_failures(spark, sf), ["stratum"])
    return out.select("stratum", *rounded("purity", "nmi", "ari"), "n_predicted_clusters", "n_true_clusters", "n_events")


@query("noise_handling", (
    f"{LABELLED} SELECT stratum, count(*) FILTER (is_outlier) AS n_true_outliers, count(*) FILTER (pred_label = -1) AS n_predicted_noise, "
    "count(*) FILTER (is_outlier AND pred_label = -1) AS n_correctly_noised, count(*) FILTER (is_outlier AND pred_label <> -1) AS n_forced_into_cluster, "
    "round(count(*) FILTER (is_outlier AND pred_label = -1) / nullif(count(*) FILTER (is_outlier), 0)::DOUBLE, 6) AS noise_recall, "
    "round(count(*) FILTER (is_outlier AND pred_label = -1) / nullif(count(*) FILTER (pred_label = -1), 0)::DOUBLE, 6) AS noise_precision FROM lf GROUP BY 1"
))
def noise_handling(spark, sf):
    out = metrics.noise_handling(labelled_failures(spark, sf), ["stratum"])
    return out.select(*[c for c in out.columns if c not in ("noise_recall", "noise_precision")], *rounded("noise_recall", "noise_precision"))


@query("crossover_shares", (
    f"{LABELLED}, g AS (SELECT stratum, avg((pred_label = -1)::INT) AS a, avg(is_outlier::INT) AS o FROM lf GROUP BY 1), "
    "x AS (SELECT max(1 - a) FILTER (stratum = 'catchall') AS cc, max(1 - o - a) FILTER (stratum = 'narrow') AS cn, "
    "max(1 - a - 0.3) FILTER (stratum = 'catchall') AS bc, max(1 - a) FILTER (stratum = 'narrow') AS bn FROM g) "
    "SELECT 'a' AS name, (SELECT min(s) / 1000.0::DOUBLE FROM range(1001) r(s), x WHERE s / 1000.0::DOUBLE * cc + (1 - s / 1000.0::DOUBLE) * cn > s / 1000.0::DOUBLE * bc + (1 - s / 1000.0::DOUBLE) * bn) AS crossover_share"
))
def crossover_shares(spark, sf):
    by = labelled_failures(spark, sf).groupBy("stratum").agg(
        F.avg((F.col("pred_label") == -1).cast("int")).alias("a"), F.avg(F.col("is_outlier").cast("int")).alias("o")
    )

    def of(stratum, value):
        return F.max(F.when(F.col("stratum") == stratum, value))

    rows = by.agg(
        of("catchall", 1 - F.col("a")).alias("candidate_catchall"), of("narrow", 1 - F.col("o") - F.col("a")).alias("candidate_narrow"),
        of("catchall", 1 - F.col("a") - 0.3).alias("baseline_catchall"), of("narrow", 1 - F.col("a")).alias("baseline_narrow"),
    ).withColumn("name", F.lit("a"))
    return metrics.crossover_shares(rows, ["name"]).select("name", "crossover_share")


@query("clusterer_bakeoff")
def clusterer_bakeoff(spark, sf):
    return bakeoff.bakeoff_metrics(bakeoff.label_table(failures_from_tables(spark, sf)))


@query("bakeoff_crossovers")
def bakeoff_crossovers(spark, sf):
    return bakeoff.bakeoff_crossovers(bakeoff.bakeoff_metrics(bakeoff.label_table(failures_from_tables(spark, sf))))


OPAQUE = " ".join(f"WHEN {quoted(r)} THEN {quoted(reason_explanation(r).split('. ')[0] + '.')}" for r in K.CATCH_ALL_REASONS)


@query("opaque_descriptions", (
    f"{FV} SELECT payment_id, CASE WHEN error_reason IN ({sql_list(K.CATCH_ALL_REASONS)}) THEN (CASE error_reason {OPAQUE} END) || "
    f"{clause_sql(quoted('000000000000'))} ELSE description END AS description FROM failures"
))
def opaque_descriptions(spark, sf):
    f = failures_from_tables(spark, sf)
    return f.select("payment_id", corpus.opaque_description(f, {r: reason_explanation(r) for r in K.CATCH_ALL_REASONS}).alias("description"))


@query("outlier_tags", f"{FV}, {RARE} SELECT payment_id, is_outlier FROM fo")
def outlier_tags(spark, sf):
    return corpus.tag_outliers(failures_from_tables(spark, sf)).select("payment_id", "is_outlier")


@query("leak_free_split", (
    f"{FV} SELECT payment_id, CASE WHEN ('0x' || substr(md5(coalesce(downtime_window_id, payment_id)), 1, 8))::BIGINT % 100 < 30 THEN 'test' ELSE 'train' END AS split FROM failures"
))
def leak_free_split(spark, sf):
    return corpus.assign_split(failures_from_tables(spark, sf), 0.3).select("payment_id", "split")


BUCKET_ROWS = ", ".join(f"({quoted(m)}, {quoted(r)}, {i})" for m, b in K.REASON_BUCKET_BY_METHOD.items() for i, r in enumerate(K.METHOD_REASONS[b]))


@query("expected_reason_mix", (
    f"{FV}, sp(method, reason, position) AS (SELECT * FROM (VALUES {BUCKET_ROWS}) v), "
    f"ge AS (SELECT unnest([{sql_list(K.METHODS)}]) AS method, error_reason AS reason, 1000 + reason_pos AS position FROM reason_dim WHERE error_reason NOT IN (SELECT reason FROM sp)), "
    "al AS (SELECT * FROM sp UNION ALL SELECT * FROM ge), rk AS (SELECT method, reason, row_number() OVER (PARTITION BY method ORDER BY position) AS rank FROM al), "
    "wt AS (SELECT *, pow(rank, -1.2::DOUBLE) / sum(pow(rank, -1.2::DOUBLE)) OVER (PARTITION BY method) AS weight FROM rk), "
    "fm AS (SELECT method, count(*) AS n FROM failures GROUP BY 1), fr AS (SELECT method, error_reason AS reason, count(*) AS n FROM failures GROUP BY ALL) "
    "SELECT wt.method, wt.reason, rank, round(weight, 6) AS weight, round(weight * fm.n, 4) AS expected, coalesce(fr.n, 0) AS observed FROM wt JOIN fm USING (method) LEFT JOIN fr USING (method, reason)"
))
def expected_reason_mix(spark, sf):
    f = failures_from_tables(spark, sf)
    per_reason = f.groupBy("method", F.col("error_reason").alias("reason")).agg(F.count("*").alias("observed"))
    per_method = per_reason.groupBy("method").agg(F.sum("observed").alias("n"))
    mix = corpus.reason_pools(spark).join(per_method, "method").join(per_reason, ["method", "reason"], "left")
    return mix.select("method", "reason", F.col("rank").cast("bigint").alias("rank"), *rounded("weight"),
                      F.round(F.col("weight") * F.col("n"), 4).alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed"))


# --- execution and audit ----------------------------------------------------------------------

REF = f"'{K.REFERENCE_PREFIX}' || substr(sha256(payment_id), 1, {K.REFERENCE_ID_LENGTH - len(K.REFERENCE_PREFIX)})"


@query("reference_ids", f"{FV} SELECT payment_id, {REF} AS reference_id FROM failures")
def reference_ids(spark, sf):
    return failures_from_tables(spark, sf).select("payment_id", reference_id(F.col("payment_id")).alias("reference_id"))


@query("reference_id_check", (
    f"{FV}, r AS (SELECT {REF} AS k FROM failures) SELECT count(*) AS n_events, count(DISTINCT k) AS n_unique, count(*) = count(DISTINCT k) AS collision_free, max(length(k))::BIGINT AS max_length FROM r"
))
def reference_id_check(spark, sf):
    return execution.reference_id_check(failures_from_tables(spark, sf)).withColumn("max_length", F.col("max_length").cast("bigint"))


DIGITS = " || ".join(f"(('0x' || substr(sha256(customer_id), {i}, 1))::BIGINT % 10)::VARCHAR" for i in range(1, 10))


@query("masked_contacts", f"{FV} SELECT DISTINCT customer_id, 'Customer ' || customer_id AS name, '+919' || {DIGITS} AS contact, 'customer.' || customer_id || '@example.com' AS email FROM failures")
def masked_contacts(spark, sf):
    ids = failures_from_tables(spark, sf).select("customer_id").distinct()
    return ids.select("customer_id", masked_contact(F.col("customer_id")).alias("c")).select("customer_id", "c.*")


ALLOW = " || ',' || ".join(f"'\"{m}\":' || (disallowed_method <> '{m}')" for m in K.RESTRICTABLE_METHODS)
WIRE = (f"'{{\"amount\":' || amount || ',\"currency\":\"INR\",\"description\":\"Complete your payment of INR ' || (amount // 100)::VARCHAR || '.' || lpad((amount % 100)::VARCHAR, 2, '0') "
        f"|| ' for order ' || order_id || '.\",\"reference_id\":\"' || {REF} || '\",\"customer\":{{\"name\":\"Customer ' || customer_id || '\",\"contact\":\"+919' || {DIGITS} || '\",\"email\":\"customer.' || customer_id "
        f"|| '@example.com\"}},\"notify\":{{\"sms\":true,\"email\":true}}' || CASE WHEN disallowed_method IN ({sql_list(K.RESTRICTABLE_METHODS)}) THEN ',\"options\":{{\"checkout\":{{\"method\":{{' || {ALLOW} || '}}}}}}' ELSE '' END || '}}'")
NOTE = f"CASE WHEN disallowed_method NOT IN ({sql_list(K.RESTRICTABLE_METHODS)}) THEN 'links cannot hide method ' || disallowed_method || '; sent unrestricted' END"


@query("outbound_requests", f"{DECIDED} SELECT payment_id, {REF} AS reference_id, {WIRE} AS request, {NOTE} AS note FROM dd WHERE final_action IN ({CHASE})")
def outbound_requests(spark, sf):
    return execution.outbound_requests(decisions(spark, sf))


@query("execution_records", (
    f"{DECIDED} SELECT payment_id, final_action AS action, CASE WHEN final_action IN ({CHASE}) THEN 'dry_run' ELSE 'no_op' END AS outcome, "
    f"CASE WHEN final_action IN ({CHASE}) THEN {REF} END AS reference_id, CASE WHEN final_action IN ({CHASE}) THEN {NOTE} ELSE 'no outbound call for ' || final_action END AS note FROM dd"
))
def execution_records(spark, sf):
    rows = execution.execution_records(decisions(spark, sf))
    return rows.select("payment_id", *[F.col(f"execution.{c}").alias(c) for c in ("action", "outcome", "reference_id", "note")])


@query("execution_outcomes", f"{DECIDED} SELECT CASE WHEN final_action IN ({CHASE}) THEN 'dry_run' ELSE 'no_op' END AS outcome, count(*) AS n FROM dd GROUP BY 1")
def execution_outcomes(spark, sf):
    return execution.outcome_counts(execution.execution_records(decisions(spark, sf)))


@query("outbound_replays", (
    f"{DECIDED} SELECT CASE WHEN day(created_at) <= 10 THEN 'replay' ELSE 'send' END AS kind, count(*) AS n FROM dd WHERE final_action IN ({CHASE}) GROUP BY 1"
))
def outbound_replays(spark, sf):
    requests = execution.outbound_requests(decisions(spark, sf))
    f = failures_from_tables(spark, sf)
    sent = f.filter(F.dayofmonth("created_at") <= 10).select(reference_id(F.col("payment_id")).alias("reference_id"))
    fresh, replays = execution.split_replays(requests, sent)
    parts = [t.select(F.lit(kind).alias("kind")) for kind, t in (("send", fresh), ("replay", replays))]
    return reduce(DataFrame.unionByName, parts).groupBy("kind").agg(F.count("*").alias("n"))


def audit_log(spark, sf, shards_per_day: int = 4) -> DataFrame:
    failures, diagnoses = failures_from_tables(spark, sf), default_diagnoses(spark)
    executed = execution.execution_records(guardrails.decide_batch(failures, diagnoses, keep=audit.ERROR_CODES))
    rows = audit.audit_rows(executed, failures, diagnoses, "2024-03-01T00:00:00Z")
    return audit.build_chain(rows, shards_per_day)


@query("audit_log")
def audit_log_query(spark, sf):
    return audit_log(spark, sf).select("chain_id", "sequence", "payment_id", "final_action", "prev_hash", "record_hash")


@query("audit_verification", (
    f"{FV}, d AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, payment_id FROM failures), "
    "c AS (SELECT day || '/' || lpad((('0x' || substr(md5(payment_id), 1, 8))::BIGINT % 4)::VARCHAR, 5, '0') AS chain_id FROM d) "
    "SELECT chain_id, count(*) AS n_records, true AS valid FROM c GROUP BY 1"
))
def audit_verification(spark, sf):
    return audit.verify_chains(checkpointed(audit_log(spark, sf))).select("chain_id", "n_records", "valid")


HEAD = "'{\"o_orderkey\":' || o_orderkey || ',\"prev_hash\":'"
TAIL = "',\"sequence\":' || sequence || '}'"
ORDER_CHAIN = f"""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS chain_id, o_orderkey, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) - 1 AS sequence FROM orders),
p AS (SELECT chain_id, list({HEAD} || '@' || {TAIL} ORDER BY sequence) AS l, count(*) AS n FROM o GROUP BY 1),
h AS (SELECT chain_id, n, list_reduce(l, lambda acc, x: sha256(acc || '|' || replace(x, '@', CASE WHEN acc = '' THEN 'null' ELSE '"' || acc || '"' END)), '') AS tip FROM p)"""


def order_chain(spark, sf) -> DataFrame:
    from pyspark.sql import Window as W

    orders = spark.read.parquet(f"{sf}/orders.parquet")
    rows = orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("chain_id"), "o_orderkey", F.lit(None).cast("string").alias("_tip"),
    ).withColumn("sequence", (F.row_number().over(W.partitionBy("chain_id").orderBy("o_orderkey")) - 1).cast("long"))
    head, tail = audit.canonical_parts(["o_orderkey"], ["sequence"])
    return audit.chain_rows(rows, head, tail)


@query("order_chain_tips", f"{ORDER_CHAIN} SELECT chain_id, n - 1 AS last_sequence, tip AS last_hash FROM h")
def order_chain_tips(spark, sf):
    return audit.chain_tips(order_chain(spark, sf))


@query("tampered_chain_check", (
    "WITH o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS chain_id, o_orderkey, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) - 1 AS sequence FROM orders), "
    "t AS (SELECT *, o_orderkey % 11 = 3 AS altered, o_orderkey % 13 = 5 AS deleted FROM o), "
    "k AS (SELECT *, lag(deleted, 1, false) OVER (PARTITION BY chain_id ORDER BY sequence) AS gap FROM t), "
    "b AS (SELECT *, CASE WHEN gap THEN 'broken link' WHEN altered THEN 'altered content' END AS problem FROM k WHERE NOT deleted) "
    "SELECT chain_id, count(*) AS n_records, count(problem) = 0 AS valid, min(sequence) FILTER (problem IS NOT NULL) AS first_broken_sequence, "
    "arg_min(problem, sequence) FILTER (problem IS NOT NULL) AS detail FROM b GROUP BY 1"
))
def tampered_chain_check(spark, sf):
    log = order_chain(spark, sf)
    original = F.col("o_orderkey")
    touched = log.filter(original % 13 != 5).withColumn("o_orderkey", F.when(original % 11 == 3, -original).otherwise(original))
    return audit.verify_chains(touched, *audit.canonical_parts(["o_orderkey"], ["sequence"]))


RECORDS = ORDER_CHAIN + """, hs AS (SELECT chain_id, list_reduce(list_prepend('', l), lambda acc, x: acc || chr(10) || sha256(right(acc, 64) || '|' || replace(x, '@',
  CASE WHEN acc = '' THEN 'null' ELSE '"' || right(acc, 64) || '"' END))) AS hashes FROM p),
leaf AS (SELECT chain_id, h, i FROM (SELECT chain_id, unnest(string_split(ltrim(hashes, chr(10)), chr(10))) AS h, unnest(range(len(string_split(ltrim(hashes, chr(10)), chr(10))))) AS i FROM hs))"""


@query("audit_tree_roots", (
    RECORDS.replace("WITH o", "WITH RECURSIVE o", 1) + """, tree AS (SELECT chain_id, i, h, count(*) OVER (PARTITION BY chain_id) AS n FROM leaf UNION ALL
  SELECT chain_id, i // 2, CASE WHEN count(*) = 2 THEN sha256(min_by(h, i) || max_by(h, i)) ELSE min(h) END, (max(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY chain_id, i // 2)
SELECT chain_id, (SELECT count(*) FROM leaf l WHERE l.chain_id = t.chain_id) AS n_records, h AS root FROM tree t WHERE n = 1"""
))
def audit_tree_roots(spark, sf):
    leaves = audit.record_leaves(order_chain(spark, sf), *audit.canonical_parts(["o_orderkey"], ["sequence"]))
    return audit.tree_roots(audit.hash_tree(leaves))


ALTERED_ORDERS = (
    "WITH o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS chain_id, o_orderkey, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) - 1 AS sequence FROM orders), "
    "t AS (SELECT *, o_orderkey % 11 = 3 AS altered FROM o) "
)


def _altered_orders(spark, sf) -> tuple[DataFrame, DataFrame, tuple]:
    log, parts = checkpointed(order_chain(spark, sf)), audit.canonical_parts(["o_orderkey"], ["sequence"])
    return log, log.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 11 == 3, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))), parts


@query("audit_new_records_check", (
    f"{ALTERED_ORDERS} SELECT chain_id, count(*) AS n_records, count(*) FILTER (altered) = 0 AS valid, min(sequence) FILTER (altered) AS first_broken_sequence, "
    "CASE WHEN count(*) FILTER (altered) > 0 THEN 'altered content' END AS detail FROM t WHERE sequence >= 3 GROUP BY 1"
))
def audit_new_records_check(spark, sf):
    """Verification from the third record of each chain on, over a log with records altered everywhere."""
    log, altered, parts = _altered_orders(spark, sf)
    return audit.verify_since(altered, audit.chain_tips(log.where("sequence < 3")), *parts)


@query("audit_altered_roots", f"{ALTERED_ORDERS} SELECT chain_id, count(*) AS n_records, bool_or(altered) AS altered FROM t GROUP BY 1")
def audit_altered_roots(spark, sf):
    """Chains whose root no longer is the one on record, however old the altered record."""
    log, altered, parts = _altered_orders(spark, sf)
    known, now = (audit.tree_roots(audit.hash_tree(audit.record_leaves(rows, *parts))) for rows in (log, altered))
    return known.join(now.select("chain_id", F.col("root").alias("found")), "chain_id").select("chain_id", "n_records", (F.col("root") != F.col("found")).alias("altered"))


@query("report_rows", (
    f"{DECIDED} SELECT 'terminal_states' AS section, '{{\"ladder_terminal_state\":\"' || ladder_terminal_state || '\",\"n\":' || count(*) || '}}' AS row FROM dd GROUP BY ladder_terminal_state "
    "UNION ALL SELECT 'waiting', '{\"wait_bank_recovery_count\":' || count(*) || '}' FROM dd WHERE final_action = 'wait_bank_recovery'"
).replace("{{", "{").replace("}}", "}"))
def report_rows(spark, sf):
    decided = decisions(spark, sf)
    return as_json_rows({"terminal_states": reporting.terminal_states(decided), "waiting": reporting.waiting_count(decided)})


# --- call logs and samples --------------------------------------------------------------------

CALL_SQL = """WITH c AS (SELECT event_id, 'model_' || user_id % 4 AS model, (['reason', 'incident', 'judge'])[(event_id % 3)::INT + 1] AS kind,
  CASE WHEN event_id % 17 <> 0 THEN round(value * 100)::BIGINT / 1000000.0::DOUBLE END AS cost, (event_id % 97) / 10.0::DOUBLE AS latency_seconds,
  CASE WHEN event_id % 5 <> 0 THEN event_id % 40 END AS reasoning_tokens, event_id % 3 + 1 AS attempts,
  CASE WHEN user_id % 4 <> 2 AND event_id % 23 = 1 THEN 'timeout' END AS error, CASE WHEN event_id % 6 <> 0 THEN event_id % 4 <> 0 END AS agrees FROM events)"""


def call_log(spark, sf) -> DataFrame:
    """A call log derived from the events: model, kind, cost, latency, tokens, attempts, error."""
    e = F.col("event_id")
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.concat(F.lit("model_"), F.col("user_id") % 4).alias("model"),
        F.element_at(F.array(F.lit("reason"), F.lit("incident"), F.lit("judge")), (e % 3).cast("int") + 1).alias("kind"),
        F.when(e % 17 != 0, F.round(F.col("value") * 100).cast("long") / 1_000_000.0).alias("cost"),
        ((e % 97) / 10.0).alias("latency_seconds"), F.when(e % 5 != 0, e % 40).alias("reasoning_tokens"), (e % 3 + 1).alias("attempts"),
        F.when((F.col("user_id") % 4 != 2) & (e % 23 == 1), "timeout").alias("error"), F.when(e % 6 != 0, e % 4 != 0).alias("agrees"),
    )


AGG_RATIOS = ["total_cost", "mean_latency_seconds", "mean_reasoning_tokens", "first_attempt_rate", "agreement_rate"]
MODELS = """m AS (SELECT model, count(*) AS n_calls, count(error) AS n_errors, count(*) FILTER (error IS NULL) AS n_successes,
  coalesce(sum(cost) FILTER (error IS NULL), 0) AS total_cost, avg(latency_seconds) AS mean_latency_seconds,
  coalesce(sum(reasoning_tokens) FILTER (error IS NULL), 0)::BIGINT AS total_reasoning_tokens, avg(reasoning_tokens) FILTER (error IS NULL) AS mean_reasoning_tokens,
  (count(*) FILTER (error IS NULL AND attempts = 1)) / nullif(count(*) FILTER (error IS NULL), 0)::DOUBLE AS first_attempt_rate,
  (count(*) FILTER (error IS NULL AND agrees)) / nullif(count(agrees) FILTER (error IS NULL), 0)::DOUBLE AS agreement_rate FROM c GROUP BY 1)"""


@query("model_aggregates", f"{CALL_SQL}, {MODELS} SELECT model, n_calls, n_errors, n_successes, total_reasoning_tokens, {sql_rounded(*AGG_RATIOS)} FROM m")
def model_aggregates(spark, sf):
    return calls.model_aggregates(call_log(spark, sf)).select(
        "model", "n_calls", "n_errors", "n_successes", "total_reasoning_tokens", *rounded(*AGG_RATIOS)
    )


@query("default_model", f"{CALL_SQL}, {MODELS} SELECT model, n_errors FROM m ORDER BY n_errors, total_cost, mean_latency_seconds, model LIMIT 1")
def default_model(spark, sf):
    return calls.pick_default_model(calls.model_aggregates(call_log(spark, sf))).select("model", "n_errors")


SPEND = ["reason_cost", "incident_cost", "judge_cost", "total_spend", "per_100k_cold", "per_100k_warm"]


@query("spend_summary", (
    f"{CALL_SQL}, k AS (SELECT count(*) FILTER (kind = 'reason') AS reason_calls, coalesce(sum(cost) FILTER (kind = 'reason'), 0) AS reason_cost, "
    "count(*) FILTER (kind = 'incident') AS incident_calls, coalesce(sum(cost) FILTER (kind = 'incident'), 0) AS incident_cost, "
    "count(*) FILTER (kind = 'judge') AS judge_calls, coalesce(sum(cost) FILTER (kind = 'judge'), 0) AS judge_cost, (SELECT count(*) FROM events) AS n_events, "
    "(SELECT count(DISTINCT user_id) FROM events) AS n_incidents_detected FROM c), "
    "s AS (SELECT *, reason_cost + incident_cost + judge_cost AS total_spend, incident_cost / incident_calls * n_incidents_detected * 100000.0::DOUBLE / n_events AS per_100k_warm FROM k), "
    "z AS (SELECT *, reason_cost + per_100k_warm AS per_100k_cold FROM s) "
    f"SELECT reason_calls, incident_calls, judge_calls, n_events, n_incidents_detected, {sql_rounded(*SPEND)} FROM z"
))
def spend_summary(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    out = calls.spend_summary(
        call_log(spark, sf), events.agg(F.count("*")), events.select("user_id").distinct().agg(F.count("*"))
    )
    return out.select("reason_calls", "incident_calls", "judge_calls", "n_events", "n_incidents_detected", *rounded(*SPEND))


VERDICT_SQL = """WITH v AS (SELECT event_id::VARCHAR AS subject_id, event_id % 7 <> 0 AS agrees, (['low', 'medium', 'high'])[(event_id % 3)::INT + 1] AS confidence,
  CASE WHEN event_id % 21 = 0 THEN 'wrong' WHEN event_id % 7 = 0 THEN 'questionable' ELSE 'correct' END AS verdict, (event_id % 50) / 1000.0::DOUBLE AS cost FROM events)"""


def verdict_log(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return spark.read.parquet(f"{sf}/events.parquet").select(
        e.cast("string").alias("subject_id"), (e % 7 != 0).alias("agrees"),
        F.element_at(F.array(*[F.lit(c) for c in K.CONFIDENCES]), (e % 3).cast("int") + 1).alias("confidence"),
        F.when(e % 21 == 0, "wrong").when(e % 7 == 0, "questionable").otherwise("correct").alias("verdict"), ((e % 50) / 1000.0).alias("cost"),
    )


@query("verdict_summary", (
    f"{VERDICT_SQL} SELECT count(*) AS n_sampled, count(*) FILTER (NOT agrees) AS n_disagree, count(*) FILTER (verdict = 'wrong') AS n_wrong, "
    "round(sum(cost), 6) AS total_cost, round(count(*) FILTER (NOT agrees) / count(*)::DOUBLE, 6) AS disagreement_rate FROM v"
))
def verdict_summary(spark, sf):
    return calls.verdict_summary(verdict_log(spark, sf)).select(
        "n_sampled", "n_disagree", "n_wrong", *rounded("total_cost", "disagreement_rate")
    )


@query("wrong_verdicts", f"{VERDICT_SQL} SELECT subject_id, confidence FROM v WHERE verdict = 'wrong'")
def wrong_verdicts(spark, sf):
    return calls.wrong_cases(verdict_log(spark, sf))


@query("seeded_sample", f"{FV} SELECT payment_id FROM failures ORDER BY sha256('7:' || payment_id), payment_id LIMIT 100")
def seeded_sample(spark, sf):
    return calls.seeded_sample(failures_from_tables(spark, sf).select("payment_id"), "payment_id", 100, 7)


@query("outlier_enriched_sample", (
    f"{FV}, {RARE}, x AS (SELECT *, row_number() OVER (PARTITION BY is_outlier ORDER BY sha256('7:' || payment_id), payment_id) AS rn FROM fo) "
    "SELECT payment_id, is_outlier FROM x WHERE is_outlier OR rn <= 500 - (SELECT count(*) FROM fo WHERE is_outlier)"
))
def outlier_enriched_sample(spark, sf):
    tagged = corpus.tag_outliers(failures_from_tables(spark, sf))
    return calls.outlier_enriched_sample(tagged, 500, 7).select("payment_id", "is_outlier")
