"""Groupings of failures: structured root cause, template hash, mined templates, density.

Each is a callable ``DataFrame -> DataFrame(payment_id, pred_label)`` over failures with a
``masked_description``; use them with ``DataFrame.transform``. Noise is labelled -1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch.functions.text import mask_description, template_hash
from tillwatch.functions.timegrid import micros
from tillwatch.operators.components import connected_components
from tillwatch.session import checkpointed

NOISE = -1
ROOT_CAUSE = ["error_code", "error_source", "error_step", "error_reason"]
RANK_BUCKETS = 1024

Clusterer = Callable[[DataFrame], DataFrame]


def with_masked(failures: DataFrame) -> DataFrame:
    """Add ``masked_description``, never NULL: a join on it then infers no null filter, which
    would be pushed down to the scan and run the masking a second time there."""
    return failures.withColumn(
        "masked_description", F.coalesce(mask_description(F.col("description")), F.lit(""))
    )


def rank_by_first_seen(groups: DataFrame, start: int = 0) -> DataFrame:
    """Number groups by their ``first`` struct (created_at, payment_id) without a global sort.

    Groups are ranked inside time buckets; the offset of a bucket is the running count of the
    buckets before it, a table of at most 1,024 rows. The groups are checkpointed: they are read
    several times here, and the failures behind them should be read once.
    """
    groups = checkpointed(groups)
    us = micros(F.col("first.created_at"))
    range_ = groups.agg(F.struct(F.min(us).alias("low"), F.max(us).alias("high")).alias("r")).scalar()
    width = F.call_function("div", range_["high"] - range_["low"], F.lit(RANK_BUCKETS)) + 1
    placed = groups.withColumn("_bucket", F.call_function("div", us - range_["low"], width))
    sizes = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    running = F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_bucket", F.coalesce(running, F.lit(0)).alias("_offset"))
    within = F.row_number().over(W.partitionBy("_bucket").orderBy("first"))
    return placed.join(offsets, "_bucket").withColumn(
        "label", (F.col("_offset") + within - 1 + start).cast("long")
    ).drop("_bucket", "_offset")


def first_seen_labels(rows: DataFrame, keys: Sequence[str], start: int = 0) -> DataFrame:
    """One row per distinct key: dense label in first-seen order, and its size."""
    groups = rows.groupBy(*keys).agg(
        F.min(F.struct("created_at", "payment_id")).alias("first"), F.count("*").alias("n")
    )
    return rank_by_first_seen(groups, start)


def _labelled(rows: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give every row its group's label; AQE splits a hot group, and the label table is
    broadcast only when Spark measures it as small."""
    return rows.join(labels.select(*keys, F.col("label").alias("pred_label")), list(keys)).select(
        "payment_id", "pred_label"
    )


def group_by_root_cause(failures: DataFrame) -> DataFrame:
    return _labelled(failures, first_seen_labels(failures, ROOT_CAUSE), ROOT_CAUSE)


def group_by_template(failures: DataFrame) -> DataFrame:
    hashed = failures.withColumn("template", F.coalesce(template_hash(F.col("masked_description")), F.lit("")))
    return _labelled(hashed, first_seen_labels(hashed, ["template"]), ["template"])


def distinct_templates(failures: DataFrame) -> DataFrame:
    """Distinct masked texts with multiplicity and first sighting; copies stop costing here."""
    return failures.groupBy("masked_description").agg(
        F.min(F.struct("created_at", "payment_id")).alias("first"), F.count("*").alias("n")
    )


class TemplateIndex:
    """The groups of one leaf, found by position and token.

    A group's tokens are those all its texts share, wildcards elsewhere. A text of L tokens joins a group only if at least
    c = ceil(threshold * L) positions agree, so the group stands in one of any L - c + 1 of the text's posting lists: only the
    shortest ones are looked at, and only groups in them are compared.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.groups: list[list[str]] = []
        self.wildcards: list[int] = []
        self.posted: dict[tuple[int, str], set[int]] = {}

    def needed(self, length: int) -> int:
        """Fewest agreeing positions of ``length`` that reach the threshold."""
        count = max(0, int(self.threshold * length) - 1)
        while count / length < self.threshold:
            count += 1
        return count

    def best(self, words: list[str]) -> int | None:
        """The group to join: most agreeing positions, then most wildcards, then the oldest."""
        needed = self.needed(len(words))
        if needed > len(words):
            return None
        if needed == 0:
            candidates = set(range(len(self.groups)))
        else:
            lists = sorted((self.posted.get((i, w), ()) for i, w in enumerate(words)), key=len)
            candidates = set().union(*lists[: len(words) - needed + 1])
        found = None
        for number in candidates:
            group = self.groups[number]
            same = sum(a == b for a, b in zip(group, words) if a != "<*>")
            if same >= needed:
                score = (same, self.wildcards[number], -number)
                found = score if found is None else max(found, score)
        return None if found is None else -found[2]

    def add(self, words: list[str]) -> int:
        """Join the best group, turning its differing positions into wildcards, or open one; the group's number."""
        number = self.best(words)
        if number is None:
            number = len(self.groups)
            self.groups.append(list(words))
            self.wildcards.append(words.count("<*>"))
            for i, word in enumerate(words):
                if word != "<*>":
                    self.posted.setdefault((i, word), set()).add(number)
            return number
        group = self.groups[number]
        for i, (own, word) in enumerate(zip(group, words)):
            if own != word and own != "<*>":
                group[i] = "<*>"
                self.wildcards[number] += 1
                self.posted[i, own].discard(number)
        return number


#: Distinct texts from which on a leaf is split.
SPLIT_TEXTS = 50_000


def split_leaves(rows: DataFrame, threshold: float, split_texts: int = SPLIT_TEXTS) -> DataFrame:
    """Give texts (text_no, tokens, leaf) of large leaves a ``part`` such that texts of different parts never share a group.

    A group's tokens are common to all its texts, so texts of one group agree in at least c positions. Of the S pairs
    (position, token) that a text shares with any other, its S - c + 1 rarest are posted: two texts that agree in c positions
    share one of these (prefix filter). Texts tied by shared pairs, directly or not, are a part. Text and smallest text of a pair are linked, so
    links grow with the texts, not with their pairs.
    """
    large = rows.groupBy("leaf").agg(F.count("*").alias("texts")).where(F.col("texts") > split_texts).select("leaf")
    if large.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long"))
    big = rows.join(large, "leaf").select("text_no", "leaf", F.size("tokens").alias("length"), F.posexplode("tokens").alias("at", "token"))
    pairs = big.groupBy("leaf", "at", "token").agg(F.count("*").alias("df"), F.min("text_no").alias("least"))
    order = W.partitionBy("text_no").orderBy("df", "at")
    shared = F.count("*").over(W.partitionBy("text_no"))
    kept = shared - F.ceil(F.lit(threshold) * F.col("length") - 1e-9) + 1
    ties = (
        big.join(pairs.where("df > 1"), ["leaf", "at", "token"]).withColumn("rank", F.row_number().over(order)).withColumn("kept", kept)
        .where(F.col("rank") <= F.col("kept")).select(F.col("text_no").alias("a"), F.col("least").alias("b")).distinct()
    )
    parts = connected_components(ties).select(F.col("node").alias("text_no"), F.col("component").alias("part"))
    return rows.join(parts, "text_no", "left").join(large.withColumn("_large", F.lit(True)), "leaf", "left").withColumn(
        "part", F.when(F.col("_large"), F.coalesce("part", "text_no")).otherwise(0)).drop("_large")


def mine_templates(templates: DataFrame, threshold: float = 0.4, split_texts: int = SPLIT_TEXTS) -> DataFrame:
    """Merge token templates leaf by leaf, in first-seen order.

    A leaf holds texts with the same token count and leading token. Each text joins the most
    similar group of its leaf when enough positions agree, and turns the differing positions
    into wildcards; otherwise it opens a group. Rows stream in order, so a leaf is never
    collected; only its groups are held, in an index by position and token. Large leaves are split into
    parts that cannot meet. Returns the group as ``(leaf, part, group_no)``.
    """
    tokens = F.split(F.trim(F.col("masked_description")), r"\s+")
    lead = F.element_at(tokens, 1)
    leaf = F.concat_ws("|", F.size(tokens).cast("string"), F.when(lead.rlike(r"\d"), "<*>").otherwise(lead))
    rows = templates.select("masked_description", "first", "n", tokens.alias("tokens"), leaf.alias("leaf"), F.xxhash64("masked_description").alias("text_no"))
    ordered = split_leaves(rows, threshold, split_texts).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "first").select(
        "masked_description", "leaf", "part", "tokens"
    )

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, index = None, TemplateIndex(threshold)
        for batch in batches:
            numbers = []
            for leaf_name, part, words in zip(batch["leaf"], batch["part"], batch["tokens"], strict=True):
                if (leaf_name, part) != current:
                    current, index = (leaf_name, part), TemplateIndex(threshold)
                numbers.append(index.add(list(words)))
            yield batch[["masked_description", "leaf", "part"]].assign(group_no=numbers)

    mined = ordered.mapInPandas(mine, "masked_description string, leaf string, part long, group_no long")
    return mined.join(templates, "masked_description")


def cluster_by_mined_template(failures: DataFrame) -> DataFrame:
    """Mined groups as labels, numbered from 1 in first-seen order."""
    mined = checkpointed(mine_templates(checkpointed(distinct_templates(failures))))
    group = ["leaf", "part", "group_no"]
    labels = rank_by_first_seen(mined.groupBy(*group).agg(F.min("first").alias("first")), start=1)
    by_text = mined.join(labels.select(*group, "label"), group)
    return _labelled(failures, by_text, ["masked_description"])


def tfidf_vectors(templates: DataFrame, max_features: int | None = None) -> DataFrame:
    """Unit TF-IDF weights ``(masked_description, n, term, weight)``: words of two or more
    letters, smoothed idf, documents counted with their multiplicity. All terms count unless
    ``max_features`` asks for the most used ones."""
    words = F.filter(F.split(F.lower("masked_description"), r"(?U)\W+"), lambda w: F.length(w) >= 2)
    terms = templates.select("masked_description", "n", F.explode(words).alias("term")).groupBy(
        "masked_description", "n", "term"
    ).agg(F.count("*").alias("tf"))
    vocabulary = terms.groupBy("term").agg(F.sum(F.col("tf") * F.col("n")).alias("uses"), F.sum("n").alias("df"))
    if max_features is not None:
        vocabulary = vocabulary.orderBy(F.col("uses").desc(), "term").limit(max_features)
    total = templates.agg(F.sum("n")).scalar()
    idf = F.log((1 + total) / (1 + F.col("df"))) + 1
    weighted = terms.join(vocabulary, "term").select(
        "masked_description", "n", "term", (F.col("tf") * idf).alias("raw")
    )
    norms = weighted.groupBy("masked_description").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return weighted.join(norms, "masked_description").select(
        "masked_description", "n", "term", (F.col("raw") / F.col("norm")).alias("weight")
    )


def prefix_terms(vectors: DataFrame, cosine_cut: float) -> DataFrame:
    """(id, term): the terms under which a unit vector (id, term, weight) must be posted to meet all its neighbours.

    Terms are put in one order, rarest first, and each vector keeps the shortest prefix after which
    what is left is shorter than the cut. Two vectors without a common prefix term have all their
    common terms in one of the rests, so their cosine is below the cut (Cauchy-Schwarz): joining on
    prefix terms loses no pair, and the frequent words of all texts are never joined on.
    """
    usage = vectors.groupBy("term").agg(F.count("*").alias("texts"))
    rest = W.partitionBy("id").orderBy(F.col("texts").desc(), F.col("term").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        vectors.join(usage, "term")
        .withColumn("left", F.sum(F.col("weight") * F.col("weight")).over(rest))
        .filter(F.col("left") >= cosine_cut * cosine_cut - 1e-9).select("id", "term")
    )


def close_of(candidates: DataFrame, vectors: DataFrame, cosine_cut: float) -> DataFrame:
    """Of pairs of ids the distinct ones (a < b) whose cosine is at or above the cut."""
    pairs = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    left = vectors.select(F.col("id").alias("a"), "term", F.col("weight").alias("wa"))
    right = vectors.select(F.col("id").alias("b"), "term", F.col("weight").alias("wb"))
    dots = pairs.join(left, "a").join(right, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return dots.filter(F.round("cosine", 9) >= cosine_cut).select("a", "b")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _core(sizes: DataFrame, pairs: DataFrame, min_size: int) -> DataFrame:
    """Ids that stand for at least ``min_size`` rows together with the neighbours in ``pairs``."""
    around = _both_ways(pairs).join(sizes.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("n").alias("around"))
    return sizes.join(around.withColumnRenamed("a", "id"), "id", "left").filter(
        F.col("n") + F.coalesce("around", F.lit(0)) >= min_size).select("id")


def _clusters_of_core(core: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root): core texts tied by pairs of core texts."""
    links = pairs.join(core.select(F.col("id").alias("a")), "a").join(core.select(F.col("id").alias("b")), "b")
    joined = core.join(connected_components(links).withColumnRenamed("node", "id"), "id", "left")
    return joined.select("id", F.coalesce("component", "id").alias("root"))


def core_clusters(vectors: DataFrame, cosine_cut: float, min_size: int, hubs: int) -> tuple[DataFrame, DataFrame]:
    """(id, root) of all core texts, and all close pairs of the texts that are not core; no dense group becomes pairs.

    Each text is compared with the ``hubs`` smallest ids of its posting lists first. Where these neighbours reach the minimum
    the text is core, however many more it has (the count stops there). Only texts that stay in doubt are compared with
    all of their lists, which also settles who is core and who lies at a border. Core texts tied so far are
    clusters; in a list that still holds several of them, members outside its largest are compared with the others.
    """
    sizes = vectors.select("id", "n").distinct()
    prefix = checkpointed(prefix_terms(vectors, cosine_cut))
    first = prefix.withColumn("_r", F.row_number().over(W.partitionBy("term").orderBy("id"))).where(F.col("_r") <= hubs)
    with_hubs = prefix.withColumnRenamed("id", "a").join(first.select("term", F.col("id").alias("b")), "term")
    near = checkpointed(close_of(with_hubs, vectors, cosine_cut))
    known = checkpointed(_core(sizes, near, min_size))
    doubtful = prefix.join(known, "id", "left_anti").withColumnRenamed("id", "a")
    wide = checkpointed(close_of(doubtful.join(prefix.withColumnRenamed("id", "b"), "term"), vectors, cosine_cut))
    pairs = near.unionByName(wide).distinct()
    core = checkpointed(known.unionByName(_core(sizes, pairs, min_size)).distinct())
    rooted = checkpointed(_clusters_of_core(core, pairs))

    placed = prefix.join(rooted, "id")
    counts = placed.groupBy("term", "root").agg(F.count("*").alias("texts"))
    heads = counts.groupBy("term").agg(F.max_by("root", F.struct("texts", "root")).alias("head"), F.count("*").alias("roots")).where("roots > 1")
    members = placed.join(heads.select("term", "head"), "term")
    outside = members.where("root <> head").select("term", F.col("id").alias("a"), F.col("root").alias("ra"))
    apart = outside.join(members.select("term", F.col("id").alias("b"), F.col("root").alias("rb")), "term").where("ra <> rb")
    across = checkpointed(close_of(apart, vectors, cosine_cut))
    roots = rooted.select(F.col("id").alias("a"), F.col("root").alias("ra")), rooted.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    ties = across.join(roots[0], "a").join(roots[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    merged = connected_components(ties).select(F.col("node").alias("root"), "component")
    final = rooted.join(merged, "root", "left").select("id", F.coalesce("component", "root").alias("root"))
    return final, _both_ways(wide)


def density_labels(failures: DataFrame, min_cluster_size: int = 5, max_features: int | None = None, cosine_cut: float = 0.7) -> DataFrame:
    """Density clusters over TF-IDF as ``(masked_description, n, label)``, noise -1.

    A text is core when it and its neighbours (cosine at or above the cut) stand for at least
    ``min_cluster_size`` rows; core texts that are neighbours share a cluster, other texts join the
    first-seen cluster among their core neighbours. The minimum shrinks to half the rows (at least
    2) when there are fewer than twice as many. Clusters are numbered in first-seen order.
    """
    templates = checkpointed(rank_by_first_seen(distinct_templates(failures)).withColumnRenamed("label", "id"))
    total = templates.agg(F.sum("n")).first()[0] or 0
    min_size = min(min_cluster_size, max(2, total // 2))
    vectors = checkpointed(
        tfidf_vectors(templates.select("masked_description", "n"), max_features)
        .join(templates.select("masked_description", "id"), "masked_description").select("id", "n", "term", "weight")
    )
    found, pairs = core_clusters(vectors, cosine_cut, min_size, min_cluster_size)
    rooted = checkpointed(found)
    border = (
        pairs.join(rooted.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("root"))
        .withColumnRenamed("a", "id").join(rooted.select("id"), "id", "left_anti")
    )
    placed = templates.join(rooted.unionByName(border), "id", "left")
    clusters = placed.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("first"))
    labels = rank_by_first_seen(clusters).select("root", "label")
    return placed.join(labels, "root", "left").select(
        "masked_description", "n", F.coalesce("label", F.lit(0 if total == 1 else NOISE)).cast("long").alias("label"),
    )


def cluster_by_density(failures: DataFrame) -> DataFrame:
    return _labelled(failures, density_labels(failures), ["masked_description"])


CLUSTERERS: dict[str, Clusterer] = {
    "groupby_reason": group_by_root_cause,
    "template_hash": group_by_template,
    "template_mining": cluster_by_mined_template,
    "tfidf_density": cluster_by_density,
}
