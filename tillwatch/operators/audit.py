"""Hash-chained decision log: assembly, chaining and verification.

A hash chain is sequential, so there is one chain per day and shard, never one for the table.
The number of shards per day is a fixed parameter of the log: a payment's chain then does not depend
on how its rows are batched. Choose it so that a day's rows over the shards fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch import constants as K
from tillwatch.session import checkpointed

SHARDS_PER_DAY = 64
EVALUATION_FIELDS = ["action_after", "action_before", "blocked", "name", "reason"]
BEFORE_LINK = [
    "amount", "attempt_number", "bank", "base_action", "candidate_action", "created_at", "customer_id",
    "diagnosis_confidence", "diagnosis_rationale", "diagnosis_tier", "error_code", "error_reason",
    "error_source", "error_step", "execution", "final_action", "guardrail_evaluations", "in_active_incident",
    "justification", "ladder_terminal_state", "method", "order_id", "payment_id",
]
ERROR_CODES = ("error_code", "error_source", "error_step")
AFTER_LINK = ["recorded_at", "remediation_class", "schema_version", "sequence"]


def audit_rows(
    decisions: DataFrame, failures: DataFrame, diagnoses: DataFrame, recorded_at: str
) -> DataFrame:
    """Audit rows from executed decisions, their failures and their diagnoses.

    ``decisions`` carries ``execution``. Decision and failure meet on the unique payment id, unless the decisions
    have kept ``ERROR_CODES`` (see ``decide_batch``).
    """
    reasons = diagnoses.select(F.col("reason").alias("error_reason"), F.col("rationale").alias("diagnosis_rationale"))
    evaluations = F.transform(
        "guardrail_evaluations", lambda e: F.struct(*[e[name].alias(name) for name in EVALUATION_FIELDS])
    )
    if not set(ERROR_CODES) <= set(decisions.columns):
        decisions = decisions.join(failures.select("payment_id", *ERROR_CODES), "payment_id")
    joined = decisions.join(reasons, "error_reason", "left")
    return joined.withColumns({
        "guardrail_evaluations": evaluations,
        "chain_day": F.date_format("created_at", "yyyy-MM-dd"),
        "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "recorded_at": F.lit(recorded_at), "schema_version": F.lit(K.AUDIT_SCHEMA_VERSION),
    }).select(*BEFORE_LINK, "recorded_at", "remediation_class", "schema_version", "chain_day")


def assign_chains(rows: DataFrame, shards_per_day: int = SHARDS_PER_DAY, tips: DataFrame | None = None) -> DataFrame:
    """Add ``chain_id``, ``sequence`` and the hash to continue from.

    ``tips`` (chain_id, last_sequence, last_hash) resumes existing chains, see ``chain_tips``.
    """
    shard = F.pmod(F.conv(F.substring(F.md5("payment_id"), 1, 8), 16, 10).cast("long"), F.lit(shards_per_day))
    sharded = rows.withColumn("chain_id", F.concat_ws("/", "chain_day", F.lpad(shard.cast("string"), 5, "0"))).repartition("chain_id")
    order = W.partitionBy("chain_id").orderBy("created_at", "payment_id")
    numbered = sharded.withColumn("sequence", (F.row_number().over(order) - 1).cast("long"))
    if tips is None:
        return numbered.withColumn("_tip", F.lit(None).cast("string"))
    continued = numbered.join(tips, "chain_id", "left")
    return continued.withColumn("sequence", F.col("sequence") + F.coalesce(F.col("last_sequence") + 1, F.lit(0))).withColumn(
        "_tip", F.col("last_hash")
    ).drop("last_sequence", "last_hash")


def canonical_parts(before: list[str] = BEFORE_LINK, after: list[str] = AFTER_LINK) -> tuple[Column, Column]:
    """Canonical JSON (sorted keys, compact, nulls kept) split around the value of ``prev_hash``."""
    keep_nulls = {"ignoreNullFields": "false"}
    head, tail = F.to_json(F.struct(*before), keep_nulls), F.to_json(F.struct(*after), keep_nulls)
    return (
        F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"prev_hash":')),
        F.concat(F.lit(","), F.substring(tail, F.lit(2), F.length(tail))),
    )


def link_hash(prev_hash: Column, head: Column, tail: Column) -> Column:
    """SHA-256 over the previous hash, a bar, and the canonical JSON that repeats the link."""
    shown = F.coalesce(F.concat(F.lit('"'), prev_hash, F.lit('"')), F.lit("null"))
    return F.sha2(F.concat(F.coalesce(prev_hash, F.lit("")), F.lit("|"), head, shown, tail), 256)


def _link(prev: str | None, head: str, tail: str) -> str:
    shown = f'"{prev}"' if prev is not None else "null"
    return hashlib.sha256(f"{prev or ''}|{head}{shown}{tail}".encode()).hexdigest()


def chain_rows(numbered: DataFrame, head: Column, tail: Column, placed: bool = False) -> DataFrame:
    """Add ``prev_hash`` and ``record_hash`` along each ``chain_id`` in ``sequence`` order.

    Rows pass through as Arrow batches; per task only the last hash is held. ``placed`` says that each chain is in one task
    and in order already, as ``assign_chains`` leaves it; the canonical texts are made after rows have moved.
    """
    if not placed:
        numbered = numbered.repartition("chain_id").sortWithinPartitions("chain_id", "sequence")
    prepared = ordered = numbered.withColumn("_head", head).withColumn("_tail", tail)
    kept = [field for field in prepared.schema.fields if not field.name.startswith("_")]
    names = [field.name for field in kept]
    schema = T.StructType([*kept, T.StructField("prev_hash", T.StringType()), T.StructField("record_hash", T.StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = None, None
        for batch in batches:
            links, hashes = [], []
            columns = [batch.column(name).to_pylist() for name in ("chain_id", "_tip", "_head", "_tail")]
            for chain_id, tip, before, after in zip(*columns, strict=True):
                if chain_id != chain:
                    chain, last = chain_id, tip
                links.append(last)
                last = _link(last, before, after)
                hashes.append(last)
            arrays = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(links, pa.string()), pa.array(hashes, pa.string())], [*names, "prev_hash", "record_hash"]
            )

    return ordered.mapInArrow(walk, schema)


def build_chain(rows: DataFrame, shards_per_day: int = SHARDS_PER_DAY, tips: DataFrame | None = None) -> DataFrame:
    head, tail = canonical_parts()
    return chain_rows(assign_chains(rows, shards_per_day, tips), head, tail, placed=True)


def chain_tips(log: DataFrame) -> DataFrame:
    """Last sequence and hash of every chain."""
    return log.groupBy("chain_id").agg(
        F.max("sequence").alias("last_sequence"), F.max_by("record_hash", "sequence").alias("last_hash")
    )


def verify_chains(log: DataFrame, head: Column | None = None, tail: Column | None = None) -> DataFrame:
    """First break per chain: a link that misses its predecessor, or content that was altered.

    Content checks are row-wise. Links are checked by an equi join with the predecessor's
    sequence, so even one endless chain spreads over all tasks.
    """
    return _first_breaks(log, F.lit(None).cast("string"), head, tail)


def _first_breaks(log: DataFrame, continued: Column, head: Column | None, tail: Column | None) -> DataFrame:
    """``continued`` is the hash a record must link to when its predecessor is not among the rows.

    Contents are hashed before the join, so that hashes alone are shuffled.
    """
    if head is None or tail is None:
        head, tail = canonical_parts()
    altered = F.col("record_hash") != link_hash(F.col("prev_hash"), head, tail)
    narrow = log.select("chain_id", "sequence", "prev_hash", altered.alias("_altered"), continued.alias("_continued"))
    before = log.select("chain_id", (F.col("sequence") + 1).alias("sequence"), F.col("record_hash").alias("_expected"))
    linked = narrow.join(before, ["chain_id", "sequence"], "left")
    broken_link = ~F.col("prev_hash").eqNullSafe(F.coalesce("_expected", "_continued"))
    problem = F.when(broken_link, "broken link").when(F.col("_altered"), "altered content")
    return linked.select("chain_id", "sequence", problem.alias("problem")).groupBy("chain_id").agg(
        F.count("*").alias("n_records"), F.count("problem").alias("n_problems"),
        F.min(F.when(F.col("problem").isNotNull(), F.struct("sequence", "problem"))).alias("first"),
    ).select(
        "chain_id", "n_records", (F.col("n_problems") == 0).alias("valid"),
        F.col("first.sequence").alias("first_broken_sequence"), F.col("first.problem").alias("detail"),
    )


def verify_since(log: DataFrame, verified: DataFrame, head: Column | None = None, tail: Column | None = None) -> DataFrame:
    """Like ``verify_chains``, but only over records after the last verified tip of their chain.

    ``verified`` (chain_id, last_sequence, last_hash) is what ``chain_tips`` gave when the log was last found valid. The first
    new record of a chain must continue that hash; a record before it is not looked at (see ``tree_roots``).
    A chain that has nothing new has no row.
    """
    known = verified.select("chain_id", F.col("last_sequence").alias("_from"), F.col("last_hash").alias("_hash"))
    new = log.join(known, "chain_id", "left").where(F.col("_from").isNull() | (F.col("sequence") > F.col("_from")))
    return _first_breaks(new, F.when(F.col("sequence") == F.col("_from") + 1, F.col("_hash")), head, tail)


def record_leaves(log: DataFrame, head: Column | None = None, tail: Column | None = None) -> DataFrame:
    """(chain_id, sequence, leaf): each record's hash recomputed from its content, which is what a tree stands on."""
    if head is None or tail is None:
        head, tail = canonical_parts()
    return log.select("chain_id", "sequence", link_hash(F.col("prev_hash"), head, tail).alias("leaf"))


#: Levels of a hash tree that one pass folds inside a block of consecutive nodes.
TREE_LEVELS = 10


def hash_tree(leaves: DataFrame, levels: int = TREE_LEVELS) -> DataFrame:
    """Nodes (chain_id, level, position, hash) of one binary hash tree per chain; level 0 holds the leaves at their sequence.

    A node is the SHA-256 of its two children's hashes side by side; one without a sibling goes up as it is. Every pass
    folds ``levels`` levels inside blocks of 2^levels nodes, so a chain of a million records takes two shuffles and no
    task holds more than blocks.
    """
    size = 1 << levels
    nodes = leaves.select("chain_id", F.col("sequence").alias("position"), F.col("leaf").alias("hash"))
    largest = nodes.agg(F.max("position")).first()[0]
    if largest is None:
        return nodes.select("chain_id", F.lit(0).alias("level"), "position", "hash")
    done, below = None, 0

    def folded(line: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.call_function("div", F.size(line) - 1, F.lit(2)).cast("int"))
        right = lambda i: F.get(line, (2 * i + 1).cast("int"))
        left = lambda i: F.get(line, (2 * i).cast("int"))
        return F.transform(pairs, lambda i: F.when(right(i).isNull(), left(i)).otherwise(F.sha2(F.concat(left(i), right(i)), 256)))

    while True:
        blocks = nodes.groupBy("chain_id", F.call_function("div", "position", F.lit(size)).alias("block")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("position", "hash"))), lambda x: x["hash"]).alias("line"))
        grown = F.aggregate(
            F.sequence(F.lit(1), F.lit(levels)), F.array("line"),
            lambda lines, _: F.concat(lines, F.array(folded(F.element_at(lines, -1)))))
        lines = checkpointed(blocks.select("chain_id", "block", F.posexplode(grown).alias("up", "line")))
        placed = lines.select("chain_id", "block", "up", F.posexplode("line").alias("at", "hash"))
        width = (F.lit(size) / F.pow(F.lit(2.0), F.col("up"))).cast("long")
        part = placed.where(F.col("up") < levels).select(
            "chain_id", (F.col("up") + below).alias("level"), (F.col("block") * width + F.col("at")).alias("position"), "hash")
        done = part if done is None else done.unionByName(part)
        nodes = placed.where(F.col("up") == levels).select("chain_id", F.col("block").alias("position"), "hash")
        below, largest = below + levels, largest // size
        if largest == 0:
            return done.unionByName(nodes.select("chain_id", F.lit(below).alias("level"), "position", "hash"))


def tree_roots(tree: DataFrame) -> DataFrame:
    """(chain_id, n_records, root): a record altered, lost or added anywhere gives another root."""
    top = tree.where("position = 0").groupBy("chain_id").agg(F.max_by("hash", "level").alias("root"))
    return tree.where("level = 0").groupBy("chain_id").agg(F.count("*").alias("n_records")).join(top, "chain_id")


def inclusion_proofs(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """For wanted (chain_id, position) the leaf and the siblings on its way up: (level, on_left, hash) in order.

    A level where the node has no sibling is left out.
    """
    height = tree.groupBy("chain_id").agg(F.max("level").alias("height"))
    steps = wanted.join(height, "chain_id").select(
        "chain_id", "position", F.explode(F.sequence(F.lit(0), F.col("height"))).alias("level")).withColumn(
        "_at", F.expr("CAST(floor(position / power(2, level)) AS BIGINT)"))
    steps = steps.withColumn("_sibling", F.when(F.col("_at") % 2 == 0, F.col("_at") + 1).otherwise(F.col("_at") - 1))
    nodes = tree.select("chain_id", "level", F.col("position").alias("_sibling"), "hash")
    met = steps.join(nodes, ["chain_id", "level", "_sibling"]).groupBy("chain_id", "position").agg(
        F.sort_array(F.collect_list(F.struct("level", (F.col("_sibling") < F.col("_at")).alias("on_left"), "hash"))).alias("siblings"))
    leaves = tree.where("level = 0").select("chain_id", "position", F.col("hash").alias("leaf"))
    return wanted.join(leaves, ["chain_id", "position"]).join(met, ["chain_id", "position"], "left").select(
        "chain_id", "position", "leaf", F.coalesce("siblings", F.expr("CAST(array() AS array<struct<level: int, on_left: boolean, hash: string>>)")).alias("siblings"))


def proven_root(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to; it proves the leaf if it is the chain's root."""
    return F.aggregate(siblings, leaf, lambda h, s: F.sha2(F.when(s["on_left"], F.concat(s["hash"], h)).otherwise(F.concat(h, s["hash"])), 256))


def records_for_payment(log: DataFrame, payment_id: str, day: str | None = None) -> DataFrame:
    """Audit rows of one payment in log order; an unknown payment is an error when the rows are read.

    ``day`` (yyyy-MM-dd) prunes the log to one partition.
    """
    if day is not None:
        log = log.filter(F.col("chain_day") == day)
    found = log.filter(F.col("payment_id") == payment_id)
    columns = found.columns
    gathered = found.agg(F.collect_list(F.struct(*columns)).alias("rows"))
    missing = F.raise_error(F.lit(f"no audit record for payment {payment_id}"))
    rows = F.when(F.size("rows") > 0, F.col("rows")).otherwise(missing)
    checked = gathered.select(F.explode(rows).alias("row")).select(*[F.col(f"row.{name}").alias(name) for name in columns])
    return checked.orderBy("chain_id", "sequence")
