"""Mixing overlapping sources to target weights by min-cost flow.

Documents are first summed by membership pattern (the set of sources a document belongs to). A flow network
over these sums routes word capacity to source quotas: a pattern offers its words once free of cost, once more
at cost 1, and so on, so repetition is convex and comes last. Only then are documents chosen, by a seeded hash.
The network has one node per pattern and source and never sees a document.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm.frames import null_safe, shared_folder, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of the seeded hash per pattern; only the range that holds the quota is ordered row by row.
RANGES = 4096
#: Patterns beyond this number are an error; they are the one thing that the driver holds, and what is broadcast
#: (one row per pattern or source) cannot outgrow them.
MAX_PATTERNS = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: Sequence[float], share: float, most: float) -> dict[str | None, float]:
    """Shares of share * total by weight (sources by code point, null last, weights repeating), none above
    most times its source; what that leaves over is reshared by weight among the others."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free = share * sum(sizes.values()), list(order)
    targets: dict[str | None, float] = {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            targets |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            targets[s] = float(most * sizes[s])
        left -= sum(targets[s] for s in over)
        free = [s for s in free if s not in over]
    return targets


def route(patterns: dict[tuple, int], quotas: dict[str | None, int], most: int) -> dict[tuple, int]:
    """Words each pattern gives, of a maximum flow of least cost from patterns to the quotas of their sources.

    Costs lie on a pattern's successive repetitions only, so paths of least cost are found by opening one
    repetition after the other and augmenting to the full each time.
    """
    room = dict(quotas)
    spare = {p: 0 for p in patterns}
    flow: dict[tuple[tuple, str | None], int] = {}
    by_source: dict[str | None, list[tuple]] = {s: [] for s in quotas}
    for p in patterns:
        for s in p:
            by_source[s].append(p)
    for _ in range(most):
        for p, size in patterns.items():
            spare[p] += size
        while True:
            came: dict[tuple[str, object], tuple[str, object] | None] = {("p", p): None for p in patterns if spare[p] > 0}
            queue = deque(came)
            goal = None
            while queue and goal is None:
                kind, node = at = queue.popleft()
                if kind == "p":
                    ahead = [("s", s) for s in node]
                else:
                    if room[node] > 0:
                        goal = at
                        break
                    ahead = [("p", p) for p in by_source[node] if flow.get((p, node), 0) > 0]
                for nxt in ahead:
                    if nxt not in came:
                        came[nxt] = at
                        queue.append(nxt)
            if goal is None:
                break
            path = [goal]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            backward = [flow[path[i + 1][1], path[i][1]] for i in range(1, len(path) - 1, 2)]
            amount = min(spare[path[0][1]], room[goal[1]], *backward)
            for i in range(0, len(path) - 1):
                a, b = path[i], path[i + 1]
                if a[0] == "p":
                    flow[a[1], b[1]] = flow.get((a[1], b[1]), 0) + amount
                else:
                    flow[b[1], a[1]] -= amount
            spare[path[0][1]] -= amount
            room[goal[1]] -= amount
    given = {p: 0 for p in patterns}
    for (p, _), amount in flow.items():
        given[p] += amount
    return given


#: Exchanges tried per pattern after filling; each brings its words closer to the quota.
EXCHANGES = 64


def _filled(sizes: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each size a pattern takes more or less of, so that its words come near its quota.

    sizes has one row per size and whether such documents are chosen (more), with their number n and the gap that the
    choice leaves. The largest free documents that fit fill the gap first; then single documents are added, given back or
    exchanged as long as that brings the words closer. Last, one of the largest free documents is tried in place of several.
    """
    gap = int(sizes["gap"].iloc[0])
    held = [{int(s): int(n) for s, m, n in sizes[["size", "more", "n"]].itertuples(index=False) if m == side} for side in (0, 1)]
    change: dict[int, int] = {}

    def move(size: int, count: int) -> None:
        if size:
            held[0][size] = held[0].get(size, 0) - count
            held[1][size] = held[1].get(size, 0) + count
            change[size] = change.get(size, 0) + count

    for size in sorted(held[0], reverse=True):
        count = min(held[0][size], max(0, gap // size))
        if count:
            move(size, count)
            gap -= count * size
    for _ in range(EXCHANGES):
        free, taken = (np.array([0, *sorted(s for s, n in side.items() if n > 0)]) for side in held)
        at = np.searchsorted(free, gap + taken)
        near = np.concatenate([free[np.maximum(at - 1, 0)], free[np.minimum(at, len(free) - 1)]])
        back = np.concatenate([taken, taken])
        left = np.abs(gap - near + back)
        best = int(left.argmin())
        if left[best] >= abs(gap):
            break
        move(int(near[best]), 1)
        move(int(back[best]), -1)
        gap += int(back[best]) - int(near[best])
    best_swap, best_left = None, abs(gap)
    for size in sorted((s for s, n in held[0].items() if n > 0), reverse=True)[:EXCHANGES]:
        over, back = size - gap, []
        for other in sorted(held[1], reverse=True):
            count = min(held[1][other], max(0, over // other))
            if count:
                back.append((other, count))
                over -= count * other
        if abs(over) < best_left:
            best_swap, best_left = (size, back), abs(over)
    if best_swap:
        move(best_swap[0], 1)
        for other, count in best_swap[1]:
            move(other, -count)
    rows = [(sizes["pattern"].iloc[0], size, int(n < 0), abs(n)) for size, n in change.items() if n]
    return pd.DataFrame(rows, columns=["pattern", "size", "more", "moved"]).astype({"size": "int64", "more": "int32", "moved": "int64"})


def mix_sources(docs: DataFrame, sources: Column, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2,
                seed: int = 17) -> tuple[DataFrame, dict[str | None, int], dict[str | None, float]]:
    """How often each document enters the mix; with it the size and the target of every source.

    docs has doc_id and text; ``sources`` gives the array of sources of a row (a null entry is a source of its
    own; an empty or null array belongs nowhere and is not taken). The rows come back as doc_id, text_hash,
    pattern (JSON), size (words), copies and taken (copies * size). No document is taken more than ``most``
    times; a source's taken words meet its target up to the size of the last document that fits. Null, empty
    and blank texts have size 0 and no copies beyond those of their whole pattern. Repeated rows are alike and
    taken alike. The same seed gives the same mix. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    own = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    sized = stored(
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.to_json(own, {"ignoreNullFields": "false"}).alias("pattern"), n_words(F.col("text")).alias("size"))
        .withColumn("u", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash"), F.col("size")))
        .withColumn("range", F.pmod(F.shiftrightunsigned("u", 20), F.lit(RANGES)).cast("int")), f"{folder}/sized")

    patterns: dict[tuple, int] = {}
    for row in sized.groupBy("pattern").agg(F.sum("size").alias("size")).toLocalIterator():
        if len(patterns) == MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
        patterns[tuple(json.loads(row["pattern"]))] = row["size"]
    sizes: dict[str | None, int] = {}
    for pattern, size in patterns.items():
        for source in pattern:
            sizes[source] = sizes.get(source, 0) + size
    targets = source_targets(sizes, weights, share, most)
    given = route(patterns, {s: round(t) for s, t in targets.items()}, most)

    plan = [(json.dumps(list(p), ensure_ascii=False, separators=(",", ":")), given[p] // size if size else 0, given[p] % size if size else 0)
            for p, size in patterns.items()]
    wanted = spark.createDataFrame(plan, "pattern string, base int, rest long")

    sums = sized.groupBy("pattern", "range").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cut = (sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0))).join(wanted, "pattern")
           .select("pattern", "range", "base", "rest", "before", (F.col("before") + F.col("words")).alias("after")))
    ranged = sized.join(cut, ["pattern", "range"])
    inside = (F.col("before") < F.col("rest")) & (F.col("after") > F.col("rest"))
    simple = ranged.where(~inside).withColumn("more", (F.col("after") <= F.col("rest")).cast("int"))
    within = Window.partitionBy("pattern").orderBy("u").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    split = ranged.where(inside).withColumn("more", (F.col("before") + F.sum("size").over(within) <= F.col("rest")).cast("int"))
    columns = ["doc_id", "text_hash", "pattern", "size", "u", "base", "rest", "more"]
    chosen = stored(simple.select(columns).unionByName(split.select(columns)), f"{folder}/chosen")

    gaps = chosen.groupBy("pattern").agg((F.max("rest") - F.sum(F.col("more") * F.col("size"))).alias("gap"))
    kinds = chosen.where("size > 0").groupBy("pattern", "size", "more").agg(F.count("*").alias("n"))
    moved = kinds.join(F.broadcast(gaps), "pattern").groupBy("pattern").applyInPandas(_filled, "pattern string, size long, more int, moved long")
    alike = Window.partitionBy("pattern", "size", "more").orderBy("u").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = chosen.join(moved, ["pattern", "size", "more"], "left").withColumn("place", F.count("*").over(alike)).withColumn(
        "more", F.when(F.col("place") <= F.col("moved"), 1 - F.col("more")).otherwise(F.col("more")))
    copies = F.col("base") + F.col("more")
    rows = chosen.select("doc_id", "text_hash", "pattern", "size", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
    return rows, sizes, targets


def mix_by_source(docs: DataFrame, **settings: object) -> DataFrame:
    """mix_sources for rows of one source each (column source): doc_id, source, size, source_size, target, taken, copies."""
    rows, sizes, targets = mix_sources(docs, F.array(F.col("source").cast("string")), **settings)
    spark = docs.sparkSession
    facts = spark.createDataFrame([(s, sizes[s], targets[s]) for s in sizes], "source string, source_size long, target double")
    named = rows.withColumn("source", F.from_json("pattern", "array<string>")[0]).drop("pattern")
    return null_safe(named, F.broadcast(facts), ["source"]).select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "text_hash")
