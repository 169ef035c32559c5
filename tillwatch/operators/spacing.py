"""Greedy selection of events that keep a minimum distance from those selected before.

Contact limits and time-to-live deduplication are the same recurrence: per key, in time
order, an event is taken when it lies far enough behind the last one taken (and behind the
n-th last, for a cap of n per window). What is taken depends on what was taken before, so no
window frame expresses it.

Small keys fold a sorted array inside the JVM. A key with more rows than ``hot_rows`` is first
reduced, across the whole cluster, to the few rows that can possibly be taken: per time slot
only the first and last moment are kept, the recurrence runs over slots on intervals instead
of moments, and rows outside every interval are dropped. Slots get finer until the rest is
small. The bounds only ever widen, so the result is the same as folding all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.session import checkpointed

HOT_ROWS = 200_000
FIRST_SLOT_US = 10_000_000
REFINEMENT = 20

Rule = tuple[int, int]
"""(back, gap): at least ``gap`` microseconds behind the ``back``-th last selected event."""


def fold_spaced(rows: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """The recurrence on keys small enough for one array: ``rows`` is (keys, us, id)."""
    item = rows.select(F.struct("us", "id").alias("item")).schema["item"].dataType
    nothing = F.array().cast(T.ArrayType(item))

    def far_enough(kept: Column, x: Column) -> Column:
        condition = F.lit(True)
        for back, gap in rules:
            condition = condition & (
                (F.size(kept) < back) | (x["us"] - F.element_at(kept, -back)["us"] >= F.lit(gap))
            )
        return condition

    def step(kept: Column, x: Column) -> Column:
        return F.when(far_enough(kept, x), F.concat(kept, F.array(x))).otherwise(kept)

    ordered = F.array_sort(F.collect_list(F.struct("us", "id")))
    return (
        rows.groupBy(*keys).agg(ordered.alias("items"))
        .select(*keys, F.explode(F.aggregate("items", nothing, step)).alias("item"))
        .select(*keys, "item.us", "item.id")
    )


def possible_intervals(first: np.ndarray, last: np.ndarray, rules: Sequence[Rule]) -> list[tuple[int, int]]:
    """Disjoint intervals that contain every selected moment.

    ``first`` and ``last`` bound the events of each slot, in slot order. The next event at or
    after x lies in the first slot whose last event reaches x; knowing only the slot's ends
    gives a lower and an upper bound, and both grow with x, so intervals carry through.
    """
    lows: list[int] = []
    highs: list[int] = []
    end = int(last[-1])
    while True:
        low_from = max((lows[-back] + gap for back, gap in rules if len(lows) >= back), default=int(first[0]))
        high_from = max((highs[-back] + gap for back, gap in rules if len(highs) >= back), default=int(first[0]))
        at = int(np.searchsorted(last, low_from))
        if at == len(last):
            break
        lows.append(max(low_from, int(first[at])))
        at = int(np.searchsorted(last, high_from))
        if at == len(last):
            highs.append(end)
        else:
            highs.append(int(first[at]) if first[at] >= high_from else int(last[at]))
    merged: list[tuple[int, int]] = []
    for low, high in zip(lows, highs, strict=True):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    return merged


def prune_hot(rows: DataFrame, keys: Sequence[str], rules: Sequence[Rule], hot_rows: int) -> DataFrame:
    """Reduce hot keys to candidate rows, coarse slots first."""
    key_names = list(keys)
    schema = T.StructType(
        [rows.schema[key] for key in key_names]
        + [T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]
    )

    def intervals(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        found = possible_intervals(pdf["first_us"].to_numpy(), pdf["last_us"].to_numpy(), rules)
        out = pd.DataFrame(found, columns=["low", "high"])
        for key in reversed(key_names):
            out.insert(0, key, pdf[key].iloc[0])
        return out

    rows = rows.groupBy(*keys, "us").agg(F.min("id").alias("id"))
    width = FIRST_SLOT_US
    while True:
        slotted = rows.withColumn("slot", F.floor(F.col("us") / width).cast("long"))
        summary = slotted.groupBy(*keys, "slot").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
        spans = summary.groupBy(*keys).applyInPandas(intervals, schema).select(
            *keys, "low", "high",
            F.explode(
                F.sequence(F.floor(F.col("low") / width).cast("long"), F.floor(F.col("high") / width).cast("long"))
            ).alias("slot"),
        )
        condition = (slotted["slot"] == spans["slot"]) & slotted["us"].between(spans["low"], spans["high"])
        for key in keys:
            condition = condition & (slotted[key] == spans[key])
        rows = checkpointed(slotted.join(spans, condition, "left_semi").drop("slot"))
        largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if largest <= hot_rows or width == 1:
            return rows
        width = max(1, width // REFINEMENT)


def select_spaced(
    rows: DataFrame, keys: Sequence[str], rules: Sequence[Rule],
    sizes: DataFrame | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Selected ``(keys, us, id)`` of ``rows`` (keys, us, id), ties in ``us`` broken by ``id``.

    ``sizes`` (keys, count) is an upper bound of the rows per key, taken from a cheap scan when
    ``rows`` itself is expensive; it decides which keys are hot.
    """
    rules = [(back, gap) for back, gap in rules if gap > 0]
    if not rules:
        return rows.select(*keys, "us", "id")
    if not any(back == 1 for back, _ in rules):
        return fold_spaced(rows, keys, rules)
    counted = sizes if sizes is not None else rows.groupBy(*keys).count()
    hot = counted.filter(F.col("count") > hot_rows).select(*keys)
    if hot.isEmpty():
        return fold_spaced(rows, keys, rules)
    cold = fold_spaced(rows.join(hot, list(keys), "left_anti"), keys, rules)
    pruned = prune_hot(rows.join(hot, list(keys), "left_semi"), keys, rules, hot_rows)
    return cold.unionByName(fold_spaced(pruned, keys, rules))
