"""Burst detectors: functions that add ``is_burst`` and ``score`` to a series.

Each reads a series from ``bucket_counts`` or ``dense_series`` and only looks backwards. An
empty bucket can never be a burst (thresholds are not negative) and never raises a peak score,
so detecting on the sparse series gives the same bursts and incidents as on the dense one: the
trailing frame is a RANGE over bucket positions, and the number of buckets in it follows from
the distance to the grid origin.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.functions.poisson import poisson_tail
from tillwatch.functions.timegrid import ENTITY


def fixed_threshold(series: DataFrame, keys: Sequence[str] = ENTITY, threshold: int = K.FIXED_THRESHOLD) -> DataFrame:
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    return series.withColumn("score", F.col("n").cast("double")).withColumn("is_burst", F.col("n") > threshold)


def _history(keys: Sequence[str], window: int) -> tuple[Column, Column, Column]:
    """Length, sum and sum of squares of the trailing buckets, current one excluded."""
    frame = W.partitionBy(*keys).orderBy("idx").rangeBetween(-window, -1)
    length = F.least(F.col("idx") - F.col("origin"), F.lit(window))
    total = F.coalesce(F.sum("n").over(frame), F.lit(0)).cast("double")
    n = F.col("n").cast("double")
    squares = F.coalesce(F.sum(n * n).over(frame), F.lit(0.0))
    return length, total, squares


def _scored_against(mean: Column, sd: Column, warm: Column, z_threshold: float) -> tuple[Column, Column]:
    flat = sd < K.ZERO_SD
    gap = F.col("n") - mean
    score = F.when(~warm, 0.0).when(flat, gap).otherwise(gap / sd)
    return score, warm & F.when(flat, gap > 0).otherwise(gap / sd > z_threshold)


def rolling_zscore(
    series: DataFrame, keys: Sequence[str] = ENTITY, window: int = K.HISTORY_BUCKETS,
    min_periods: int = K.MIN_HISTORY, z_threshold: float = K.Z_THRESHOLD,
) -> DataFrame:
    length, total, squares = _history(keys, window)
    stats = series.select("*", length.alias("_len"), total.alias("_sum"), squares.alias("_sq"))
    mean = F.col("_sum") / F.col("_len")
    variance = F.greatest(F.lit(0.0), F.col("_sq") / F.col("_len") - mean * mean)
    warm = F.col("_len") >= min_periods
    with_moments = stats.select(
        "*", F.when(warm, mean).alias("_mean"), F.when(warm, F.sqrt(variance)).alias("_sd"), warm.alias("_warm")
    )
    score, burst = _scored_against(F.col("_mean"), F.col("_sd"), F.col("_warm"), z_threshold)
    return with_moments.select(*series.columns, score.alias("score"), burst.alias("is_burst"))


def poisson_surprise(
    series: DataFrame, keys: Sequence[str] = ENTITY, window: int = K.HISTORY_BUCKETS,
    min_periods: int = K.MIN_HISTORY, p_threshold: float = K.P_THRESHOLD,
) -> DataFrame:
    length, total, _ = _history(keys, window)
    rates = series.select("*", length.alias("_len"), ((total + 1.0) / (length + 1.0)).alias("_rate"))
    tail = F.when(F.col("_len") >= min_periods, poisson_tail(F.col("n"), F.col("_rate")))
    scored = rates.select(*series.columns, tail.alias("_p"))
    return scored.select(
        *series.columns,
        F.when(F.col("_p").isNull(), 0.0).otherwise(-F.log(F.greatest(F.col("_p"), F.lit(1e-300)))).alias("score"),
        F.coalesce(F.col("_p") < p_threshold, F.lit(False)).alias("is_burst"),
    )


def ewma_step(mean: float, variance: float, count: float, quiet: int, alpha: float) -> tuple[float, float, float, float]:
    """Decay over ``quiet`` empty buckets, then fold one count in.

    Returns the moments the count is scored against, followed by the updated ones. Empty
    buckets have a closed form, so a long silence costs one step.
    """
    if quiet > 0:
        keep = (1.0 - alpha) ** quiet
        variance = keep * (variance + mean * mean * (1.0 - keep))
        mean = mean * keep
    gap = count - mean
    return mean, variance, mean + alpha * gap, (1.0 - alpha) * (variance + alpha * gap * gap)


#: Buckets of a block of the scan.
BLOCK_BUCKETS = 64


def _moments(mean: Column, variance: Column) -> list[Column]:
    return [mean.alias("mean"), variance.alias("variance")]


def _mixture(share: Column, a: Column, b_mean: Column, b_variance: Column) -> list[Column]:
    """Mean and variance of ``share`` of a and the rest of b."""
    gap = a["mean"] - b_mean
    return _moments(share * a["mean"] + (1 - share) * b_mean, share * a["variance"] + (1 - share) * b_variance + share * (1 - share) * gap * gap)


def _stretch(first: Column, keep: Column, mean: Column, variance: Column) -> Column:
    """Two stretches of buckets as one: what a weight before them keeps, and the moments of the buckets inside."""
    kept = first["kept"] * keep
    share = F.when(kept < 1, (1 - first["kept"]) * keep / (1 - kept)).otherwise(F.lit(0.0))
    return F.struct(kept.alias("kept"), *_mixture(share, first, mean, variance))


def ewma_zscore(
    series: DataFrame, keys: Sequence[str] = ENTITY, alpha: float = K.EWMA_ALPHA,
    min_periods: int = K.MIN_HISTORY, z_threshold: float = K.Z_THRESHOLD, block: int = BLOCK_BUCKETS,
) -> DataFrame:
    """Exponentially weighted baseline as an associative scan in SQL.

    Exponential moments are those of a mixture in which the bucket m places back weighs alpha (1 - alpha)^m, empty buckets
    being points at zero. Mixtures compose: a stretch of buckets is (weight it keeps of what was before, mean, variance), and
    two stretches make one. So blocks of ``block`` buckets are folded each on its own, a window over the block rows of
    an entity gives the moments before each block, and a second fold inside the block those before each
    bucket. An entity with any share of all rows spreads over the tasks by block. Blocks so far back that their weight
    is below the smallest double are left out of the window.
    """
    keep, zero = 1.0 - alpha, F.lit(0.0)
    others = [c for c in series.columns if c not in keys]
    number = F.call_function("div", F.col("idx") - F.pmod(F.col("idx"), F.lit(block)), F.lit(block))
    blocks = series.withColumn("_block", number).groupBy(*keys, "_block").agg(
        F.sort_array(F.collect_list(F.struct(F.col("idx").alias("_at"), F.struct(*others).alias("row")))).alias("_rows"))
    start = F.col("_block") * block

    def passed(state: Column, row: Column) -> Column:
        """A stretch that ends before bucket ``at``, with the quiet buckets up to the row and the row's own."""
        quiet = _stretch(state["of"], F.pow(F.lit(keep), row["_at"] - state["at"]), zero, zero)
        return F.struct((row["_at"] + 1).alias("at"), _stretch(quiet, F.lit(keep), row["row"]["n"].cast("double"), zero).alias("of"))

    nothing = F.struct(F.lit(1.0).alias("kept"), *_moments(zero, zero))
    inside = F.aggregate("_rows", F.struct(start.alias("at"), nothing.alias("of")), passed)
    whole = blocks.select(*keys, "_block", inside.alias("_inside")).select(
        *keys, "_block", _stretch(F.col("_inside.of"), F.pow(F.lit(keep), start + block - F.col("_inside.at")), zero, zero).alias("of"))
    reach = 1 if keep == 0 else 1 + int(np.ceil(np.log(np.finfo(float).tiny) / np.log(keep) / block))
    earlier = W.partitionBy(*keys).orderBy("_block").rangeBetween(-reach, -1)
    behind = whole.select(*keys, "_block", F.collect_list(F.struct("_block", "of")).over(earlier).alias("_behind"))

    def after(state: Column, one: Column) -> Column:
        """Moments at the end of a block, from those at the end of an earlier one."""
        quiet = F.struct(*_mixture(F.pow(F.lit(keep), (one["_block"] - state["block"]) * block), state["of"], zero, zero))
        return F.struct((one["_block"] + 1).alias("block"), F.struct(*_mixture(one["of"]["kept"], quiet, one["of"]["mean"], one["of"]["variance"])).alias("of"))

    at_zero = F.struct(*_moments(zero, zero))
    came = F.aggregate("_behind", F.struct(F.coalesce(F.get("_behind", F.lit(0))["_block"], F.col("_block")).alias("block"), at_zero.alias("of")), after)
    before = behind.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_number"), came.alias("_came")).withColumn(
        "_state", F.struct(*_mixture(F.pow(F.lit(keep), (F.col("_number") - F.col("_came.block")) * block), F.col("_came.of"), zero, zero)))

    def scored(state: Column, row: Column) -> Column:
        """Moments each row is scored against, gathered; then the row's count."""
        against = F.struct(*_mixture(F.pow(F.lit(keep), row["_at"] - state["at"]), state["of"], zero, zero))
        now = F.struct(*_mixture(F.lit(keep), against, row["row"]["n"].cast("double"), zero))
        return F.struct((row["_at"] + 1).alias("at"), now.alias("of"), F.concat(state["out"], F.array(against)).alias("out"))

    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_block") == F.col("_number")]
    none = F.expr("CAST(array() AS array<struct<mean: double, variance: double>>)")
    walked = blocks.join(before, same).select(
        *keys, "_rows", F.aggregate("_rows", F.struct(start.alias("at"), F.col("_state").alias("of"), none.alias("out")), scored)["out"].alias("_out"))
    rows = walked.select(*keys, F.explode(F.zip_with("_rows", "_out", lambda r, s: F.struct(r["row"].alias("row"), s.alias("base")))).alias("x"))
    flat = rows.select(*keys, "x.row.*", F.col("x.base.mean").alias("_mean"), F.sqrt("x.base.variance").alias("_sd"))
    score, burst = _scored_against(F.col("_mean"), F.col("_sd"), F.col("idx") - F.col("origin") >= min_periods, z_threshold)
    return flat.select(*series.columns, score.alias("score"), burst.alias("is_burst"))


DETECTORS = {
    "fixed_threshold": fixed_threshold,
    "rolling_zscore": rolling_zscore,
    "poisson_surprise": poisson_surprise,
    "ewma_zscore": ewma_zscore,
}
