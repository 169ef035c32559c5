"""Interval joins on multi-level time bins, and the nearest interval by a sorted sweep.

An interval's home is the finest level whose bins are at least as long as it, so it lies in one or two
bins there, however long it is. Two intervals that overlap share a bin of the coarser of their two
homes; a short one is therefore also posted in the bins of the levels above its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch import constants as K
from tillwatch.functions.timegrid import micros

#: Widths of the levels in microseconds: one hour, then 16 times the one below; the last is 1,900 years.
LEVELS = [3_600_000_000 * 16**k for k in range(7)]


def _whole(value: Column, width: int) -> Column:
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def home_level(start_us: Column, end_us: Column) -> Column:
    """Finest level whose bins are no shorter than the interval."""
    length, level = end_us - start_us, F.lit(len(LEVELS) - 1)
    for k in reversed(range(len(LEVELS) - 1)):
        level = F.when(length <= LEVELS[k], k).otherwise(level)
    return level


def _levels_with_bins(start_us: Column, end_us: Column, levels: Sequence[int]) -> Column:
    """(level, first, bin) for each bin the half-open interval touches on the given levels."""
    def bins(k: int) -> Column:
        first, last = _whole(start_us, LEVELS[k]), _whole(F.greatest(end_us - 1, start_us), LEVELS[k])
        return F.transform(
            F.sequence(first, last), lambda b: F.struct(F.lit(k).alias("level"), first.alias("first"), b.alias("bin")))

    return F.concat(*[F.when(home_level(start_us, end_us) <= k, bins(k)).otherwise(F.array()) for k in levels])


def at_home(start_us: Column, end_us: Column) -> Column:
    """(level, first, bin) of an interval on its own level: one or two entries."""
    everywhere, home = _levels_with_bins(start_us, end_us, range(len(LEVELS))), home_level(start_us, end_us)
    return F.filter(everywhere, lambda x: x["level"] == home)


def at_all_levels(start_us: Column, end_us: Column) -> Column:
    """(level, first, bin) of an interval on its own level and those above."""
    return _levels_with_bins(start_us, end_us, range(len(LEVELS)))


def _posted(df: DataFrame, prefix: str, start: Column, end: Column) -> DataFrame:
    start_us, end_us = micros(start), micros(end)
    return df.select(
        *[F.col(name).alias(prefix + name) for name in df.columns],
        start.alias(f"{prefix}_from"), end.alias(f"{prefix}_to"), home_level(start_us, end_us).alias(f"{prefix}_home"),
        F.explode(at_all_levels(start_us, end_us)).alias(f"{prefix}_at"),
    )


def overlap_join(
    left: DataFrame, right: DataFrame, same: Sequence[str], how: str = "inner",
    left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end"),
    condition: Column | None = None,
) -> DataFrame:
    """Pairs of half-open intervals that overlap and agree (NULL-safe) on ``same``.

    Columns come back as ``l_*`` and ``r_*``. A pair is reported only on the coarser of its two home
    levels and there in the later of its two first bins, hence exactly once. ``how`` is ``inner`` or
    ``left_semi``; for a left join, join the distinct pairs back on the left key.
    """
    a = _posted(left, "l_", F.col(left_span[0]), F.col(left_span[1]))
    b = _posted(right, "r_", F.col(right_span[0]), F.col(right_span[1]))
    on = (
        (F.col("l__at.level") == F.col("r__at.level")) & (F.col("l__at.bin") == F.col("r__at.bin"))
        & (F.col("l__at.level") == F.greatest("l__home", "r__home"))
        & (F.col("l__at.bin") == F.greatest("l__at.first", "r__at.first"))
        & (F.col("l__from") < F.col("r__to")) & (F.col("r__from") < F.col("l__to"))
    )
    for name in same:
        on = on & F.col(f"l_{name}").eqNullSafe(F.col(f"r_{name}"))
    if condition is not None:
        on = on & condition
    joined = a.join(b, on, how)
    helpers = [f"{p}_{h}" for p in ("l_", "r_") for h in ("from", "to", "home", "at")]
    return joined.drop(*helpers)


def confirmed_incidents(detected: DataFrame, windows: DataFrame, same: Sequence[str] = ("method", "bank")) -> DataFrame:
    """Incidents that overlap any true window of their scope, once each."""
    pairs = overlap_join(detected, windows, same, "left_semi")
    return pairs.select(*[F.col(f"l_{name}").alias(name) for name in detected.columns]).distinct()


def fragments_per_window(
    windows: DataFrame, detected: DataFrame, same: Sequence[str] = ("method", "bank"),
    window_key: Sequence[str] = ("window_id",),
) -> DataFrame:
    """Number of incidents that overlap each window, zero included."""
    pairs = overlap_join(windows, detected, same)
    counts = pairs.groupBy(*[F.col(f"l_{k}").alias(k) for k in window_key]).agg(
        F.count("*").alias("fragments"), F.min("r_start").alias("first_detected")
    )
    return windows.join(counts, list(window_key), "left").withColumn("fragments", F.coalesce("fragments", F.lit(0)))


def _latest_running(marks: DataFrame, group: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Per asking row the running interval that began last, in one pass over each group sorted by time.

    ``marks`` has the group columns, ``at``, ``until`` (null for asking rows), ``ordinal``, ``id`` and the
    ``kept`` columns. Intervals wait on a stack in order of their begin; one that is over when it is on top
    is over for all later rows, so it goes for good and what stays on top is the answer. A task holds the
    intervals that contain one another at one moment, never a group.
    """
    ordered = marks.repartition(*group).sortWithinPartitions(*group, "at", F.col("until").isNull(), F.col("ordinal").desc())
    out = T.StructType([*[ordered.schema[name] for name in kept], T.StructField("begun", T.LongType()), ordered.schema["ordinal"], ordered.schema["id"]])
    names = [field.name for field in out.fields]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running = None, []
        for batch in batches:
            found, rows = [], []
            columns = [batch.column(c).to_pylist() for c in ("at", "until", "ordinal", "id")]
            keys = zip(*[batch.column(c).to_pylist() for c in group], strict=True)
            for n, (key, at, until, ordinal, name) in enumerate(zip(keys, *columns, strict=True)):
                if key != current:
                    current, running = key, []
                if until is not None:
                    running.append((until, at, ordinal, name))
                    continue
                while running and running[-1][0] <= at:
                    running.pop()
                if running:
                    rows.append(n)
                    found.append(running[-1][1:])
            asked = batch.select(kept).take(pa.array(rows, pa.int64()))
            answer = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), batch.schema.field("ordinal").type, batch.schema.field("id").type))]
            yield pa.RecordBatch.from_arrays([*asked.columns, *answer], names)

    return ordered.mapInArrow(sweep, out)


def correlate_downtimes(detected: DataFrame, downtimes: DataFrame, incident_key: Sequence[str]) -> DataFrame:
    """Nearest declared downtime per incident: same method, overlapping, banks equal where both
    are known; an open downtime runs for ten years. Ties go to the earlier declared position.

    ``downtimes`` carries (id, method, bank, begin, end, ordinal). ``lead_minutes`` is negative
    when the incident was detected before the downtime began. A downtime that ends before it begins
    counts as the moment of its begin.

    The nearest is either the downtime that began last among those running at the incident's start or the
    one that begins first inside it. For the former a downtime stands in the one or two bins of its home
    level and the start asks one bin of every level; for the latter the incident stands at home and the
    begins ask. No overlapping pair is built but these two, so nested or endless downtimes cost no more.
    """
    begin_us = micros(F.col("begin"))
    until = F.coalesce("end", F.col("begin") + F.expr(f"INTERVAL {K.OPEN_ENDED_DAYS} DAYS"))
    named = F.col("bank").isNotNull()
    by_bank = F.when(F.col("scope") == "own", F.col("bank")).alias("_bank")
    spans = downtimes.where("begin IS NOT NULL").select(
        "id", "method", "bank", "ordinal", begin_us.alias("begun"), F.greatest(micros(until), begin_us).alias("until"),
        F.explode(F.when(named, F.array(F.lit("own"), F.lit("any"))).otherwise(F.array(F.lit("none"), F.lit("any")))).alias("scope"),
    ).select("id", "method", "scope", by_bank, "ordinal", "begun", "until")
    keys = [f"k_{k}" for k in incident_key]
    asked = detected.select(
        *[F.col(k).alias(f"k_{k}") for k in incident_key], "method", "bank",
        micros(F.col("start")).alias("from_us"), micros(F.col("end")).alias("to_us"),
        F.explode(F.when(named, F.array(F.lit("own"), F.lit("none"))).otherwise(F.array(F.lit("any")))).alias("scope"),
    ).select(*keys, "method", "scope", by_bank, "from_us", "to_us")
    scope, group = ["method", "scope", "_bank"], ["method", "scope", "_bank", "level", "bin"]
    kept = [*keys, "from_us"]

    def at(rows: DataFrame, moment: str, *columns: str) -> DataFrame:
        """Rows that ask at one moment: one bin of each level."""
        bins = F.explode(at_all_levels(F.col(moment), F.col(moment) + 1)).alias("p")
        return rows.select(*scope, *columns, F.col(moment).alias("at"), bins).select("*", "p.level", "p.bin").drop("p")

    def home(rows: DataFrame, start: str, end: str, *columns: str) -> DataFrame:
        bins = F.explode(at_home(F.col(start), F.col(end))).alias("p")
        return rows.select(*scope, *columns, F.col(start).alias("at"), F.col(end), bins).select("*", "p.level", "p.bin").drop("p")

    running = home(spans, "begun", "until", "ordinal", "id").unionByName(at(asked, "from_us", *kept), allowMissingColumns=True)
    before = _latest_running(running, group, kept)

    begins = at(spans.withColumn("begin", F.struct("begun", "ordinal", "id")), "begun", "begin")
    waiting = home(asked, "from_us", "to_us", *kept)
    later_first = W.partitionBy(*group).orderBy(F.col("at").desc(), F.col("begin").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    after = begins.unionByName(waiting, allowMissingColumns=True).select(
        *kept, "to_us", F.min("begin").over(later_first).alias("next")).where("to_us IS NOT NULL AND next.begun < to_us")

    candidates = before.unionByName(after.select(*kept, "next.begun", "next.ordinal", "next.id"))
    distance = F.abs(F.col("begun") - F.col("from_us"))
    nearest = candidates.groupBy(*keys).agg(F.min_by(F.struct("id", "begun"), F.struct(distance, "ordinal")).alias("match"))
    on = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in incident_key]
    return detected.join(nearest, on, "left").select(
        *detected.columns, F.col("match.id").alias("downtime_id"),
        ((micros(F.col("start")) - F.col("match.begun")) / 60_000_000).alias("lead_minutes"),
    )
