"""Connected components of a table of links, by alternating stars in logarithmically many rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.session import checkpointed

#: Links per partition of an intermediate table; each round knows the number of links of the one before.
LINKS_PER_PARTITION = 500_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step: every node's (large: larger, else: smaller) neighbours are tied to its least one.

    Only minima per node and an equi join move; no neighbourhood is gathered, so a node with very many
    links is an ordinary skewed join key.
    """
    if large:
        seen = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        tied = seen.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
    else:
        least = links.groupBy("b").agg(F.min("a").alias("m"))
        joined = links.join(least, "b")
        tied = joined.select("m", F.col("a").alias("x")).unionByName(joined.select("m", F.col("b").alias("x")))
        tied = tied.select(F.col("m").alias("a"), F.col("x").alias("b"))
    return tied.where("a < b").distinct()


def connected_components(links: DataFrame, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """links (a, b) of any order -> (node, component) for every node with a link; component is its smallest node.

    Links with a null end or both ends equal tie nothing. keep writes an intermediate table to shared
    storage and reads it back.
    """
    current = keep(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                   .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or state[0] == 0:
            break
        mark = state
        parts = 1 + state[0] // LINKS_PER_PARTITION
        current = keep(_star(_star(current, True), False).coalesce(parts))
    roots = current.groupBy("b").agg(F.min("a").alias("component"))
    ends = roots.select(F.col("b").alias("node"), "component")
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())
