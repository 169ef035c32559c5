"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm.frames import BLANKS, ascii_lower, null_safe, shared_folder, shuffle_partitions, stored

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def text_lines(text: Column) -> Column:
    """Lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Sorted runs of (hash, owner) in levels, on shared storage.

    A run is a table bucketed and sorted by the 128-bit line hash, so joining a batch with it shuffles
    the batch alone and merges sorted files. ``add`` keeps of a batch the keys that no run holds and
    writes them as a run of level 0; as soon as a level has ``fanout`` runs they are compacted into one
    of the next level. A key lies in exactly one run, with the first batch's smallest document as owner.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 3) -> None:
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = shuffle_partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.all_tables: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, *KEY).write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", f"{self.folder}/{name}").saveAsTable(name))
        self.all_tables.append(name)
        return name

    def tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """batch: (doc_id, h1, h2), of documents after those of all earlier batches."""
        fresh = batch.groupBy(*KEY).agg(F.min("doc_id").alias("owner"))
        for name in self.tables():
            fresh = fresh.join(self.spark.table(name).hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._write(fresh))
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) >= self.fanout:
                self._compact(depth)

    def _compact(self, depth: int) -> None:
        if depth + 1 == len(self.levels):
            self.levels.append([])
        self.levels[depth + 1].append(self._write(self._union(self.levels[depth])))
        self.levels[depth] = []

    def _union(self, names: list[str]) -> DataFrame:
        whole = self.spark.table(names[0])
        for name in names[1:]:
            whole = whole.unionByName(self.spark.table(name))
        return whole

    def owners(self) -> DataFrame:
        return self._union(self.tables())

    def forget(self) -> None:
        """Take the runs out of the catalog; their files stay in the shared folder."""
        for name in self.all_tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Drop each line whose key also stands in a document with a smaller id.

    A key is the line without blanks at its ends, A-Z lower-cased; keys under ``min_chars`` code points
    never go. Documents enter in ``batches`` ranges of their id, each meeting the runs of those before it,
    so the smallest id that holds a key owns it whatever the number of batches.

    Returns the rows of docs with all their columns, ``text`` replaced by the lines kept (joined by a line
    feed) and ``__n_lines``, ``__n_dropped`` added. Null or empty texts are one empty line, which stays and
    gives an empty text. A null id counts as larger than any other. Repeated rows stay, each treated alike;
    rows that share an id are one document and never drop each other's lines. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    source = docs.withColumn("__t", F.xxhash64("text"))
    cuts = docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + F.when(F.col("doc_id").isNull() | (F.col("doc_id") > F.lit(cut)), 1).otherwise(0)
    exploded = source.select("doc_id", "__t", batch.alias("batch"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    keyed = exploded.select("doc_id", "__t", "batch", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    keys = stored(
        keyed.select("doc_id", "__t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(41), "key").alias("h2"), "batch"),
        f"{folder}/keys", "batch")
    runs = LineRuns(spark, folder, fanout)
    for number in range(len(cuts) + 1):
        runs.add(keys.where(F.col("batch") == number).select("doc_id", *KEY))
    owned = keys.join(runs.owners(), KEY).where(~F.col("owner").eqNullSafe(F.col("doc_id")))
    drops = stored(owned.groupBy("doc_id", "__t").agg(F.collect_set("pos").alias("__drop")), f"{folder}/drops")
    runs.forget()

    rows = source.withColumn("__lines", text_lines(F.col("text"))).drop("text")
    joined = null_safe(rows, drops.hint("shuffle_hash"), ["doc_id", "__t"], "left")
    gone = F.coalesce("__drop", F.array().cast("array<int>"))
    n_lines = F.size("__lines")
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), gone)
    text = F.when(F.size(gone) == 0, F.array_join("__lines", "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.col("__lines")[i]), "\n"))
    result = joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        n_lines.cast("long").alias("__n_lines"), F.size(gone).cast("long").alias("__n_dropped"))
    return result
