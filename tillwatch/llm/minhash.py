"""Near duplicates by a signature-coordinate inverted join.

Each distinct shingle set gets ``COORDINATES`` MinHash coordinates. A set is posted under its
(coordinate, value) pairs; two sets are a candidate pair when at least ``MATCHES`` coordinates agree.
Such a pair must share a posting even if every set leaves out its ``MATCHES - 1`` most frequent ones, so
those are skipped (prefix), which takes hot passages out of the lists; the other coordinates are looked up
for the candidates only (skip). At similarity 0.75 the share of links lost is P(Bin(40, 0.75) < 17) < 1e-5.

Copies of one set are one node. A list's members are first compared with two hubs of the list; sets tied by agreeing
with hubs form a crowd. Lists that hold members of several crowds are compared by signature inside tasks, those outside
the list's largest crowd against all, in blocks; a task returns only what ties crowds together, never pairs. In
each crowd so merged the strays (all but its largest component of confirmed links) are held against the whole crowd, on
full sets, again in blocks inside tasks that return only links that tie components. Near copies of one text, or texts
around one passage, therefore never become pairs, and no link between components is missed. Every link is confirmed
on the full sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.frames import shared_folder, shuffle_partitions, stored
from tillwatch.llm.hashing import mixed, sequences, signed, text_blocks, words_of
from tillwatch.operators.components import connected_components

COORDINATES, MATCHES = 40, 17
WIDTH = 5
#: Bits of the filter of wanted ids; fixed, so its broadcast has one size whatever the data.
FILTER_BITS = 1 << 22
#: Sets in a block of a crowd.
CROWD_BLOCK = 800


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, all shingle hashes of a block's texts in order, where each text's begin)."""
    for low, high, data, offsets in text_blocks(texts):
        words, begins = words_of(data, offsets, fold=True)
        counts = np.diff(begins)
        grams = sequences(words, width)
        parts = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
        ends = np.cumsum(parts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        starts = ends - parts
        full = counts >= width
        take = np.repeat(begins[:-1][full] - starts[full], parts[full]) if full.any() else np.zeros(0, np.int64)
        to = np.flatnonzero(np.repeat(full, parts))
        out[to] = grams[take + to]
        for row in np.flatnonzero((counts > 0) & ~full):
            out[starts[row]] = sequences(words[begins[row] : begins[row + 1]], int(counts[row]))[0]
        yield low, out, np.append(starts, ends[-1] if len(ends) else 0)


def _features(batches: Iterator[pa.RecordBatch], coordinates: int) -> Iterator[pa.RecordBatch]:
    multipliers = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        n = batch.num_rows
        sizes, s1, s2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        signatures: list[bytes | None] = [None] * n
        for low, grams, begins in shingle_sets(batch.column("text")):
            filled = np.flatnonzero(np.diff(begins))
            if not len(filled):
                continue
            least = np.empty((len(filled), coordinates), np.uint32)
            for k in range(coordinates):
                least[:, k] = np.minimum.reduceat((grams * multipliers[k]) >> np.uint64(32), begins[filled])
            for at, row in enumerate(filled):
                own = np.unique(grams[begins[row] : begins[row + 1]])
                sizes[low + row] = len(own)
                s1[low + row] = own.sum()
                s2[low + row] = mixed(own + np.uint64(0x51ED270B)).sum()
                signatures[low + row] = least[at].tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), signed(s1), signed(s2), pa.array(signatures, pa.binary())],
            ["doc_id", "n_shingles", "s1", "s2", "signature"])


def set_features(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, number of distinct shingles, 128-bit hash of the set, signature (null for an empty set)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _features(batches, coordinates),
        "doc_id long, n_shingles long, s1 long, s2 long, signature binary")


def _postings(batches: Iterator[pa.RecordBatch], coordinates: int) -> Iterator[pa.RecordBatch]:
    lanes = np.arange(coordinates, dtype=np.uint64) << np.uint64(32)
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            part = batch.slice(low, 2000)
            values = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, coordinates)
            ids = np.repeat(part.column("doc").to_numpy(zero_copy_only=False), coordinates)
            yield pa.RecordBatch.from_arrays([signed(mixed(values + lanes).ravel()), pa.array(ids)], ["token", "doc"])


def _agreeing(batches: Iterator[pa.RecordBatch], matches: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32) for c in ("sa", "sb"))
        if batch.num_rows:
            same = (left == right).reshape(batch.num_rows, -1).sum(1) >= matches
            yield batch.select(["a", "b"]).filter(pa.array(same))


def _packed(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        slot = mixed(ids.view(np.uint64)) % np.uint64(FILTER_BITS)
        hit = (wanted[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        part = batch.filter(pa.array(hit))
        packed = [zlib.compress(x.as_py().encode(), 1) for x in part.column("text")]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary())], ["doc", "packed"])


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        known: dict[int, np.ndarray] = {}
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            ids = [part.column(c).to_pylist() for c in ("a", "b")]
            fresh = {}
            for side, column in zip(ids, ("pa", "pb")):
                for doc, packed in zip(side, part.column(column)):
                    if doc not in known and doc not in fresh:
                        fresh[doc] = zlib.decompress(packed.as_py()).decode()
            known = {doc: known[doc] for doc in {*ids[0], *ids[1]} if doc in known}
            names = list(fresh)
            for first, grams, begins in shingle_sets(pa.array(list(fresh.values()), pa.string())):
                for row in range(len(begins) - 1):
                    known[names[first + row]] = np.unique(grams[begins[row] : begins[row + 1]])
            for row, (a, b) in enumerate(zip(*ids)):
                common = len(np.intersect1d(known[a], known[b], assume_unique=True))
                keep[low + row] = common > 0 and 100 * common >= percent * (len(known[a]) + len(known[b]) - common)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _parts(rows: str, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / size)).cast("int")


def _upto(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


class _Links:
    """Candidate pairs to confirmed links: coordinates first, then the full sets."""

    def __init__(self, docs: DataFrame, signatures: DataFrame, folder: str, matches: int, percent: int) -> None:
        self.docs, self.signatures, self.folder = docs, signatures, folder
        self.matches, self.percent = matches, percent

    def agreeing(self, pairs: DataFrame, name: str) -> DataFrame:
        s = self.signatures
        both = (pairs.join(s.select(F.col("doc").alias("a"), F.col("signature").alias("sa")), "a")
                .join(s.select(F.col("doc").alias("b"), F.col("signature").alias("sb")), "b"))
        matches = self.matches
        return stored(both.mapInArrow(lambda x: _agreeing(x, matches), "a long, b long"), f"{self.folder}/agree-{name}")

    def texts(self, ids: DataFrame) -> DataFrame:
        """doc, packed text of the documents in ids (and a few more), found through a filter of fixed size."""
        spark = ids.sparkSession
        slots = ids.mapInArrow(_slots, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        wanted = np.zeros(FILTER_BITS // 64, np.int64)
        for row in slots.toLocalIterator():
            wanted[row.word] = row.bits
        shared = spark.sparkContext.broadcast(wanted.view(np.uint64))
        return (self.docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
                .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                .mapInArrow(lambda x: _packed(x, shared.value), "doc long, packed binary"))

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        texts = self.texts(pairs.select(F.explode(F.array("a", "b")).alias("doc")))
        met = (pairs.join(texts.select(F.col("doc").alias("a"), F.col("packed").alias("pa")), "a")
               .join(texts.select(F.col("doc").alias("b"), F.col("packed").alias("pb")), "b"))
        percent = self.percent
        return stored(met.mapInArrow(lambda x: _confirmed(x, percent), "a long, b long"), f"{self.folder}/links-{name}")

    def merging(self, lists: DataFrame, block: int) -> DataFrame:
        """lists (token, doc, hub): pairs of hubs that tie all hubs of a list whose members agree."""
        per_hub = lists.groupBy("token", "hub").agg(F.count("*").alias("n"))
        sizes = per_hub.groupBy("token").agg(
            F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("strays"), F.max_by("hub", F.struct("n", "hub")).alias("head"))
        dealt = lists.join(sizes.select("token", "head", _parts("all", block).alias("blocks"), _parts("strays", block).alias("chunks")), "token")
        ready = dealt.join(self.signatures, "doc")
        slot = F.xxhash64(F.lit(4), "doc")
        data = ready.select("token", "hub", "signature", F.pmod(slot, F.col("blocks")).cast("int").alias("block"), _upto("chunks").alias("chunk"), F.lit(False).alias("asks"))
        asks = ready.where("hub <> head").select("token", "hub", "signature", _upto("blocks").alias("block"), F.pmod(slot, F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("asks"))
        group, matches = ["token", "block", "chunk"], self.matches
        tasks = data.unionByName(asks).repartition(shuffle_partitions(lists.sparkSession), *group).sortWithinPartitions(*group)
        return stored(tasks.mapInArrow(lambda x: _hubs_met(x, matches), "a long, b long").distinct(), f"{self.folder}/merging")

    def crowded(self, members: DataFrame, block: int) -> DataFrame:
        """members (doc, label, hub): links between members of one hub whose labels differ, enough to tie them."""
        sizes = members.groupBy("hub").agg(F.count("*").alias("n"), F.count_if("stray").alias("strays")).where("strays > 0")
        dealt = members.join(sizes.select("hub", _parts("n", block).alias("blocks"), _parts("strays", block).alias("chunks")), "hub")
        ready = dealt.join(self.texts(dealt.select("doc")), "doc")
        slot = F.xxhash64(F.lit(3), "doc")
        data = ready.select("doc", "label", "packed", "hub", F.pmod(slot, F.col("blocks")).cast("int").alias("block"), _upto("chunks").alias("chunk"), F.lit(False).alias("asks"))
        asks = ready.where("stray").select("doc", "label", "packed", "hub", _upto("blocks").alias("block"), F.pmod(slot, F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("asks"))
        percent = self.percent
        tasks = data.unionByName(asks).repartition(shuffle_partitions(members.sparkSession), "hub", "block", "chunk")
        met = tasks.groupBy("hub", "block", "chunk").applyInPandas(lambda x: _tied(x, percent), "a long, b long")
        return stored(met, f"{self.folder}/links-crowds")


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Rows of each group of a partition sorted by columns; at most one group and one batch are held."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        turns = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        for low, high in zip([0, *turns], [*turns, batch.num_rows]):
            key = tuple(k[low] for k in keys)
            if held and key != current:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _hubs_met(batches: Iterator[pa.RecordBatch], matches: int) -> Iterator[pa.RecordBatch]:
    """Per group the pairs of hubs that tie all those with agreeing members on both sides."""
    for rows in _groups(batches, ["token", "block", "chunk"]):
        asking = rows.column("asks").to_numpy(zero_copy_only=False)
        if asking.all() or not asking.any():
            continue
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(len(asking), -1)
        hub = rows.column("hub").to_numpy(zero_copy_only=False)
        own, other = hub[asking].copy(), hub[~asking].copy()
        mine, theirs = signature[asking], np.ascontiguousarray(signature[~asking].T)
        left, right = [], []
        for i in range(len(own)):
            if (other == own[i]).all():
                continue
            agree = (theirs == mine[i][:, None]).sum(0) >= matches
            while (apart := np.flatnonzero(agree & (other != own[i]))).size:
                gone = other[apart[0]]
                left.append(own[i])
                right.append(gone)
                other[other == gone] = own[i]
                own[own == gone] = own[i]
        if left:
            ends = np.array([left, right], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(0)), pa.array(ends.max(0))], ["a", "b"])


def _sets_of(packed: pd.Series) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for low in range(0, len(packed), 256):
        texts = pa.array([zlib.decompress(x).decode() for x in packed.iloc[low : low + 256]], pa.string())
        for _, grams, begins in shingle_sets(texts):
            out += [np.unique(grams[begins[r] : begins[r + 1]]) for r in range(len(begins) - 1)]
    return out


def _tied(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Each asking set against each set of the block by merged postings; a link is returned if it ties two labels."""
    asks, data = frame[frame["asks"]], frame[~frame["asks"]]
    found: list[tuple[int, int]] = []
    if len(asks) and len(data):
        own, names, labels = _sets_of(asks["packed"]), asks["doc"].to_numpy(), asks["label"].to_numpy()
        sizes = np.array([len(x) for x in own])
        grams = np.concatenate(own)
        order = np.argsort(grams, kind="stable")
        grams, who = grams[order], np.repeat(np.arange(len(own)), sizes)[order]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for doc, label, other in zip(data["doc"], data["label"], _sets_of(data["packed"])):
            low, high = np.searchsorted(grams, other, "left"), np.searchsorted(grams, other, "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(who[at], minlength=len(own))
            for i in np.flatnonzero((common > 0) & (100 * common >= percent * (sizes + len(other) - common))):
                a, b = root(int(labels[i])), root(int(label))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((int(names[i]), int(doc)))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = mixed(batch.column("doc").to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(FILTER_BITS)
        words = np.zeros(FILTER_BITS // 64, np.uint64)
        np.bitwise_or.at(words, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), signed(words[at])], ["word", "bits"])


def near_duplicates(docs: DataFrame, percent: int = 75, coordinates: int = COORDINATES, matches: int = MATCHES, block: int = CROWD_BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (columns doc_id and text are read).

    Documents link when 100 * intersection >= percent * union of their sets of distinct five-word shingles
    (words between blanks, A-Z lower-cased); with fewer words the whole sequence is the one shingle. Null,
    empty and blank texts have an empty set and link with nothing. component_id is the smallest doc_id
    reachable, kept marks it. A row with a null id links with nothing, has a null component and is kept.
    Repeated rows are copies under one id; rows of one id with different texts link by any of them.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    features = stored(set_features(docs, coordinates), f"{folder}/features")
    filled = features.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    members = stored(filled.select("doc_id", "s1", "s2").distinct().join(groups, ["s1", "s2"]), f"{folder}/members")
    own = members.where("doc_id = rep").select("s1", "s2", F.col("rep").alias("doc"))
    signatures = stored(
        filled.join(own.withColumnRenamed("doc", "doc_id"), ["doc_id", "s1", "s2"], "left_semi")
        .select(F.col("doc_id").alias("doc"), "signature").distinct(), f"{folder}/signatures")

    posted = signatures.mapInArrow(lambda x: _postings(x, coordinates), "token long, doc long")
    lists = posted.groupBy("token").agg(F.count("*").alias("df"), F.min("doc").alias("low"), F.max("doc").alias("high")).where("df > 1")
    joined = posted.join(lists, "token")
    ranked = joined.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "token", "low", "high")), asc=False).alias("all"))
    prefix = stored(
        ranked.where(F.size("all") >= matches)
        .select("doc", F.explode(F.slice("all", matches, coordinates)).alias("p")).select("doc", "p.token", "p.low", "p.high"),
        f"{folder}/prefix")

    check = _Links(docs, signatures, folder, matches, percent)
    hubs = prefix.select("doc", F.explode(F.array("low", "high")).alias("hub")).where("doc <> hub")
    stars = hubs.select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()
    compared = check.agreeing(stars, "hubs")
    found = check.confirmed(compared, "hubs")
    keeper = _keeper(folder)
    labels = keeper(connected_components(found, keeper))

    placed = stored(
        signatures.select("doc").join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("doc", F.coalesce("component", "doc").alias("label")),
        f"{folder}/placed")

    def between_labels(pairs: DataFrame) -> DataFrame:
        """Pairs of sets as pairs of their labels, where these differ."""
        own = lambda side: placed.select(F.col("doc").alias(side), F.col("label").alias(f"l{side}"))
        met = pairs.join(own("a"), "a").join(own("b"), "b").where("la <> lb")
        return met.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()

    def grouped(pairs: DataFrame, node: str, group: str) -> DataFrame:
        return keeper(connected_components(pairs, keeper)).select(F.col("node").alias(node), F.col("component").alias(group))

    crowds = placed.join(grouped(between_labels(compared), "label", "crowd"), "label", "left")
    hubs_of = stored(crowds.select("doc", "label", F.coalesce("crowd", "label").alias("hub"), F.col("crowd").isNotNull().alias("crowded")), f"{folder}/hubs")
    labelled = prefix.select("token", "doc").join(hubs_of.select("doc", "hub"), "doc")
    apart = labelled.groupBy("token").agg((F.min("hub") < F.max("hub")).alias("apart")).where("apart").select("token")
    merged = grouped(check.merging(labelled.join(apart, "token"), block), "hub", "component")
    members_of = hubs_of.join(merged, "hub", "left").where("crowded OR component IS NOT NULL").select("doc", "label", F.coalesce("component", "hub").alias("hub"))
    per_label = members_of.groupBy("hub", "label").agg(F.count("*").alias("n"))
    heads = per_label.groupBy("hub").agg(F.max_by("label", F.struct("n", "label")).alias("head"), F.count("*").alias("labels")).where("labels > 1")
    crowd = stored(members_of.join(heads, "hub").select("doc", "label", "hub", (F.col("label") != F.col("head")).alias("stray")), f"{folder}/crowd")

    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last")
    one_id = members.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    joined_labels = grouped(between_labels(check.crowded(crowd, block).unionByName(one_id)), "label", "joined")
    components = (
        members.select("doc_id", F.col("rep").alias("doc")).join(placed, "doc").join(joined_labels, "label", "left")
        .groupBy("doc_id").agg(F.min(F.coalesce("joined", "label")).alias("component")))

    result = features.select("doc_id", "n_shingles").join(components, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _keeper(folder: str):
    made = iter(range(1_000_000))
    return lambda df: stored(df, f"{folder}/step-{next(made)}")
