"""Repeated passages by seed and extend.

Seeds: of the ``LENGTH - ANCHOR + 1`` anchors (runs of ``ANCHOR`` words) inside a window of ``LENGTH`` words
the one with the least hash is the window's seed, so equal windows have equal seeds at equal offsets.
Neighbouring windows mostly share their seed; the words they cover together are the seed's stretch, the
furthest a match through this seed can be extended both ways.

Documents meet on seeds. Where whole stretches agree, all windows of the later one repeat. Seeds whose
stretches differ (the ends of passages, edited copies) are extended window by window, against every other
stretch of the seed. Adjoining matches merge, which gives the maximal repeats.

Equal rows of one Arrow batch are settled before the shuffle, so a passage that a third of all documents
share is a few rows per batch, and settled rows are dealt out by document. The seeds at the ends of such a
passage have as many stretches as documents: seeds found often in a sample of documents are dealt out by
stretch, and taken to have several, which only sends their windows on to be compared. The sample steers the
dealing alone; the result is the same without it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm.frames import shared_folder, stored
from tillwatch.llm.hashing import mixed, sequences, signed, text_blocks, words_of

LENGTH, ANCHOR = 20, 6
LAST = (1 << 63) - 1
SHIFT = 40
ROWS = "k long, sigma long, doc long, at long, n int, many boolean"
#: One document in SAMPLE shows which seeds are frequent: in at least FREQUENT documents of it and this share.
SAMPLE, FREQUENT, FREQUENT_SHARE = 64, 8, 0.002
_STEP = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 62, 4 * LENGTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _fingerprints(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """23 bits per text, put above the word positions: rows of one id with other texts stay apart."""
    sums = np.zeros(len(begins) - 1, np.uint64)
    filled = np.flatnonzero(np.diff(begins))
    if len(filled):
        order = np.arange(len(words), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        local = order - np.repeat(order[begins[filled]], np.diff(begins)[filled]) + np.uint64(1)
        sums[filled] = np.add.reduceat(words * local, begins[filled])
    return (mixed(sums) >> np.uint64(SHIFT + 1)).astype(np.int64) << SHIFT


def _settled(k: np.ndarray, sigma: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    """One row of each (k, sigma), the earliest; later ones become settled rows (n < 0), runs of them merged."""
    order = np.lexsort((at, doc, sigma, k))
    k, sigma, doc, at, n, many = (x[order] for x in (k, sigma, doc, at, n, many))
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (sigma[1:] != sigma[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    same = (doc == doc[first]) & (at == at[first])
    late = ~same
    d, a, m = doc[late], at[late], n[late].astype(np.int64)
    order = np.lexsort((a, d))
    d, a, m = d[order], a[order], m[order]
    head = np.ones(len(d), bool)
    head[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1] + m[:-1])
    heads = np.flatnonzero(head)
    total = np.add.reduceat(m, heads) if len(heads) else np.zeros(0, np.int64)
    d, a = d[head], a[head]
    out = [np.concatenate(x) for x in (
        (k[new], mixed(d.view(np.uint64) + np.uint64(1))), (sigma[new], np.zeros(len(d), np.uint64)),
        (doc[new], d), (at[new], a), (n[new].astype(np.int64), -total), (many[new], np.zeros(len(d), bool)))]
    return pa.RecordBatch.from_arrays(
        [signed(out[0]), signed(out[1]), pa.array(out[2]), pa.array(out[3]), pa.array(out[4].astype(np.int32)), pa.array(out[5])],
        ["k", "sigma", "doc", "at", "n", "many"])


def _seeds(batches: Iterator[pa.RecordBatch], length: int, anchor: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """frequent: sorted hashes of the seeds whose rows are dealt out by stretch."""
    reach = length - anchor + 1
    for batch in batches:
        ids = batch.column("doc").to_numpy(zero_copy_only=False)
        parts: list[tuple[np.ndarray, ...]] = []
        for low, _, data, offsets in text_blocks(batch.column("text")):
            words, begins = words_of(data, offsets, fold=False)
            counts = np.diff(begins)
            windows = np.maximum(counts - length + 1, 0)
            if not windows.sum():
                continue
            grams = sequences(words, anchor)
            row = np.repeat(np.arange(len(counts)), windows)
            start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + begins[:-1][row]
            view = np.lib.stride_tricks.sliding_window_view(grams, reach)
            seed = np.empty(len(start), np.int64)
            for x in range(0, len(start), 100_000):
                seed[x : x + 100_000] = view[start[x : x + 100_000]].argmin(1) + start[x : x + 100_000]
            head = np.ones(len(start), bool)
            head[1:] = seed[1:] != seed[:-1]
            heads = np.flatnonzero(head)
            n = np.diff(np.append(heads, len(start)))
            s1, where = start[heads], seed[heads]
            covered = n + length - 1
            inner = np.arange(covered.sum()) - np.repeat(np.cumsum(covered) - covered, covered)
            sigma = np.add.reduceat(words[np.repeat(s1, covered) + inner] * _STEP[inner], np.cumsum(covered) - covered)
            sigma = mixed(sigma + (n * 64 + where - s1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            text = row[heads]
            at = _fingerprints(words, begins)[text] + s1 - begins[:-1][text]
            k, many = grams[where], np.zeros(len(where), bool)
            if len(frequent):
                many = frequent[np.minimum(np.searchsorted(frequent, k), len(frequent) - 1)] == k
                k = np.where(many, mixed(k + sigma), k)
            parts.append((k, sigma, ids[low + text], at, n, many))
        if parts:
            yield _settled(*(np.concatenate(x) for x in zip(*parts)))


def _frequent_seeds(keyed: DataFrame, length: int, anchor: int) -> np.ndarray:
    """Seeds of many documents in the sample; at most (seeds of a document) / FREQUENT_SHARE of them."""
    part = keyed.where(F.pmod(F.xxhash64(F.lit(13), "doc"), F.lit(SAMPLE)) == 0).select("doc", "text")
    nothing = np.zeros(0, np.uint64)
    held = part.mapInArrow(lambda x: _seeds(x, length, anchor, nothing), ROWS).where("n > 0")
    least = max(FREQUENT, FREQUENT_SHARE * part.count())
    seen = held.groupBy("k").agg(F.count_distinct("sigma").alias("n")).where(F.col("n") >= least).select("k")
    return np.sort(np.array([r.k for r in seen.toLocalIterator()], np.int64).view(np.uint64))


def _window_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every open window of the documents: two hashes of its words."""
    for batch in batches:
        texts = pa.array([zlib.decompress(x.as_py()).decode() for x in batch.column("packed")], pa.string())
        ids = batch.column("doc").to_numpy(zero_copy_only=False)
        spots = batch.column("spots")
        parts = []
        for low, _, data, offsets in text_blocks(texts):
            words, begins = words_of(data, offsets, fold=False)
            marks = _fingerprints(words, begins)
            one, two = sequences(words, length), sequences(words, length, 1)
            for row in range(len(begins) - 1):
                spot = spots[low + row].values
                at = spot.field("at").to_numpy(zero_copy_only=False)
                n = spot.field("n").to_numpy(zero_copy_only=False)
                own = (at >> SHIFT) << SHIFT == marks[row]
                at, n = at[own], n[own].astype(np.int64)
                every = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                where = every - marks[row] + begins[row]
                parts.append((one[where], two[where], np.full(len(every), ids[low + row]), every, np.ones(len(every), np.int64), np.zeros(len(every), bool)))
        if parts:
            yield _settled(*(np.concatenate(x) for x in zip(*parts)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [zlib.compress((x.as_py() or "").encode(), 1) for x in batch.column("text")]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "packed", pa.array(packed, pa.binary()))


def _judged(rows: DataFrame) -> DataFrame:
    """doc, at, n and state: 1 repeats an earlier row, 2 is first of its sigma but not the seed's only one, 0 alone."""
    settled = F.col("n") < 0
    ordered = rows.withColumn("settled", settled)
    whole = Window.partitionBy("k", "settled").orderBy("sigma", "doc", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    alike = Window.partitionBy("k", "settled", "sigma").orderBy("doc", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = ordered.select(
        "doc", "at", F.abs("n").alias("n"), "settled",
        (F.col("many") | (F.first("sigma").over(whole) != F.last("sigma").over(whole))).alias("several"),
        ((F.first("doc").over(alike) != F.col("doc")) | (F.first("at").over(alike) != F.col("at"))).alias("late"))
    state = F.when(F.col("settled") | F.col("late"), 1).when(F.col("several"), 2).otherwise(0)
    return seen.select("doc", "at", "n", state.alias("state"))


def _kept(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, gone, spans = [], [], [], []
        packed = [zlib.decompress(x.as_py()) for x in batch.column("packed")]
        spots = batch.column("spots")
        marked = [i for i in range(batch.num_rows) if spots[i].is_valid]
        marks = {}
        if marked:
            for low, _, data, offsets in text_blocks(pa.array([packed[i].decode() for i in marked], pa.string())):
                for row, mark in enumerate(_fingerprints(*words_of(data, offsets, fold=False))):
                    marks[marked[low + row]] = mark
        for i, raw in enumerate(packed):
            words = raw.split()
            ranges: list[tuple[int, int]] = []
            if i in marks:
                spot = spots[i].values
                at, n = (spot.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
                own = (at >> SHIFT) << SHIFT == marks[i]
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, at[own] - marks[i], 1)
                np.add.at(change, np.minimum(at[own] - marks[i] + n[own] + length - 1, len(words)), -1)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(change) > 0, [0]]).astype(np.int8)))
                ranges = [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]
            left, at = [], 0
            for a, b in ranges:
                left += words[at:a]
                at = b
            left += words[at:]
            texts.append(b" ".join(left).decode())
            counts.append(len(words))
            gone.append(len(words) - len(left))
            spans.append([{"first": a, "end": b} for a, b in ranges])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))],
            ["doc_id", "kept", "n_words", "n_removed", "removed"])


def dedup_substrings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Remove every word covered by a window of ``length`` words that also starts earlier.

    Earlier is a smaller doc_id, or the same document and an earlier start; windows are judged on the input.
    Columns doc_id and text of docs are read. Per row: doc_id, kept (words left, joined by one blank), n_words,
    n_removed, removed (maximal repeats as word ranges). Null, empty and blank texts have no words; texts
    under ``length`` words lose none. A null id comes after all others. Rows equal in id and text count as
    one and are treated alike; rows of one id with different texts are told apart and ordered by a
    fingerprint of the text. An empty table gives no rows.
    """
    folder = shared_folder(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = source.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "doc_id", "text")
    filled = keyed.where("text IS NOT NULL").select("doc", "text")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent_seeds(filled, length, anchor))
    rows = filled.mapInArrow(lambda x: _seeds(x, length, anchor, frequent.value), ROWS)
    judged = stored(_judged(rows).where("state > 0"), f"{folder}/judged")

    packed = keyed.mapInArrow(_packed, "doc long, doc_id long, packed binary")
    spot = F.collect_list(F.struct("at", "n")).alias("spots")
    unsure = judged.where("state = 2").groupBy("doc").agg(spot)
    windows = packed.select("doc", "packed").join(unsure.hint("shuffle_hash"), "doc").mapInArrow(lambda x: _window_rows(x, length), ROWS)
    more = stored(_judged(windows).where("state = 1").drop("state"), f"{folder}/windows")
    marks = judged.where("state = 1").drop("state").unionByName(more).groupBy("doc").agg(spot)
    return packed.join(marks.hint("shuffle_hash"), "doc", "left").select("doc_id", "packed", "spots").mapInArrow(
        lambda x: _kept(x, length),
        "doc_id long, kept string, n_words long, n_removed long, removed array<struct<first: int, end: int>>")
