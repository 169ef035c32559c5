"""Benchmark decontamination with spaced seeds.

A seed hashes the tokens that a fixed mask selects, so a substituted word at an ignored position changes
nothing. Seeds of the benchmark go into a bit filter of fixed size; positions of the training text that pass
it are gathered into regions with their surroundings, and only their seeds are joined with the benchmark's.
Each hit gives a diagonal, along which region and item are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.frames import shared_folder, stored
from tillwatch.llm.hashing import mixed, sequences, signed, text_blocks, words_of

#: Positions that a seed reads (1) and ignores (0).
MASKS = ("111111", "110110011", "111001101", "101101011")
#: Items too short for all masks are found by their whole sequence, from this many tokens on.
LEAST_TOKENS = 5
FILTER_BITS = 1 << 25
CONTEXT = 64
#: Matching tokens that make an overlap, or this share of a shorter item; share of matches inside it.
OVERLAP, ITEM_SHARE, IDENTITY = 13, 0.8, 0.75

_BLANK = np.array([not (chr(b).isalnum() or b >= 0x80) if b < 0x80 else False for b in range(256)])
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 62, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Token hashes: runs of letters and digits, lower-cased, whatever stands between them."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    for low, _, data, offsets in text_blocks(lowered):
        tokens, begins = words_of(data, offsets, fold=False, blank=_BLANK)
        yield low, tokens, begins


def _lanes(tokens: np.ndarray, short: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lane, span, hash at each position): one lane per mask, one per short length in use."""
    for lane, mask in enumerate(MASKS):
        n = len(tokens) - len(mask) + 1
        if n > 0:
            h = np.full(n, lane + 1, np.uint64)
            for at, read in enumerate(mask):
                if read == "1":
                    h += tokens[at : at + n] * _FACTORS[at]
            yield lane, len(mask), mixed(h)
    for length in short:
        if len(tokens) >= length:
            yield 100 + length, length, sequences(tokens, length, salt=3)


SHORT = range(LEAST_TOKENS, max(map(len, MASKS)))


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("item_id").to_pylist()
        for low, tokens, begins in _tokens(batch.column("text")):
            for row in range(len(begins) - 1):
                own = tokens[begins[row] : begins[row + 1]]
                lanes = list(_lanes(own, [len(own)] if len(own) in SHORT else []))
                h = np.concatenate([x[2] for x in lanes]) if lanes else np.zeros(0, np.uint64)
                at = np.concatenate([np.arange(len(x[2])) for x in lanes]) if lanes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [signed(h), pa.array([ids[low + row]] * len(h), pa.int64()), pa.array(at.astype(np.int32)),
                     pa.array(np.full(len(h), len(own), np.int32))], ["seed", "item_id", "item_at", "item_tokens"])


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [tokens[begins[r] : begins[r + 1]].view(np.int64) for _, tokens, begins in _tokens(batch.column("text")) for r in range(len(begins) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(rows, pa.list_(pa.int64()))], ["item_id", "item"])


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h % np.uint64(FILTER_BITS), (h >> np.uint64(32)) % np.uint64(FILTER_BITS)


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)
        slots = np.unique(np.concatenate(_bits(h)))
        words, first = np.unique(slots >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (slots & np.uint64(63)), first) if len(words) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), signed(bits)], ["word", "bits"])


def _regions(batches: Iterator[pa.RecordBatch], bits: np.ndarray, short: list[int]) -> Iterator[pa.RecordBatch]:
    span = max(map(len, MASKS))
    inside = lambda slot: (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    for batch in batches:
        out: dict[str, list] = {"row": [], "start": [], "tokens": [], "seeds": [], "ats": []}
        for low, tokens, begins in _tokens(batch.column("text")):
            ends = begins[1:]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for _, length, h in _lanes(tokens, short):
                one, two = _bits(h)
                at = np.flatnonzero(inside(one))
                at = at[inside(two[at])]
                row = np.searchsorted(begins, at, "right") - 1
                at = at[at + length <= ends[row]]
                found.append((at, h[at]))
            if not found:
                continue
            at, h = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
            row = np.searchsorted(begins, at, "right") - 1
            cut = np.flatnonzero((np.diff(row) > 0) | (np.diff(at) > CONTEXT)) + 1
            for a, b in zip(np.append(0, cut), np.append(cut, len(at))) if len(at) else ():
                r = row[a]
                start = max(begins[r], at[a] - CONTEXT)
                out["row"].append(low + r)
                out["start"].append(start - begins[r])
                out["tokens"].append(tokens[start : min(ends[r], at[b - 1] + span + CONTEXT)].view(np.int64))
                out["seeds"].append(h[a:b].view(np.int64))
                out["ats"].append((at[a:b] - start).astype(np.int32))
        rows = pa.array(np.array(out["row"], np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(np.array(out["start"], np.int64)),
             pa.array(out["tokens"], pa.list_(pa.int64())), pa.array(out["seeds"], pa.list_(pa.int64())), pa.array(out["ats"], pa.list_(pa.int32()))],
            ["doc_id", "text_hash", "start", "tokens", "seeds", "ats"])


def _best(same: np.ndarray) -> tuple[int, int, int]:
    """(matches, first, end) of the stretch with most matches over mismatches, a mismatch weighing three."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
    low = np.minimum.accumulate(score)
    end = int((score - low).argmax())
    first = int(score[: end + 1].argmin())
    return int(same[first:end].sum()), first, end


def _most(same: np.ndarray, identity: float) -> tuple[int, int, int]:
    """(matches, first, end) of the stretch with most matches among those with at least this share of matches."""
    matches = np.concatenate([[0], np.cumsum(same)])
    score = matches - identity * np.arange(len(matches))
    low = np.minimum.accumulate(score)
    first = np.searchsorted(-low, -(score + 1e-9))
    end = int((matches - matches[first]).argmax())
    n = int(matches[end] - matches[first[end]])
    return n, int(np.searchsorted(matches, matches[first[end]], "right")) - 1 if n else end, end


def _verified(batches: Iterator[pa.RecordBatch], overlap: int, share: float, identity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, matched, first, end = [], [], [], []
        starts = batch.column("start").to_pylist()
        for i, (region, item, shift) in enumerate(zip(batch.column("tokens"), batch.column("item"), batch.column("shift").to_pylist())):
            region, item = (x.values.to_numpy(zero_copy_only=False) for x in (region, item))
            low, high = max(0, -shift), min(len(item), len(region) - shift)
            if high <= low:
                continue
            same = item[low:high] == region[low + shift : high + shift]
            needed = min(overlap, int(np.ceil(share * len(item))))
            n, a, b = _best(same)
            if n < needed or n < identity * (b - a):
                n, a, b = _most(same, identity)
            if n >= needed:
                keep.append(i)
                matched.append(n)
                first.append(starts[i] + shift + low + a)
                end.append(starts[i] + shift + low + b)
        part = batch.select(["doc_id", "text_hash", "item_id", "item_tokens"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(matched, pa.int64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())],
            [*part.schema.names, "n_matched", "first_token", "end_token"])


def contaminated(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, item_share: float = ITEM_SHARE, identity: float = IDENTITY) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, text_hash, item_id, item_tokens, n_matched,
    first_token, end_token (the best stretch's range in the document's tokens: the one with most matches over
    mismatches, or, where that is no overlap, the overlap with most matches).

    docs has doc_id and text, benchmark item_id and text. Tokens are runs of letters and digits, lower-cased.
    An overlap is a stretch along one diagonal with at least min(overlap, item_share * item tokens) equal
    tokens, at least ``identity`` of the stretch. Null and empty texts have no tokens; items under LEAST_TOKENS
    tokens are never found. Repeated rows give one row; rows of one id with different texts are told apart by
    text_hash. Null ids are carried along. An empty table on either side gives no rows. Very long items are
    compared within CONTEXT tokens around their hits.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    seeds = stored(items.mapInArrow(_item_seeds, "seed long, item_id long, item_at int, item_tokens int"), f"{folder}/seeds")
    short = [r.item_tokens for r in seeds.where(F.col("item_tokens").isin([*SHORT])).select("item_tokens").distinct().toLocalIterator()]
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for row in seeds.mapInArrow(_filter_words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        bits[row.word] = row.bits
    shared = spark.sparkContext.broadcast(bits.view(np.uint64))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    regions = stored(
        texts.mapInArrow(lambda x: _regions(x, shared.value, short),
                         f"doc_id {kind}, text_hash long, start long, tokens array<long>, seeds array<long>, ats array<int>")
        .withColumn("region", F.xxhash64("doc_id", "text_hash", "start")).distinct(), f"{folder}/regions")
    hits = regions.select("region", F.explode(F.arrays_zip("seeds", "ats")).alias("hit")).select("region", F.col("hit.seeds").alias("seed"), F.col("hit.ats").alias("at"))
    diagonals = (hits.join(seeds, "seed").groupBy("region", "item_id", "item_tokens").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts"))
                 .select("region", "item_id", "item_tokens", F.explode("shifts").alias("shift")))
    wholes = items.mapInArrow(_item_tokens, "item_id long, item array<long>")
    met = (diagonals.join(regions.select("region", "doc_id", "text_hash", "start", "tokens"), "region")
           .join(wholes, "item_id").where(F.size("item") == F.col("item_tokens")))
    checked = met.mapInArrow(
        lambda x: _verified(x, overlap, item_share, identity),
        f"doc_id {kind}, text_hash long, item_id long, item_tokens int, n_matched long, first_token long, end_token long")
    best = F.max_by(F.struct("item_tokens", "first_token", "end_token", "n_matched"), F.struct("n_matched", -F.col("first_token"))).alias("b")
    return checked.groupBy("doc_id", "text_hash", "item_id").agg(best).select(
        "doc_id", "text_hash", "item_id", F.col("b.item_tokens").cast("long").alias("item_tokens"), "b.n_matched", "b.first_token", "b.end_token")
