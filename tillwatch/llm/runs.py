"""Periodic runs of words by string synchronising sets.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of length at least
max(6, 4 q), that no neighbouring word extends. At scale t (4, 8, 16, ...) the windows of t words get hashes;
a position is selected when the least hash among the windows at it and the next t ones is that of its first or
last. Selection depends on 2 t words only, so in a run of period q, t <= q < 2 t, selected positions recur q
apart: the next position with the same 2 t words proposes q. Windows inside runs of period <= t / 4 take no part in
the minimum; they leave no gap, as 3 t - 1 words of such a window chain cannot also have the run's period. Those
small periods are known from the finer scales, and below 4 from comparing neighbours. Every proposal is extended word by
word both ways, so what is returned is a run, and none is missed but for collisions of 64-bit hashes.

The texts of a block are one array with a separator that equals nothing between them; all of this is done on the
array at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.hashing import mixed, text_blocks, words_of

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Periods below this are found by comparing neighbours; it is also the finest scale.
FINEST = 4
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _extended(w: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """Largest [low, high) around at with w[i] = w[i + q] for all its i; steps double while all agree."""
    high, step, end = at, 64, len(w) - q
    while high < end:
        differ = w[high : min(high + step, end)] != w[high + q : min(high + step, end) + q]
        if differ.any():
            high += int(differ.argmax())
            break
        high, step = min(high + step, end), step * 2
    low, step = at, 64
    while low > 0:
        first = max(low - step, 0)
        differ = (w[first:low] != w[first + q : low + q])[::-1]
        if differ.any():
            low -= int(differ.argmax())
            break
        low, step = first, step * 2
    return low, high


def _close_repeats(w: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all stretches with period q that are long enough."""
    same = np.zeros(len(w) - q + 2, bool)
    same[1:-1] = w[:-q] == w[q:]
    turns = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = turns[::2], turns[1::2] + q
    long = ends - starts >= max(LEAST_LENGTH, LEAST_EXPONENT * q)
    return starts[long], ends[long]


def _least_ahead(values: np.ndarray, scale: int) -> np.ndarray:
    """Minimum of values[i .. i + scale] by doubling; scale is a power of two."""
    width = 1
    while width < scale:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[:-1], values[1:])


def runs_of(w: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the array, by start and period; no text in it is longer than longest."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(FINEST, longest // LEAST_EXPONENT + 1)):
        if len(w) > q:
            for start, end in zip(*(x.tolist() for x in _close_repeats(w, q))):
                found.setdefault((start, end), q)
    scale, hashes = 1, w
    while scale < FINEST and len(hashes) > scale:
        hashes, scale = mixed(hashes[:-scale] * _M1 + mixed(hashes[scale:] * _M2)), scale * 2
    while scale <= longest // LEAST_EXPONENT and len(hashes) > scale:
        wider = mixed(hashes[:-scale] * _M1 + mixed(hashes[scale:] * _M2))
        own = hashes
        inside = [(s, e) for (s, e), q in found.items() if LEAST_EXPONENT * q <= scale <= e - s]
        if inside:
            own = hashes.copy()
            for s, e in inside:
                own[s : e - scale + 1] = _NEVER
        least = _least_ahead(own, scale)[: len(wider)]
        chosen = np.flatnonzero(((least == own[: len(least)]) | (least == own[scale : scale + len(least)])) & (least != _NEVER))
        order = np.argsort(wider[chosen], kind="stable")
        at, context = chosen[order], wider[chosen[order]]
        gap = at[1:] - at[:-1]
        pair = np.flatnonzero((context[1:] == context[:-1]) & (gap >= scale) & (gap < 2 * scale))
        known: dict[int, int] = {}
        for k in pair[np.lexsort((at[pair], gap[pair]))]:
            s, q = int(at[k]), int(gap[k])
            if s < known.get(q, 0):
                continue
            low, high = _extended(w, s, q)
            known[q] = high
            if high - low + q >= LEAST_EXPONENT * q:
                found.setdefault((low, high + q), q)
        hashes, scale = wider, scale * 2
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone)]


def _found(batches: Iterator[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for low, high, data, offsets in text_blocks(texts):
            words, begins = words_of(data, offsets, fold=False)
            n = high - low
            line = np.empty(len(words) + n, np.uint64)
            starts = begins[:-1] + np.arange(n)
            separators = begins[1:] + np.arange(n)
            is_word = np.ones(len(line), bool)
            is_word[separators] = False
            line[is_word] = words
            line[separators] = mixed(np.arange(n, dtype=np.uint64) + np.uint64(0xA5A5A5A5A5A5A5A5))
            per_text: dict[int, list[tuple[int, int, int]]] = {}
            for start, length, period in runs_of(line, int(np.diff(begins).max())):
                row = int(np.searchsorted(starts, start, "right")) - 1
                per_text.setdefault(row, []).append((start - int(starts[row]), length, period))
            runs, kept = [], []
            for row in range(n):
                own = per_text.get(row, [])
                raw = data[offsets[row] : offsets[row + 1]].tobytes().split()
                runs.append([{"start": s, "length": k, "period": q} for s, k, q in own])
                kept.append(b" ".join(_kept(raw, own) if own else raw).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, n), pa.array((begins[1:] - begins[:-1]).astype(np.int64)),
                 pa.array(runs, out.field("runs").type), pa.array(kept, pa.string())], schema=out)


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start and period), collapsed; one row per row of docs.

    Only doc_id and text are read. Words lie between blanks (20, 09-0D). collapsed is the text without the words that any run
    holds after its first period, words joined by one space. A null or blank text has no words, no runs and an
    empty collapsed text. Rows with a null id or a repeated one are searched on their own like all others. Nothing
    is shuffled; a task holds blocks of about 2 MB of text, or one longer text.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUN), ("collapsed", pa.string())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        lambda batches: _found(batches, schema),
        "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def longest_run(runs: str = "runs") -> Column:
    """The run of greatest length, then smallest start, then smallest period; null without runs."""
    ranked = F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(ranked)


def runs_text(runs: str = "runs") -> Column:
    """One line start,length,period per run, each ended by a line feed."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return F.array_join(lines, "")
