"""Phrase collocations by direct-address tiling.

Words are counted first, per language. The most frequent ones, a bounded number, get ranks by frequency; two ranks
address a cell of a tile of ``SIDE`` by ``SIDE`` cells. A task sorts its word pairs into tiles: a tile met often is
counted by a dense bincount over its cells, the pairs of sparse tiles and those with a word without rank are counted
from sorted coordinates. Pairs that occur often enough are then units of their own: the most frequent ones are ranked
again, and a triple is the tile cell of its first pair's rank and its last word's rank. Tasks emit partial counts;
Spark adds them up per phrase. Words, pairs and triples are known by the 64-bit hashes of their words; a hash that
two words share is an error, never a wrong count.

Filters of fixed size tell the tasks which words and pairs can belong to a phrase that is frequent enough. They only spare
work: what passes by accident is dropped by its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch.llm.frames import shared_folder, stored
from tillwatch.llm.hashing import mixed, signed, text_blocks, words_of

#: What ends a piece, and what parts its words.
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Cells along a tile's side, and events from which on a tile is counted densely.
SIDE, DENSE_EVENTS = 512, 20_000
#: Ranked units, over all languages; more frequent first. Bounds what is broadcast.
RANKED = 16_384
#: Bits of a filter, units a task gathers before it counts them, and words it holds before it passes their counts on.
FILTER_BITS, GATHERED, HELD_WORDS = 1 << 24, 1_000_000, 250_000
LEAST, SHARE, TOP = 10, 50, 2000

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_BLANK = _BREAK.copy()
_BLANK[list(GAPS)] = True
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Block:
    """Words of a block of texts in order: hash, text row, piece number, place in the bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        self.words, begins = words_of(data, offsets, fold=True, blank=_BLANK)
        solid = ~_BLANK[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = solid[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = solid[1:]
        self.starts = np.flatnonzero(solid & (~before | cut[:-1]))
        self.ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
        breaks = np.cumsum(_BREAK[data])
        self.pieces = breaks[self.starts] if len(self.starts) else np.zeros(0, np.int64)

    def word(self, at: int) -> str:
        return self.data[self.starts[at] : self.ends[at]].tobytes().translate(_FOLD).decode()

    def follows(self, gap: int) -> np.ndarray:
        """Whether the word and the one gap places on lie in one piece of one text."""
        if len(self.words) <= gap:
            return np.zeros(0, bool)
        return (self.pieces[:-gap] == self.pieces[gap:]) & (self.rows[:-gap] == self.rows[gap:])


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray, _Block]]:
    """(languages, language number of each word, words) of blocks of texts."""
    langs = batch.column("lang").to_pylist()
    for low, high, data, offsets in text_blocks(batch.column("text")):
        block = _Block(data, offsets)
        names = sorted(set(langs[low:high]))
        number = {name: k for k, name in enumerate(names)}
        yield names, np.array([number[x] for x in langs[low:high]], np.int64)[block.rows], block


def _by_lang(names: list[str], codes: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """(language, places of its entries); each place comes once."""
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(names) + 1))
    for k, name in enumerate(names):
        if bounds[k] < bounds[k + 1]:
            yield name, order[bounds[k] : bounds[k + 1]]


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal keys made one by sorting: sorted coordinates and the sums of their counts."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict[int, list]] = {}
    size = 0

    def emitted() -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            hashes = np.fromiter(words, np.uint64, len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words)), signed(hashes), pa.array([w for w, _ in words.values()]), pa.array([c for _, c in words.values()], pa.int64())],
                ["lang", "h", "word", "n"])

    for batch in batches:
        for names, codes, block in _blocks(batch):
            for lang, at in _by_lang(names, codes):
                hashes, first, counts = np.unique(block.words[at], return_index=True, return_counts=True)
                own = held.setdefault(lang, {})
                for h, place, n in zip(hashes.tolist(), at[first].tolist(), counts.tolist()):
                    entry = own.get(h)
                    if entry is None:
                        own[h] = [block.word(place), n]
                        size += 1
                    else:
                        entry[1] += n
            if size > HELD_WORDS:
                yield from emitted()
                held, size = {}, 0
    yield from emitted()


class Ranks:
    """Ranks by frequency of a bounded number of units per language, looked up by their hash."""

    def __init__(self, rows: list[tuple[str, int]]) -> None:
        """rows (lang, hash), most frequent first."""
        self.by_lang: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for lang in {lang for lang, _ in rows}:
            ranked = np.array([h for name, h in rows if name == lang], np.int64).view(np.uint64)
            order = np.argsort(ranked)
            self.by_lang[lang] = (ranked[order], order, ranked)

    def of(self, lang: str, hashes: np.ndarray) -> np.ndarray:
        """Rank of each hash, -1 without."""
        if lang not in self.by_lang:
            return np.full(len(hashes), -1)
        known, rank, _ = self.by_lang[lang]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, rank[at], -1)

    def hashes(self, lang: str, ranks: np.ndarray) -> np.ndarray:
        return self.by_lang[lang][2][ranks]


def _slot(lang: str, h: np.ndarray) -> np.ndarray:
    return mixed(h ^ np.uint64(hash_of(lang))) % np.uint64(FILTER_BITS)


def hash_of(lang: str) -> int:
    return int.from_bytes(lang.encode()[:64].ljust(8, b"\0"), "big") % 0x1FFFFFFFFFFFFFFF


def _passes(bits: np.ndarray, lang: str, h: np.ndarray) -> np.ndarray:
    slot = _slot(lang, h)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + mixed(right))


def tiled_counts(
    lang: str, left: np.ndarray, right: np.ndarray, rows: Ranks, columns: Ranks, parts: list[np.ndarray], dense_events: int = DENSE_EVENTS
) -> tuple[list[np.ndarray], np.ndarray]:
    """Occurrences (unit left before unit right) to distinct coordinates and counts.

    ``parts`` are the words of each occurrence, which is what a phrase is returned as. Occurrences whose units are both
    ranked fall into tiles; a tile with enough of them is counted over its cells, all else from sorted coordinates. An
    occurrence whose words are not those of its cell (a hash that units share) is counted with the rest.
    """
    r, c = rows.of(lang, left), columns.of(lang, right)
    ranked = (r >= 0) & (c >= 0)
    across = int(c.max(initial=0)) // SIDE + 1
    tile = np.where(ranked, (r // SIDE) * across + c // SIDE, -1)
    met = np.bincount(tile[ranked], minlength=1) if ranked.any() else np.zeros(1, int)
    dense = ranked & (met[np.maximum(tile, 0)] >= dense_events)
    out, counts = [[] for _ in parts], []
    placed = np.flatnonzero(dense)
    placed = placed[np.argsort(tile[placed], kind="stable")]
    for mine in np.split(placed, np.flatnonzero(np.diff(tile[placed])) + 1) if len(placed) else []:
        cell = (r[mine] % SIDE) * SIDE + c[mine] % SIDE
        example = np.zeros(SIDE * SIDE, np.int64)
        example[cell] = mine
        alike = np.logical_and.reduce([part[mine] == part[example[cell]] for part in parts])
        dense[mine[~alike]] = False
        n = np.bincount(cell[alike], minlength=SIDE * SIDE)
        full = np.flatnonzero(n)
        for k, part in enumerate(parts):
            out[k].append(part[example[full]])
        counts.append(n[full])
    rest = np.flatnonzero(~dense)
    sparse, n = _summed([p[rest] for p in parts], np.ones(len(rest), np.int64))
    return [np.concatenate([*o, s]) for o, s in zip(out, sparse)], np.concatenate([*counts, n])


def _phrase_counts(batches: Iterator[pa.RecordBatch], size: int, words: Ranks, units: Ranks, bits: np.ndarray, dense_events: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of the phrases of size words whose words (size 2) or pairs (size 3) pass the filter."""
    names = ["h1", "h2", "h3"][:size]
    held: dict[str, list[list[np.ndarray]]] = {}
    gathered = 0

    def emitted() -> Iterator[pa.RecordBatch]:
        for lang, chunks in held.items():
            parts = [np.concatenate(column) for column in zip(*chunks)]
            left = parts[0] if size == 2 else pair_hash(parts[0], parts[1])
            keys, n = tiled_counts(lang, left, parts[-1], units, words, parts, dense_events)
            for low in range(0, len(n), 200_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n[low : low + 200_000])), *[signed(k[low : low + 200_000]) for k in keys], pa.array(n[low : low + 200_000].astype(np.int64))],
                    ["lang", *names, "n"])

    for batch in batches:
        for langs, codes, block in _blocks(batch):
            near, w = block.follows(size - 1), block.words
            if not near.any():
                continue
            units_of = w if size == 2 else pair_hash(w[:-1], w[1:])
            good = np.zeros(len(units_of), bool)
            for lang, at in _by_lang(langs, codes[: len(units_of)]):
                good[at] = _passes(bits, lang, units_of[at])
            start = np.flatnonzero(near & good[:-1] & good[1:])
            for lang, at in _by_lang(langs, codes[start]):
                held.setdefault(lang, []).append([w[start[at] + k] for k in range(size)])
            gathered += len(start)
            if gathered > GATHERED:
                yield from emitted()
                held, gathered = {}, 0
    yield from emitted()


def _filter_words(batches: Iterator[pa.RecordBatch], pairs: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = np.zeros(FILTER_BITS // 64, np.uint64)
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        number = {name: k for k, name in enumerate(names)}
        h = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (("h1", "h2") if pairs else ("h",))]
        for lang, at in _by_lang(names, np.array([number[x] for x in langs], np.int64)):
            slot = _slot(lang, pair_hash(h[0][at], h[1][at]) if pairs else h[0][at])
            np.bitwise_or.at(words, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), signed(words[full])], ["word", "bits"])


def _filter_of(units: DataFrame, pairs: bool) -> np.ndarray:
    found = np.zeros(FILTER_BITS // 64, np.int64)
    slots = units.mapInArrow(lambda x: _filter_words(x, pairs), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    for row in slots.toLocalIterator():
        found[row.word] = row.bits
    return found.view(np.uint64)


def _most_frequent(units: DataFrame, columns: list[str], count: int) -> list:
    return units.orderBy(F.col("a").desc(), "lang", *columns).limit(count).select("lang", *columns).collect()


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in exact arithmetic."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(
    docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int | None = TOP, ranked: int = RANKED, dense_events: int = DENSE_EVENTS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the strongest phrases of two and three words of each lang.

    Texts (A-Z lower-cased) are cut at ``BREAKS`` into pieces and these at blanks and tabs into words. a, l, r count the
    phrase and the two sides of its weakest cut (the smallest floor(1000000 a a / (l r)); of equal ones the first cut), n all words
    of the lang. Phrases with a < least are left out, as are those inside a longer phrase with 100 * f(longer) >= share * a.
    Order: score, then a, both descending, then phrase in byte order. top=None returns all. Only text and lang are read; a null lang is
    'und', a null or blank text has no words, repeated rows count each time, and langs without such a phrase have no row.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))

    counted = rows.mapInArrow(_word_counts, "lang string, h long, word string, n long").groupBy("lang", "h").agg(
        F.sum("n").alias("a"), F.min("word").alias("word"), F.max("word").alias("other"))
    clash = F.raise_error(F.concat(F.lit("two words share a hash: "), F.col("word"), F.lit(" "), F.col("other")))
    counted = stored(counted.select("lang", "h", F.when(F.col("word") == F.col("other"), F.col("word")).otherwise(clash).alias("word"), "a"), f"{folder}/counted")
    totals = counted.groupBy("lang").agg(F.sum("a").alias("n"))
    words = stored(counted.where(F.col("a") >= least), f"{folder}/words")
    word_ranks = Ranks([(r.lang, r.h) for r in _most_frequent(words, ["h"], ranked)])

    def phrases(size: int, units: Ranks, bits: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((word_ranks, units, bits))
        names = ["h1", "h2", "h3"][:size]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held_words, held_units, held_bits = shared.value
            return _phrase_counts(batches, size, held_words, held_units, held_bits, dense_events)

        found = rows.mapInArrow(count, f"lang string, {', '.join(f'{c} long' for c in names)}, n long")
        return stored(found.groupBy("lang", *names).agg(F.sum("n").alias("a")).where(F.col("a") >= least), f"{folder}/phrases-{size}")

    pairs = phrases(2, word_ranks, _filter_of(words, False))
    best = _most_frequent(pairs, ["h1", "h2"], ranked)
    h1, h2 = (np.array([r[c] for r in best], np.int64).view(np.uint64) for c in ("h1", "h2"))
    pair_ranks = Ranks(list(zip([r.lang for r in best], pair_hash(h1, h2).view(np.int64).tolist())))
    triples = phrases(3, pair_ranks, _filter_of(pairs, True))

    def word(k: int) -> DataFrame:
        return words.select("lang", F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("a").alias(f"f{k}"))

    def pair(k: int) -> DataFrame:
        return pairs.select("lang", F.col("h1").alias(f"h{k}"), F.col("h2").alias(f"h{k + 1}"), F.col("a").alias(f"f{k}{k + 1}"))

    inside = triples.select("lang", "h1", "h2", "a").unionByName(triples.select("lang", F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))
    longer = inside.groupBy("lang", "h1", "h2").agg(F.max("a").alias("longer"))
    free = pairs.join(longer, ["lang", "h1", "h2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    cut = lambda a, left, right, k: F.struct(_score(a, left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
    a = F.col("a")
    two = free.join(word(1), ["lang", "h1"]).join(word(2), ["lang", "h2"]).select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", cut(a, F.col("f1"), F.col("f2"), 1).alias("cut"))
    three = triples.join(word(1), ["lang", "h1"]).join(word(2), ["lang", "h2"]).join(word(3), ["lang", "h3"]).join(
        pair(1), ["lang", "h1", "h2"]).join(pair(2), ["lang", "h2", "h3"]).select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        F.least(cut(a, F.col("f1"), F.col("f23"), 1), cut(a, F.col("f12"), F.col("f3"), 2)).alias("cut"))
    scored = two.unionByName(three).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    placed = scored.withColumn("place", F.row_number().over(order))
    kept = placed if top is None else placed.where(F.col("place") <= top)
    return kept.join(totals, "lang").select("lang", F.col("place").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
