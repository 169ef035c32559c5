"""Language identification by interpolated Kneser-Ney character models, one per language.

Characters become ``SYMBOLS`` symbols: a-z, hashed classes of all other letters, and one blank for runs of
everything else. A model then has at most ``SYMBOLS ** ORDER`` n-grams whatever the corpus, which bounds
what is gathered and broadcast; the counts behind it cover every training document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.frames import shared_folder, stored
from tillwatch.llm.hashing import mixed, text_blocks

ORDER, SYMBOLS = 3, 64
#: Labels beyond this number are an error: the models of all languages are broadcast together.
MAX_LANGUAGES = 256
#: Deviations from a language's usual cross-entropy beyond which a document is rejected.
REJECT_AT = 6.0
#: Symbols like no language that any document may hold (a secret, a name): little in a long text, much in a short one.
STRANGE = 16
#: Held-back documents of a language from which on its deviation stands alone.
ENOUGH = 30
#: Characters' worth of evidence that the score weighs.
SCORE_LENGTH = 20.0
#: Symbols of a piece. Pieces are told each on its own, so a page that mixes known languages is as usual as they are.
PIECE = 64


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for point in range(128, 0x110000):
        if chr(point).isalpha():
            table[point] = 27 + (point * 2654435761 >> 7) % (SYMBOLS - 27)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


def _codes(texts: pa.Array, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n-gram codes of a block's texts in order, number of codes of each text)."""
    for low, high, data, offsets in text_blocks(texts):
        raw = data.tobytes().decode()
        folded = raw.lower()
        if len(folded) == len(raw):
            points = np.frombuffer(folded.encode("utf-32-le"), np.uint32)
            leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            begins = leads[offsets]
        else:
            pieces = [data[a:b].tobytes().decode().lower() for a, b in zip(offsets, offsets[1:])]
            points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
            begins = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        symbols = _symbol_table()[points]
        text = np.repeat(np.arange(high - low), np.diff(begins))
        previous = np.zeros_like(symbols)
        previous[1:] = symbols[:-1]
        previous[begins[:-1][begins[:-1] < len(symbols)]] = 0
        keep = (symbols != 0) | (previous != 0)
        symbols, text = symbols[keep].astype(np.int32), text[keep]
        codes = symbols.copy()
        for back in range(1, order):
            shifted = np.zeros_like(symbols)
            shifted[back:] = np.where(text[back:] == text[:-back], symbols[:-back], 0) if len(symbols) > back else 0
            codes += shifted * SYMBOLS**back
        yield low, codes, np.bincount(text, minlength=high - low)


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for low, codes, sizes in _codes(batch.column("text"), order):
            own = langs[low : low + len(sizes)]
            each = np.repeat(np.arange(len(sizes)), sizes)
            for lang in set(own):
                if lang not in totals:
                    totals[lang] = np.zeros(SYMBOLS**order, np.int64)
                totals[lang] += np.bincount(codes[(own == lang)[each]], minlength=SYMBOLS**order)
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "code", "n"])


def _kneser_ney(counts: np.ndarray) -> np.ndarray:
    """Interpolated probabilities for counts over (symbol,) * m; lower orders count kinds of left contexts."""
    if counts.ndim == 1:
        lower: np.ndarray | float = 1.0 / len(counts)
    else:
        lower = _kneser_ney((counts > 0).sum(0))
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
    total = counts.sum(-1, keepdims=True)
    share = np.where(total > 0, discount * (counts > 0).sum(-1, keepdims=True) / np.maximum(total, 1), 1.0)
    return np.maximum(counts - discount, 0) / np.maximum(total, 1) + share * lower


class LanguageModels:
    """Log probabilities of the n-grams seen, in arrays sorted by the n-gram's hash, and per language the
    weight each context gives to the next lower order, for n-grams that a language has not seen."""

    def __init__(self, counts: dict[str, np.ndarray], order: int) -> None:
        self.order, self.languages = order, sorted(counts)
        size = SYMBOLS**order
        seen = np.flatnonzero(sum((counts[x] > 0 for x in self.languages), np.zeros(size, bool)))
        rank = np.argsort(mixed(seen.astype(np.uint64)))
        self.hashes = mixed(seen.astype(np.uint64))[rank]
        self.logs = np.zeros((len(self.languages), len(seen)), np.float32)
        self.unseen = np.zeros((len(self.languages), size // SYMBOLS), np.float32)
        self.lower = np.zeros((len(self.languages), size // SYMBOLS), np.float32)
        for row, lang in enumerate(self.languages):
            table = counts[lang].reshape((SYMBOLS,) * order)
            self.logs[row] = np.log(_kneser_ney(table).ravel()[seen[rank]])
            below = _kneser_ney((table > 0).sum(0))
            once, twice = (table == 1).sum(), (table == 2).sum()
            discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
            total = table.sum(-1)
            self.unseen[row] = np.log(np.where(total > 0, discount * (table > 0).sum(-1) / np.maximum(total, 1), 1.0)).ravel()
            self.lower[row] = np.log(below).ravel()

    def table(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities (language, code) of distinct codes, by binary search."""
        wanted = mixed(codes.astype(np.uint64))
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        known = self.hashes[at] == wanted
        backed = self.unseen[:, codes // SYMBOLS] + self.lower[:, codes % (SYMBOLS ** (self.order - 1))]
        return np.where(known, self.logs[:, at], backed)


def train(docs: DataFrame, order: int = ORDER, held_back: Column | None = None) -> tuple[LanguageModels, LanguageModels]:
    """Models of every row with text and lang, and models of those not held back.

    A language's counts are at most twice SYMBOLS ** order rows.
    """
    fold = F.when(F.lit(False) if held_back is None else held_back, "1").otherwise("0")
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.concat(fold, F.col("lang").cast("string")).alias("lang"))
    counts = labelled.mapInArrow(lambda x: _counted(x, order), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    every: dict[str, np.ndarray] = {}
    rest: dict[str, np.ndarray] = {}
    for row in counts.toLocalIterator():
        lang = row.lang[1:]
        for tables in (every, rest) if row.lang[0] == "0" else (every,):
            if lang not in tables:
                if len(tables) == MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                tables[lang] = np.zeros(SYMBOLS**order, np.int64)
            tables[lang][row.code] += row.n
    return LanguageModels(every, order), LanguageModels(rest, order)


def _scored(batches: Iterator[pa.RecordBatch], models: LanguageModels) -> Iterator[pa.RecordBatch]:
    count = len(models.languages)
    for batch in batches:
        n = batch.num_rows
        best, score = np.full(n, -1), np.zeros(n)
        size, n_pieces = np.zeros(n, np.int64), np.zeros(n, np.int64)
        entropy, pieced, square_of = np.zeros(n), np.zeros(n), np.zeros(n)
        for low, codes, sizes in _codes(batch.column("text"), models.order):
            letters = np.add.reduceat(np.append(codes % SYMBOLS > 0, False), np.minimum(np.cumsum(sizes) - sizes, len(codes))) * (sizes > 0)
            rows = np.flatnonzero((sizes > 0) & (letters > 0))
            if not len(rows) or not count:
                size[low : low + len(sizes)] = letters
                continue
            begins = (np.cumsum(sizes) - sizes)[sizes > 0]
            filled = np.flatnonzero(sizes > 0)
            distinct = np.flatnonzero(np.bincount(codes, minlength=1))
            place = np.zeros(distinct[-1] + 1, np.int32)
            place[distinct] = np.arange(len(distinct))
            at, logs = place[codes], models.table(distinct)
            sums = np.zeros((count, len(sizes)))
            pieces = np.maximum(sizes[filled] // PIECE, 1)
            first = np.cumsum(pieces) - pieces
            which = np.arange(pieces.sum()) - np.repeat(first, pieces)
            cuts = np.repeat(begins, pieces) + which * np.repeat(sizes[filled], pieces) // np.repeat(pieces, pieces)
            lengths = np.diff(np.append(cuts, len(codes)))
            bits = np.stack([np.add.reduceat(logs[lang][at].astype(np.float64), cuts) for lang in range(count)])
            sums[:, filled] = np.add.reduceat(bits, first, axis=1)
            told = -bits.max(0)
            whole, square = np.zeros(len(sizes)), np.zeros(len(sizes))
            whole[filled] = np.add.reduceat(told, first)
            square[filled] = np.add.reduceat(told * told / lengths, first)
            each = -sums[:, rows] / sizes[rows]
            pick = each.argmin(0)
            least = each[pick, np.arange(len(rows))]
            best[low + rows], entropy[low + rows] = pick, least
            score[low + rows] = 1 / np.exp(-SCORE_LENGTH * (each - least)).sum(0)
            pieced[low + rows], square_of[low + rows] = whole[rows] / sizes[rows], square[rows]
            parts = np.zeros(len(sizes), np.int64)
            parts[filled] = pieces
            n_pieces[low + rows] = parts[rows]
            size[low : low + len(sizes)] = np.where(letters > 0, sizes, 0)
        names = pa.array([models.languages[k] if k >= 0 else "und" for k in best], pa.string())
        rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        yield pa.RecordBatch.from_arrays(
            [*rest, names, pa.array(score), pa.array(entropy), pa.array(pieced), pa.array(square_of), pa.array(n_pieces), pa.array(size)],
            [*[x for x in batch.schema.names if x != "text"], "lang_pred", "score", "entropy", "pieced", "squares", "pieces", "size"])


def held_out(doc_id: str = "doc_id") -> Column:
    """One fifth of the ids by their CRC; a null id is not held out (and not learned from either)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def held_back(doc_id: str = "doc_id") -> Column:
    """Another fifth of the ids, learned from, and told by models without them to calibrate the rejection."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _usual(told: DataFrame) -> dict[str, tuple[float, float, float, int]]:
    """Of rows told right: language to mean, variance between documents, variance of a symbol's share in pieces, documents."""
    size = F.col("size")
    sums = told.where("size > 0 AND lang = lang_pred").groupBy("lang_pred").agg(
        F.sum(size).alias("n"), F.sum(F.col("pieced") * size).alias("one"), F.sum(F.col("pieced") ** 2 * size).alias("two"),
        F.sum("squares").alias("squares"), F.sum("pieces").alias("pieces"), F.count("*").alias("docs"))
    out = {}
    for r in sums.toLocalIterator():
        mean = r["one"] / r["n"]
        out[r["lang_pred"]] = (mean, max(r["two"] / r["n"] - mean**2, 0.0), max(r["squares"] - mean**2 * r["n"], 0.0) / r["pieces"], r["docs"])
    return out


def _limits(held: dict, seen: dict) -> dict[str, tuple[float, float, float]]:
    """Language to mean, variance between documents, variance within: as held back, and at least as in training.

    A language with few documents held back deviates at least as the languages do on average.
    """
    docs = sum(x[3] for x in held.values())
    usual = [sum(x[k] * x[3] for x in held.values()) / docs if docs else 0.0 for k in (1, 2)]
    out = {}
    for lang in seen.keys() | held.keys():
        both = [x[lang] for x in (held, seen) if lang in x]
        few = lang not in held or held[lang][3] < ENOUGH
        between, within = (max([x[k] for x in both] + [usual[k - 1]] * few) for k in (1, 2))
        out[lang] = (both[0][0], between, within)
    return out


def identify_languages(docs: DataFrame, order: int = ORDER, reject_at: float = REJECT_AT) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, accepted (and text_hash) for every row of docs.

    Models are learned from text and lang of rows with an id that is not held out; a prediction sees the text
    alone. lang_pred has the lowest cross-entropy per character, "und" (score 0) where text is null or has no
    letter. score weighs the entropies of all languages to a share between 0 and 1. A row is accepted unless it
    is "und" or its piecewise entropy (each piece told on its own) lies more than ``reject_at`` deviations above
    its language's mean, besides what STRANGE symbols of any kind add. Mean and deviation (between documents, and
    between pieces over the length) are measured on training rows held back from the models that tell them, where
    a language has such rows told right. Without any labelled row nothing can be told: "und" for all, and all with
    a letter are accepted.
    """
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out().alias("held_out"))
    learned = known.where("doc_id IS NOT NULL AND NOT held_out")
    models, others = (spark.sparkContext.broadcast(x) for x in train(learned, order, held_back()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = "lang_pred string, score double, entropy double, pieced double, squares double, pieces long, size long"
    scored = stored(
        known.select("doc_id", "held_out", F.xxhash64("text").alias("text_hash"), "lang", "text")
        .mapInArrow(lambda x: _scored(x, models.value), f"doc_id {kind}, held_out boolean, text_hash long, lang string, {told}"),
        f"{shared_folder(spark)}/scored")
    aside = learned.where(held_back()).select("lang", "text").mapInArrow(lambda x: _scored(x, others.value), f"lang string, {told}")
    limits = _limits(_usual(aside), _usual(scored.where("doc_id IS NOT NULL AND NOT held_out")))
    accepted = F.col("size") > 0
    for lang, (centre, between, within) in limits.items():
        limit = (F.lit(centre) + reject_at * F.sqrt(F.lit(between) + F.lit(within) / F.col("size"))
                 + F.least(F.lit(STRANGE), F.col("size")) / F.col("size") * max(float(np.log(SYMBOLS)) - centre, 0.0))
        accepted = F.when(F.col("lang_pred") == lang, (F.col("size") > 0) & (F.col("pieced") <= limit)).otherwise(accepted)
    return scored.select("doc_id", "held_out", "lang_pred", "score", "entropy", accepted.alias("accepted"), "text_hash")
