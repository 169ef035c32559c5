"""Token counts that follow edits.

A document's text is cut into pre-tokens (inside which alone a tokenizer merges); runs of ``LEAF`` pre-tokens are
the leaves of a segment tree whose nodes hold sums of tokens. An edit re-encodes only the leaves it touches, one
leaf before them, and as many after them as it takes until a pre-token ends where a leaf ended before; the sums
above the changed leaves are made anew.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF = 64
#: Pre-tokens whose counts a worker remembers; the memory is emptied when full.
REMEMBERED = 400_000
#: Fixed value: how texts are cut before the merges of the public byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PieceCounts(dict):
    """Tokens of a pre-token, looked up or encoded."""

    def __init__(self, ranks_path: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        count = self[piece] = len(self.encoding.encode_ordinary(piece))
        return count


@lru_cache(2)
def _pieces(ranks_path: str) -> PieceCounts:
    return PieceCounts(ranks_path)


@lru_cache(1)
def _cutter():
    import regex

    return regex.compile(PATTERN)


class TokenTree:
    """ends: text position after each leaf; levels: sums of tokens, from the leaves to the root."""

    def __init__(self, text: str, counts: PieceCounts, ends: np.ndarray, leaves: np.ndarray) -> None:
        self.text, self.counts, self.ends, self.encoded = text, counts, ends, 0
        self.levels = self._summed(leaves)

    @staticmethod
    def _summed(leaves: np.ndarray) -> list[np.ndarray]:
        levels = [leaves]
        while len(levels[-1]) > 1:
            low = levels[-1]
            levels.append(np.add.reduceat(low, np.arange(0, len(low), 2)))
        return levels

    @classmethod
    def build(cls, text: str, counts: PieceCounts) -> TokenTree:
        pieces = _cutter().findall(text)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        tokens = np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces))
        heads = np.arange(0, len(pieces), LEAF)
        leaves = np.add.reduceat(tokens, heads) if len(pieces) else np.zeros(0, np.int64)
        return cls(text, counts, ends[np.minimum(heads + LEAF, len(pieces)) - 1] if len(pieces) else ends, leaves)

    @property
    def total(self) -> int:
        return int(self.levels[-1][0]) if len(self.levels[0]) else 0

    def edit(self, start: int, end: int, put: str) -> None:
        """Replace text[start:end]; positions outside the text are moved to its ends."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        first = max(int(np.searchsorted(self.ends, start, "right")) - 1, 0)
        begin = int(self.ends[first - 1]) if first else 0
        last = int(np.searchsorted(self.ends, end, "left"))
        shift = len(put) - (end - start)
        self.text = self.text[:start] + put + self.text[end:]
        ends, leaves, tokens, held = [], [], 0, 0
        resume = len(self.ends)
        for found in _cutter().finditer(self.text, begin):
            tokens += self.counts[found[0]]
            held += 1
            at = found.end()
            while last < len(self.ends) and (self.ends[last] + shift < at or self.ends[last] < end):
                last += 1
            joins = at >= start + len(put) and last < len(self.ends) and self.ends[last] + shift == at and self.ends[last] > end
            if held == LEAF or joins:
                ends.append(at)
                leaves.append(tokens)
                self.encoded += held
                tokens, held = 0, 0
            if joins:
                resume = last + 1
                break
        if held:
            ends.append(len(self.text))
            leaves.append(tokens)
            self.encoded += held
        if not ends and resume == len(self.ends):
            ends, leaves = [], []
        self.ends = np.concatenate([self.ends[:first], np.array(ends, np.int64), self.ends[resume:] + shift])
        new = np.concatenate([self.levels[0][:first], np.array(leaves, np.int64), self.levels[0][resume:]])
        self._replace(new, first, first + len(leaves))

    def _replace(self, leaves: np.ndarray, low: int, high: int) -> None:
        """New leaves low to high; where their number is as before only the sums above these are made anew."""
        if len(leaves) != len(self.levels[0]):
            self.levels = self._summed(leaves)
            return
        self.levels[0] = leaves
        for below, level in zip(self.levels, self.levels[1:]):
            low, high = low // 2, (high + 1) // 2
            pairs = below[2 * low : 2 * high]
            level[low:high] = np.add.reduceat(pairs, np.arange(0, len(pairs), 2)) if len(pairs) else level[low:high]


TREE = "tokens long, leaf_ends array<int>, leaf_tokens array<int>"


def _trees(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[pa.RecordBatch]:
    counts = _pieces(ranks_path)
    for batch in batches:
        trees = [TokenTree.build(x.as_py() or "", counts) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), pa.array([t.total for t in trees], pa.int64()),
             pa.array([t.ends.astype(np.int32) for t in trees], pa.list_(pa.int32())),
             pa.array([t.levels[0].astype(np.int32) for t in trees], pa.list_(pa.int32()))],
            ["doc_id", "text", "tokens", "leaf_ends", "leaf_tokens"])


def count_tokens(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, text, tokens and the leaves of the token tree, for every row of docs.

    Null and empty texts have no leaves and no tokens. ``ranks_path`` is a rank file that all executors can read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lambda x: _trees(x, ranks_path), f"doc_id {kind}, text string, {TREE}")


def _edited(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[pa.RecordBatch]:
    counts = _pieces(ranks_path)
    for batch in batches:
        texts, totals, ends, leaves, encoded = [], [], [], [], []
        edits = batch.column("edits").to_pylist()
        for i, text in enumerate(batch.column("text").to_pylist()):
            old = [np.asarray(batch.column(c)[i].values, np.int64) if batch.column(c)[i].is_valid else np.zeros(0, np.int64) for c in ("leaf_ends", "leaf_tokens")]
            tree = TokenTree(text or "", counts, *old)
            for edit in edits[i] or ():
                if edit is not None:
                    tree.edit(edit["start"] or 0, (edit["start"] or 0) if edit["end"] is None else edit["end"], edit["put"] or "")
            texts.append(tree.text if text is not None or tree.text else None)
            totals.append(tree.total)
            ends.append(tree.ends.astype(np.int32))
            leaves.append(tree.levels[0].astype(np.int32))
            encoded.append(tree.encoded)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(ends, pa.list_(pa.int32())),
             pa.array(leaves, pa.list_(pa.int32())), batch.column("tokens"), pa.array(encoded, pa.int64())],
            ["doc_id", "text", "tokens", "leaf_ends", "leaf_tokens", "tokens_before", "pieces_encoded"])


def recount_tokens(trees: DataFrame, edits: Column, ranks_path: str) -> DataFrame:
    """The rows of count_tokens after edits: text, tokens and leaves anew, tokens_before, pieces_encoded.

    ``edits`` is an array of (start, end, put), applied in order, positions counted in characters of the text as
    the edits before have left it. Null edits change nothing; a null end means an insertion, a null put a deletion.
    """
    kind = trees.schema["doc_id"].dataType.simpleString()
    return trees.withColumn("edits", edits).select("doc_id", "text", "tokens", "leaf_ends", "leaf_tokens", "edits").mapInArrow(
        lambda x: _edited(x, ranks_path), f"doc_id {kind}, text string, {TREE}, tokens_before long, pieces_encoded long")


def revision(text: Column, doc_id: Column) -> Column:
    """Three edits that follow from the row: a phrase goes in, a stretch goes out, a word is replaced."""
    spot = lambda k: F.pmod(F.xxhash64(F.lit(k), doc_id, F.length(text)), F.greatest(F.length(text), F.lit(1)).cast("long")).cast("int")
    edit = lambda at, n, put: F.struct(at.alias("start"), (at + n).alias("end"), F.lit(put).alias("put"))
    return F.array(edit(spot(1), 0, " as revised,"), edit(spot(2), 17, ""), edit(spot(3), 5, "  \nnew"))
