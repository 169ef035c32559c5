"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tillwatch.llm.queries import op11_periodic_runs
from tillwatch.llm.runs import periodic_runs, runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapsed(words: list[str], runs) -> str:
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng: random.Random, n: int, letters: int) -> list[int]:
    """A sequence with nested and adjacent repetitions."""
    out: list[int] = []
    while len(out) < n:
        block = [rng.randrange(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 21, 40]))]
        if rng.random() < 0.4:
            block = block[: len(block) // 2 + 1] * rng.choice([4, 5, 9]) + block
        times = rng.choice([1, 1, 2, 3, 4, 5, 7])
        out += block * times + block[: rng.randrange(len(block) + 1)]
        if rng.random() < 0.2 and out:
            out[rng.randrange(len(out))] = rng.randrange(letters)
    return out[:n]


@pytest.mark.parametrize("letters", [2, 3, 50])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    code = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 63, letters, dtype=np.uint64)
    for _ in range(150):
        words = periodic(rng, rng.choice([0, 1, 5, 6, 7, 8, 30, 200, 700]), letters)
        assert runs_of(code[np.array(words, int)], len(words)) == brute_runs(words)


def test_long_periods():
    rng = np.random.Generator(np.random.PCG64(4))
    block = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    block[100:700] = np.tile(block[100:112], 50)
    line = np.concatenate([rng.integers(0, 1 << 63, 777, dtype=np.uint64), np.tile(block, 4), block[:5]])
    assert (777, 4005, 1000) in runs_of(line, len(line))
    assert len(runs_of(line, len(line))) == 5
    assert runs_of(line[: 777 + 3999], len(line)) == [(777 + 1000 * k + 100, 600, 12) for k in range(4)]


def test_operator_on_odd_documents(spark, odd_docs, odd_rows, no_docs):
    rows = [*odd_rows, (50, "a b c d " * 300 + "x"), (51, "na\tna\n" * 3), (52, "é è " * 4 + "é"), (53, "z " * 5)]
    docs = spark.createDataFrame([(i, t, n, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, runs int, start int")
    want = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        runs = brute_runs(words)
        want.append((doc_id, len(words), runs, brute_collapsed(words, runs)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs(no_docs).count() == 0


def test_query_equals_brute_force(spark, tmp_path, odd_rows):
    rng = random.Random(8)
    rows = [(i, t) for i, t in odd_rows if i is not None]
    rows += [(100 + k, " ".join(f"w{x}" for x in periodic(rng, rng.randrange(120), 6))) for k in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(brute_collapsed(words, runs))))
    assert sum(1 for row in want if row[1]) > 20
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
