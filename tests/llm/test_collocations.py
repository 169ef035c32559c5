"""Collocations against SQL on the given tables and brute force on made texts."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from compare import connect, differences

from tillwatch.llm import collocations as C
from tillwatch.llm.queries import OP12_SQL, op12_phrase_collocations

SF = "/root/testdata/sf0.001"


def brute(rows, least=10, share=50, top=None):
    words, phrases, totals = Counter(), Counter(), Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    phrases[lang, tuple(w[i : i + k])] += 1
    found = {}
    for (lang, p), a in phrases.items():
        if len(p) < 2 or a < least:
            continue
        longer = max((n for (other, q), n in phrases.items() if other == lang and len(q) == 3 > len(p) and p in (q[:2], q[1:])), default=0)
        if 100 * longer >= share * a:
            continue
        cuts = [((10**6 * a * a) // (phrases[lang, p[:k]] * phrases[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), phrases[lang, p[:k]], phrases[lang, p[k:]]))
    out = []
    for lang, all_of in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(all_of)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_with_phrases(seed, n=260):
    rng = random.Random(seed)
    names = ["Alpha", "beta", "gämma", "Δelta", "É", "é", "x\x0by", "zz"] + [f"w{k}" for k in range(30)]
    rows = []
    for k in range(n):
        out = []
        for _ in range(rng.randrange(40)):
            out.append(rng.choice(["alpha beta gämma", "ALPHA Beta", "w1 w2", "zz zz zz zz", rng.choice(names), rng.choice(names)]))
            out.append(rng.choice([" ", " ", "\t ", ". ", ",", "\n"]))
        rows.append(("".join(out), ("xx", "yy", None, "xx")[k % 4]))
    return rows + [(None, "xx"), ("", "zz"), (" ,; ", "zz"), ("one two", "rare"), *[("Same text here", "xx")] * 12]


@pytest.mark.parametrize(("ranked", "dense"), [(16_384, 20_000), (5, 1), (100, 3)])
def test_equals_brute_force(spark, ranked, dense):
    rows = rows_with_phrases(ranked)
    docs = spark.createDataFrame([(n, t, g, n, "h") for n, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, n long, word string").repartition(3)
    got = C.collocations(docs, top=None, ranked=ranked, dense_events=dense)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    few = C.collocations(docs, least=5, share=80, top=4, ranked=ranked, dense_events=dense)
    assert sorted(map(tuple, few.collect())) == brute(rows, 5, 80, 4)


def test_query_equals_sql(spark):
    assert differences(spark, connect(SF), SF, op12_phrase_collocations, OP12_SQL) == []


def test_sql_equals_brute_force(tmp_path):
    rows = rows_with_phrases(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    assert sorted(con.execute(OP12_SQL).fetchall()) == brute(rows, top=2000)


def test_tables_without_phrases(spark, no_docs):
    assert C.collocations(no_docs).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None), (2, "a b", "x")], "doc_id long, text string, lang string")).count() == 0


def test_products_beyond_64_bits(spark):
    big = spark.sql("SELECT 4000000000000L AS a, 5000000000000L AS l, 4000000000001L AS r")
    got = big.select(C._score(big.a, big.l, big.r)).first()[0]
    assert got == 10**6 * 4000000000000**2 // (5000000000000 * 4000000000001)


def test_a_shared_unit_hash_keeps_counts_apart():
    left, right = np.array([7, 7, 7, 7], np.uint64), np.array([9, 9, 9, 9], np.uint64)
    parts = [np.array([1, 2, 1, 1], np.uint64), np.array([3, 3, 3, 3], np.uint64), np.array([9, 9, 9, 9], np.uint64)]
    units, words = C.Ranks([("xx", 7)]), C.Ranks([("xx", 9)])
    keys, n = C.tiled_counts("xx", left, right, units, words, parts, dense_events=1)
    summed = Counter()
    for key, count in zip(zip(*(k.tolist() for k in keys)), n.tolist()):
        summed[key] += count
    assert summed == {(1, 3, 9): 3, (2, 3, 9): 1}
