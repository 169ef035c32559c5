"""Operators on documents against brute force, on odd rows and on empty tables."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tillwatch.llm.decontamination import contaminated
from tillwatch.llm.language import _codes, _kneser_ney, identify_languages
from tillwatch.llm.lines import LineRuns, dedup_lines
from tillwatch.llm.minhash import near_duplicates
from tillwatch.llm.queries import QUERIES, SQL
from tillwatch.llm.substrings import dedup_substrings

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(FOLD))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return sorted([(repr(i), len(s), repr(None if i is None else root(i)), i is None or root(i) == i) for i, s in sets])


def test_near_duplicates_equal_brute_force(odd_docs, odd_rows):
    got = near_duplicates(odd_docs).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in got) == components(odd_rows)


def test_crowd_of_near_copies_that_do_not_all_link(spark):
    """Copies with many edits around one text: some link, some only through others, some not at all."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for k in range(90):
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(150)] = f"e{rng.randrange(9000)}"
        rows.append((k, " ".join(own)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in got) == components(rows)


@pytest.mark.parametrize("block", [4, 800])
def test_lists_that_join_several_crowds(spark, block):
    """Families of near copies around one passage: close enough to be candidates of one another, not to link but for a few."""
    rng = random.Random(11)
    passage, rows = [f"p{k}" for k in range(100)], []
    for family in range(12):
        own = [f"f{family}x{k}" for k in range((60, 45, 20)[family % 3])]
        for _ in range(7):
            text = passage + own
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(9000)}"
            rows.append((len(rows), " ".join(text)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    want = components(rows)
    assert 2 < len({r[2] for r in want}) < 30
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in got) == want


def brute_repeats(rows, length=20):
    seen, order = {}, sorted({(i, t) for i, t in rows if i is not None}, key=lambda x: x[0])
    removed = {}
    for i, t in order:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            key = tuple(words[s : s + length])
            first = seen.setdefault(key, (i, s, t))
            if first != (i, s, t):
                gone[s : s + length] = [True] * length
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        removed[i, t] = (len(words), sum(gone), kept)
    return removed


def test_substrings_equal_brute_force(odd_docs, odd_rows):
    expected = brute_repeats(odd_rows)
    got = dedup_substrings(odd_docs).collect()
    assert len(got) == len(odd_rows)
    left = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got if r.doc_id not in (None, 46))
    right = collections.Counter((i, *expected[i, t]) for i, t in odd_rows if i not in (None, 46))
    assert left == right
    nulls = sorted((r.n_words, r.n_removed) for r in got if r.doc_id is None)
    assert nulls == [(25, 0), (120, 120)]
    for r in got:
        assert sum(s.end - s.first for s in r.removed) == r.n_removed


def test_lines_equal_brute_force(odd_docs, odd_rows):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(FOLD)
    owner, holders = {}, collections.defaultdict(set)
    rank = lambda i: (i is None, i or 0)
    for i, t in odd_rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
                if key(line) not in owner or rank(i) < rank(owner[key(line)]):
                    owner[key(line)] = i
    right = collections.Counter()
    for i, t in odd_rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
        right[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    for batches, fanout in ((4, 3), (7, 2)):
        got = dedup_lines(odd_docs, batches=batches, fanout=fanout)
        assert got.columns == [*odd_docs.columns, "__n_lines", "__n_dropped"]
        assert collections.Counter((r.doc_id, r.text, r["__n_lines"], r["__n_dropped"]) for r in got.collect()) == right


def test_runs_compact_in_levels(spark, tmp_path):
    runs = LineRuns(spark, str(tmp_path), fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(k, 1, 1), (k, 2, k)], "doc_id long, h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(map(tuple, runs.owners().collect())) == [(1, 1, 0), (2, 0, 0), (2, 1, 1), (2, 2, 2), (2, 3, 3), (2, 4, 4)]
    runs.forget()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    from compare import connect, differences

    assert differences(spark, connect(SF), SF, QUERIES[name], SQL[name]) == []


def test_planted_passages_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((40, 30, 14, 60, 7, 3))] + [(9, None), (10, "")]
    sub = items[0][1].split()
    for at in (5, 13, 22, 31):
        sub[at] = "zz"
    rows = [
        (1, f"{text(50)} {items[0][1].upper()}. {text(9)}"), (2, f"{text(30)} {' '.join(sub)} {text(30)}"),
        (3, f"{text(20)}\n{items[2][1]}"), (4, f"{text(10)} {' '.join(items[3][1].split()[20:45])}, {text(8)}"),
        (5, f"{text(6)}, {items[4][1].replace(' ', '-')}! {text(6)}"), (6, f"{text(9)} {items[5][1]} {text(9)}"),
        (7, text(3000)), (8, None), (9, ""), (10, f"{items[1][1]} {text(5)} {items[3][1]}"), (None, items[1][1]),
        (11, " ".join(items[1][1].split()[:6])), (1, f"{text(50)} {items[0][1]}")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items + items[:1], "item_id long, text string")
    got = contaminated(docs, benchmark).collect()
    assert collections.Counter((r.doc_id, r.item_id) for r in got) == collections.Counter(
        [(1, 0), (1, 0), (2, 0), (3, 2), (4, 3), (5, 4), (10, 1), (10, 3), (None, 1)])
    assert {(r.doc_id, r.n_matched) for r in got if r.doc_id in (2, 4)} == {(2, 36), (4, 25)}
    assert contaminated(docs.limit(0), benchmark).count() == contaminated(docs, benchmark.limit(0)).count() == 0


def test_clustered_substitutions_equal_brute_force(spark):
    """Whatever the pattern of equal and replaced tokens, an overlap is any stretch that meets the rule."""
    rng = random.Random(3)
    patterns = [(12, 4, 12), (10, 4, 10), (12, 5, 12), (6, 2, 6, 2, 6), (12, 4, 12, 4, 12), (12, 4) * 8, (9, 4, 9), (8, 8, 8), (7, 5, 7, 5, 7)]
    patterns += [tuple(rng.randrange(1, 12) if k % 2 == 0 else rng.randrange(1, 6) for k in range(rng.choice([3, 5, 7]))) for _ in range(60)]
    items, docs, expected = [], [], set()
    for i, pattern in enumerate(patterns):
        same = [k % 2 == 0 for k, n in enumerate(pattern) for _ in range(n)]
        if not any(n >= 6 for n in pattern[::2]):
            continue
        words = [f"i{i}w{k}" for k in range(len(same))]
        items.append((i, " ".join(words)))
        docs.append((i, "before it " + " ".join(w if x else f"x{w}" for w, x in zip(words, same)) + " and after"))
        least = min(13, math.ceil(0.8 * len(same)))
        if any(sum(same[a:b]) >= max(least, 0.75 * (b - a)) for a in range(len(same)) for b in range(a + 1, len(same) + 1)):
            expected.add((i, i))
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(docs, items).collect()
    assert {0, 1, 2, 3, 4, 5} <= {i for i, _ in expected} and len(expected) < items.count()
    assert {(r.doc_id, r.item_id) for r in got} == expected
    assert all(r.n_matched >= 0.75 * (r.end_token - r.first_token) for r in got)


def test_contaminated_query_finds_every_verbatim_item(spark):
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = {r.doc_id for r in docs if any(f" {x} " in f" {norm(r.text)} " for x in items)}
    assert {r.doc_id for r in QUERIES["op1_decontamination"](spark, SF).collect()} == expected


def test_language_models_are_distributions(odd_rows):
    import numpy as np

    counts = np.random.default_rng(1).integers(0, 4, (9, 9, 9))
    assert np.allclose(_kneser_ney(counts).sum(-1), 1)


def test_codes_do_not_cross_texts():
    import pyarrow as pa

    alone = [list(c) for t in ("Abc  d", "", "éÀ1x", "İx") for _, c, _ in _codes(pa.array([t]), 3)]
    ((_, codes, sizes),) = _codes(pa.array(["Abc  d", "", "éÀ1x", "İx"]), 3)
    assert list(codes) == [c for own in alone for c in own] and list(sizes) == [len(x) for x in alone]


def test_languages_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = spark.createDataFrame([(-1, "qzxjkvqw xkjzq " * 40, None), (-2, "password=101a821562d3999d51 At anining as a.", None)], "doc_id long, text string, lang string")
    every = identify_languages(docs.select("doc_id", "text", "lang").unionByName(junk)).cache()
    assert {r.doc_id for r in every.where("NOT accepted").collect()} == {-1}
    found = every.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert found.where("score < 0 OR score > 1").count() == 0


@pytest.mark.parametrize("left_out", ["en", "es"])
def test_a_language_never_learned_is_rejected_and_the_others_stay(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.when(F.col("lang") != left_out, F.col("lang")).alias("lang"))
    secret = spark.createDataFrame([(-2, "password=101a821562d3999d51 Und der die das.", None)], "doc_id long, text string, lang string")
    got = identify_languages(docs.unionByName(secret)).join(docs.select("doc_id", "lang"), "doc_id", "left")
    shares = {(r.own, r.accepted): r["count"] for r in got.groupBy((F.col("lang").isNotNull() | (F.col("doc_id") < 0)).alias("own"), "accepted").count().collect()}
    strange = shares.get((False, True), 0), shares[(False, False)]
    assert strange[0] <= 0.02 * sum(strange)
    assert shares.get((True, False), 0) <= 0.02 * shares[(True, True)]
    assert got.where("doc_id = -2").first().accepted


def test_languages_of_odd_rows(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(
        [(k, f"{'the cat sat on the mat and ran ' if k % 2 else 'der hund lief in den wald hinein '}{k}", "en" if k % 2 else "de") for k in range(60)]
        + [(60, None, "en"), (61, "", None), (62, "12 34 !", None), (63, "the mat and the cat", None), (None, "der wald und der hund", "en"), (64, "qzxjkvq" * 40, None)],
        "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify_languages(docs).collect()}
    assert [got[k].lang_pred for k in (60, 61, 62, 63, None)] == ["und", "und", "und", "en", "de"]
    assert [got[k].accepted for k in (60, 61, 62, 63, 64)] == [False, False, False, True, False]
    assert got[60].score == 0 and got[None].held_out is False
    assert identify_languages(odd_docs).count() == odd_docs.count()
    assert identify_languages(no_docs).count() == 0
    unlabelled = identify_languages(docs.where("doc_id >= 60").withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"} and sum(r.accepted for r in unlabelled) == 2


def test_empty_tables(no_docs):
    assert near_duplicates(no_docs).count() == 0
    assert dedup_lines(no_docs).count() == 0
    assert dedup_substrings(no_docs).count() == 0


def test_digest_of_kept_words(spark):
    docs = spark.createDataFrame([(1, " a\tb  c "), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in dedup_substrings(docs).collect()}
    assert hashlib.sha256(got[1].encode()).hexdigest() == hashlib.sha256(b"a b c").hexdigest() and got[2] == ""
