"""Every stage of the pipeline against brute force on what the stage before kept."""

import collections
import re

from pyspark.sql import functions as F
from test_text_operators import FOLD, SF, WORD, components

import corpus_pipeline
from tillwatch.llm.frames import shared_folder, stored


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(FOLD)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == i) for i, t in rows}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "src0", 0), (-3, "12 34", "en", None, 5), (-4, "The and of the thing. " * 8, "en", None, 9)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    now = docs.unionByName(odd)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "minhash_near_dedup", "decontamination", "source_mixing"]
    folder = shared_folder(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in now.collect()]
        columns = now.columns
        now = stored(stage(spark, now, SF), f"{folder}/{name}")
        after = {r.doc_id: r for r in now.collect()}
        kept[name] = after
        if name != "source_mixing":
            assert now.columns == columns
        if name == "language_id":
            assert set(after) == {i for i, _ in before} - {-1, -2, -3}
        elif name == "line_dedup":
            assert {i: r.text for i, r in after.items()} == brute_lines(before)
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "minhash_near_dedup":
            assert sorted(repr(i) for i in after) == sorted(i for i, _, _, own in components(before) if own)
        elif name == "decontamination":
            norm = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
            items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {i for i, t in before if not any(f" {x} " in f" {norm(t)} " for x in items)}
        else:
            words = {i: len(WORD.findall(t or "")) for i, t in before}
            assert all(r.size == words[i] and r.taken == r.copies * r.size and 1 <= r.copies <= 2 for i, r in after.items())
            assert abs(now.agg(F.sum("taken")).first()[0] - 1.5 * sum(words.values())) <= 0.02 * 1.5 * sum(words.values())


def test_empty_table(spark, no_docs):
    now = no_docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0
