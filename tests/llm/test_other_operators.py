"""Vectors, mixing, archives, chats and token counts against brute force and round trips."""

import base64
import hashlib
import io
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwatch.llm import archives, chat
from tillwatch.llm.mixing import mix_by_source, mix_sources, route, source_targets
from tillwatch.llm.queries import QUERIES, RANKS
from tillwatch.llm.token_counts import PieceCounts, TokenTree, count_tokens, recount_tokens, revision
from tillwatch.llm.vector_graph import audit_recall, near_vectors

SF = "/root/testdata/sf0.001"


# vectors


def brute_vectors(rows, cosine=0.95):
    fine = [(i, np.array(v, float) / np.abs(v).max()) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations({i: (i, v) for i, v in fine}.values(), 2):
        if len(x) == len(y) and x @ y >= cosine * np.linalg.norm(x) * np.linalg.norm(y):
            links[a] += 1
            links[b] += 1
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return sorted((repr(i), links[i] if i is not None else 0, repr(None if i is None else root(i))) for i, _ in rows)


@pytest.mark.parametrize("shard_rows,block_rows", [(400, 2000), (30, 25)])
def test_vectors_equal_brute_force(spark, shard_rows, block_rows):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(150)]
    for k in range(150, 260):
        rows.append((k, (np.array(rows[k % 9][1]) + rng.normal(size=16) * 0.08).tolist()))
    rows += [(300, rows[3][1]), (301, [2 * x for x in rows[3][1]]), (302, None), (303, []), (304, [0.0] * 16), (305, [float("nan")] * 16),
             (306, [None] + rows[3][1][1:]), (307, [1.0, 2.0]), (308, [2.0, 4.0]), (309, [1e-200, 2e-200]), (310, [1e200, 2e200]), (None, rows[3][1]), (5, rows[5][1])]
    table = spark.createDataFrame([(i, v, k % 3) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = near_vectors(table, shard_rows=shard_rows, block_rows=block_rows)
    assert sorted((repr(r.vec_id), r.n_links, repr(r.component_id)) for r in got.collect()) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())
    assert near_vectors(table.limit(0)).count() == 0


def test_recall_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert audit_recall(table, near_vectors(table)) >= 0.99


def test_recall_in_a_large_group(spark):
    """A third of the rows are distinct near copies, more than the shards that one vector visits can hold."""
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(30_000, 32)).astype(np.float32)
    rows[::3] = rows[0] + 0.15 * rng.normal(size=(10_000, 32))
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(30_000), "embedding": list(rows)}), "vec_id long, embedding array<float>").repartition(8)
    result = near_vectors(table).cache()
    assert audit_recall(table, result, every=50) >= 0.97
    assert result.where("n_links > 0").agg(F.count_distinct("component_id")).first()[0] == 1


# mixing


def test_targets_stop_and_reshare():
    sizes = {"a": 100, "b": 10, "c": 1000, None: 50, "e": 0}
    targets = source_targets(sizes, (3, 1, 2), 1.5, 2)
    assert targets["a"] == 200 and targets["e"] == 0 and math.isclose(sum(targets.values()), 1740)
    assert all(t <= 2 * sizes[s] + 1e-9 for s, t in targets.items())


def test_flow_is_largest_and_repeats_least():
    """Against all whole flows of small networks."""
    rng = random.Random(4)
    for _ in range(40):
        patterns = {p: rng.randrange(0, 4) for p in [("a",), ("b",), ("a", "b")]}
        quotas = {"a": rng.randrange(0, 7), "b": rng.randrange(0, 7)}
        given = route(patterns, quotas, 2)
        best = None
        for x, y, za, zb in itertools.product(range(9), repeat=4):
            own = {("a",): x, ("b",): y, ("a", "b"): za + zb}
            if any(own[p] > 2 * patterns[p] for p in own) or x + za > quotas["a"] or y + zb > quotas["b"]:
                continue
            score = (sum(own.values()), -sum(max(0, own[p] - patterns[p]) for p in own))
            best = max(best or score, score)
        assert (sum(given.values()), -sum(max(0, given[p] - patterns[p]) for p in given)) == best


def test_mix_meets_targets(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.col("source")))
    first = mix_by_source(docs)
    rows = first.collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, mix_by_source(docs.repartition(7)).collect()))
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert all(r.size == words[r.doc_id] and r.taken in (0, r.size, 2 * r.size) for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target
    assert mix_by_source(odd_docs).count() == odd_docs.count() and mix_by_source(no_docs).count() == 0


@pytest.mark.parametrize("made", [False, True])
def test_small_sources_come_within_one_remaining_document(spark, made):
    """What a source lacks of its target is less than any document it could still take; very long documents leave no hole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if made:
        rows = [(k, "w " * 50, "a") for k in range(200)] + [(1000 + k, "w " * 6000, "a") for k in range(3)] + [(2000 + k, "w " * (k + 1), "b") for k in range(9)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by_source = {}
    for r in mix_by_source(docs).collect():
        by_source.setdefault(r.source, []).append(r)
    for own in by_source.values():
        lacking = own[0].target - sum(r.taken for r in own)
        left = [r.size for r in own if r.size and r.copies < 2]
        assert abs(lacking) <= max(min(left, default=0) + 1, 0.005 * own[0].target)


def test_mix_of_overlapping_sources(spark):
    docs = spark.createDataFrame([(k, f"w{k} " * 10, [["a"], ["b"], ["a", "b"], [], None][k % 5]) for k in range(200)], "doc_id long, text string, s array<string>")
    rows, sizes, targets = mix_sources(docs, F.col("s"), weights=(1, 1), share=0.5)
    assert sizes == {"a": 800, "b": 800} and targets == {"a": 400.0, "b": 400.0}
    assert rows.agg(F.sum("taken")).first()[0] == 800 and rows.where("pattern = '[]' AND copies > 0").count() == 0


# archives


def test_pages_round_trip(spark):
    tricky = "<x>WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n y é\n1 0 filedesc://"
    rows = [(4, "http://a b\n", tricky), (-5, "http://c", tricky), (7, None, None), (8, "u", ""), (9, "u", "<p>" * 70_000), (None, "u", "q"), (None, "v", tricky), (4, "http://a b\n", tricky)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    got = archives.archived(pages).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {sha(tricky): -5, sha(""): 7}
    expected = sorted(repr((i, len((t or "").encode()), sha(t), "revisit" if first.get(sha(t), i) != i else "response", first[sha(t)] if first.get(sha(t), i) != i else None)) for i, _, t in rows)
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == expected
    assert all(r.intact for r in got)
    assert all(r.record_type == "response" for r in archives.archived(pages, least_revisit=10**9).collect())
    assert archives.archived(pages.limit(0)).count() == 0


def test_page_query(spark):
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    expected = {r.page_id: (len((r.html or "").encode()), sha(r.html)) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in QUERIES["op5_warc"](spark, SF).collect()} == expected


def test_arc_versions_and_damage():
    for version in ("1", "2"):
        document = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\nfiledesc://"
        good = archives.arc_record(version, "http://x/y z", "20010203040506", document, "n.arc")
        text = f"{archives.arc_opening(version, 'n.arc', '20010203000000')}\n{good}\nnot a header\n{good}\n{good[:-5]}"
        found = list(archives.arc_records(io.BytesIO(text.encode())))
        whole = [r for r in found if r.get("document") == document]
        assert len(whole) == 2 and whole[0]["url"] == "http://x/y z" and whole[0]["date"] == "20010203040506"
        assert found[1]["error"].startswith("no header line") and found[-1]["error"].endswith("bytes")
    assert list(archives.arc_records(io.BytesIO(b"")))== []


def test_record_ids_hold_page_numbers():
    for number in (0, 5, -1, 2**63 - 1, -(2**63), None):
        identifier = archives.record_id(number, "u", "d")
        assert archives.page_of(identifier) == number and identifier[24] == "8"
    assert archives.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and archives.warc_date("x") == "1970-01-01T00:00:00Z"


# chats


def test_escapes_are_reversible():
    rng = random.Random(6)
    pieces = [*chat.CONTROL, "\\", "<", "|", "[", "a", "s>", "/INST]", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        masked = chat.escaped(text)
        assert chat.unescaped(masked) == text and not any(c in masked for c in chat.CONTROL)
        formatted, spans = chat.rendered([(text, "x"), ("assistant", text)])
        assert chat.turns_of(formatted) == [(text, "x"), ("assistant", text)]
        assert chat.unescaped("".join(formatted[a:b] for a, b in spans)) == ("x" if text == "assistant" else "") + text


def test_event_log_is_folded(spark):
    log = [
        (1, 1, "m1", "message", "user", "hel"), (1, 2, "m1", "delta", None, "lo"), (1, 3, "m2", "message", "assistant", None), (1, 4, "m2", "delta", None, "bad"),
        (1, 5, "m2", "regenerate", None, None), (1, 6, "m2", "delta", None, "go"), (1, 7, "m2", "delta", None, "od"), (1, 8, "m1", "edit", None, "hi"),
        (1, 9, "m3", "message", "user", "gone"), (1, 10, "m3", "delete", None, None), (1, 11, "m4", "what", None, "?"),
        (2, 1, "m1", "delta", None, None), (None, 1, "z", "message", None, "n")]
    events = spark.createDataFrame(log, "conv_id long, seq long, message string, kind string, role string, text string").repartition(5)
    got = {r.conv_id: r for r in chat.format_chats(events, ["seq"]).collect()}
    assert chat.turns_of(got[1].formatted) == [("user", "hi"), ("assistant", "good"), ("", "")]
    assert [got[1].formatted[s.start : s.end] for s in got[1].loss] == ["good"]
    assert chat.turns_of(got[2].formatted) == [("", "")] and chat.turns_of(got[None].formatted) == [("", "n")]
    assert chat.format_chats(events.limit(0), ["seq"]).count() == 0


def test_chat_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    expected = {}
    for conv, own in itertools.groupby(sorted(rows), lambda r: r[0]):
        own = list(own)
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        expected[conv] = (len(own), hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op6_chat_formatting"](spark, SF).collect()}
    assert got == expected


def test_rows_that_share_a_turn(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 1, None, None), (None, 0, "user", "x")]
    got = {r.conv_id: chat.turns_of(r.formatted) for r in chat.format_chats(chat.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), chat.ORDER).collect()}
    assert got == {1: [("system", "s"), ("user", "a"), ("user", "a"), ("user", "b"), ("", "")], None: [("user", "x")]}


# token counts


def test_trees_follow_edits():
    counts = PieceCounts(RANKS)
    rng = random.Random(1)
    pieces = ["the ", "  ", "\n", "a", "é", "'s", " 12", "!!", "   ", "word", "\t", "<|endoftext|>"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 5, 400])))
        tree = TokenTree.build(text, counts)
        assert tree.total == len(counts.encoding.encode_ordinary(text))
        for _ in range(4):
            a = rng.randint(0, len(tree.text))
            b = a + rng.choice([0, 0, 1, 5, 100])
            put = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 3, 90])))
            expected = tree.text[:a] + put + tree.text[b:]
            tree.edit(a, b, put)
            assert tree.text == expected and tree.total == len(counts.encoding.encode_ordinary(expected))
            assert all(np.array_equal(x, y) for x, y in zip(tree.levels, TokenTree._summed(tree.levels[0])))


def test_token_query_equals_encoding_whole_texts(spark):
    """Every row of the query: the edits applied to the text in Python, both texts encoded from scratch."""
    encoding = PieceCounts(RANKS).encoding
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op2_token_counts"](spark, SF).collect()}
    assert len(got) == docs.count()
    for r in docs.select("doc_id", "text", revision(F.col("text"), F.col("doc_id")).alias("edits")).collect():
        text = r.text or ""
        assert got[r.doc_id].tokens_before == len(encoding.encode_ordinary(text))
        for e in r.edits:
            start = min(max(e.start, 0), len(text))
            text = text[:start] + e.put + text[max(min(e.end, len(text)), start):]
        assert got[r.doc_id].tokens == len(encoding.encode_ordinary(text))
        assert got[r.doc_id].text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_token_query_and_local_work(spark):
    counts = PieceCounts(RANKS)
    docs = spark.createDataFrame([(1, "word " * 5000), (2, None), (3, ""), (None, "a b"), (4, "x")], "doc_id long, text string")
    edit = F.array(F.struct(F.lit(100).alias("start"), F.lit(None).cast("int").alias("end"), F.lit("new ").alias("put")),
                   F.lit(None).cast("struct<start:int,end:int,put:string>"), F.struct(F.lit(-4).alias("start"), F.lit(0).alias("end"), F.lit(None).cast("string").alias("put")))
    got = {r.doc_id: r for r in recount_tokens(count_tokens(docs.withColumn("tokens", F.lit("x")), RANKS), edit, RANKS).collect()}
    for r in got.values():
        assert r.tokens == len(counts.encoding.encode_ordinary(r.text or ""))
    assert got[1].text[100:104] == "new " and got[1].pieces_encoded < 500 and got[2].text == "new "
    for r in QUERIES["op2_token_counts"](spark, SF).limit(50).collect():
        assert r.tokens > 0 and r.leaves > 0
    assert count_tokens(docs.limit(0), RANKS).count() == 0
