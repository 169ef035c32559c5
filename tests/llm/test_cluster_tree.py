"""Nearest neighbours: recall against brute force, exact scores, ties, odd vectors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwatch.llm import cluster_tree as C
from tillwatch.llm.queries import op13_nearest_neighbours

SF = "/root/testdata/sf0.01"


def brute(ids, vectors, asks, k=10):
    order = np.argsort(ids)
    ids, vectors, out = np.array(ids)[order], np.array(vectors, float)[order], {}
    for q in asks:
        away = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        near = [i for i in np.argsort(away, kind="stable") if ids[i] != q][:k]
        out[q] = [(int(ids[i]), away[i]) for i in near]
    return out


def answers(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    """Share of the true neighbours found, one found at the same distance counting as well."""
    hits = sum(sum(b[1] <= want[q][-1][1] + 1e-12 for b in got.get(q, [])) for q in want)
    return hits / sum(len(x) for x in want.values())


def test_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = answers(op13_nearest_neighbours(spark, SF))
    want = brute(table["vec_id"], np.stack(table["embedding"]), [i for i in table["vec_id"] if i % 100 == 0])
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert recall(got, want) >= 0.95
    vectors = dict(zip(table["vec_id"], np.stack(table["embedding"]).astype(float)))
    for q, near in got.items():
        for i, score in near:
            assert score == pytest.approx(np.sqrt(((vectors[q] - vectors[i]) ** 2).sum()), rel=1e-13)


@pytest.mark.parametrize("kind", ["spread", "groups"])
def test_recall_of_large_made_tables(spark, kind):
    """Uniform directions, and groups of which one holds a third of all rows as distinct near copies."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(12_000, 16))
    if kind == "groups":
        rows = rows[rng.integers(0, 60, 12_000)] + 0.3 * rng.normal(size=rows.shape)
        rows[::3] = rows[0] + 0.05 * rng.normal(size=(4000, 16))
    frame = pd.DataFrame({"vec_id": np.arange(12_000), "embedding": list(rows)})
    table = spark.createDataFrame(frame, "vec_id long, embedding array<double>").repartition(6)
    got = answers(C.nearest_vectors(table, F.col("vec_id") % 100 == 0))
    assert recall(got, brute(frame["vec_id"], rows, range(0, 12_000, 100))) >= 0.93


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(1, 60)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(60, 120)] + [(100 * k, [1.0, 0.0, 0.0, 0.0]) for k in range(2, 5)]
    rows += [(500, [0.0, 2.0, 0.0, 0.0]), (700, [3.0, 4.0]), (701, [3.0, 0.0]), (900, [1e200, 0.0, 1.0]), (901, [2e200, 0.0, 1.0]),
             (1000, [1e-200]), (1001, [3e-200]), (1100, [5.0] * 7)]
    odd = [(600, None), (800, []), (1200, [0.0] * 4), (1300, [float("nan")] * 4), (1400, [1.0, None, 0.0, 0.0]), (1500, [float("inf"), 0.0, 0.0, 0.0]),
           (None, [1.0, 0.0, 0.0, 0.0]), rows[3], (7, [9.0] * 4)]
    table = spark.createDataFrame([(i, v, k, k) for k, (i, v) in enumerate(rows + odd)], "vec_id long, embedding array<double>, node int, score int")
    got = answers(C.nearest_vectors(table, F.col("vec_id") % 100 == 0, recall=1.0, leaf_rows=8))
    first = {}
    for i, v in rows + odd[-2:]:
        first[i] = min(first.get(i, v), v)
    four = {i: v for i, v in first.items() if len(v) == 4}
    assert {q: [(i, round(s, 12)) for i, s in near] for q, near in got.items() if q in four} == {
        q: [(i, round(s, 12)) for i, s in near] for q, near in brute(list(four), list(four.values()), [100, 200, 300, 400, 500]).items()}
    assert got[700] == [(701, 4.0)] and got[900] == [(901, 1e200)] and got[1000] == [(1001, pytest.approx(2e-200))]
    assert set(got) == {100, 200, 300, 400, 500, 700, 900, 1000}
    assert C.nearest_vectors(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_a_tree_visits_every_leaf_once_nearest_first():
    rng = np.random.default_rng(1)
    tree = C.Tree(rng.normal(size=(5, 3)), [rng.normal(size=(n, 3)) for n in (1, 4, 2, 6, 3)], 1.0)
    order = list(tree.visits(np.zeros(3)))
    assert sorted(order) == list(range(16))
    assert order[0] in range(tree.first[int((tree.branches**2).sum(1).argmin())], 16)
