"""Near-duplicate vectors through a pruned neighbour graph.

Centroids of a bounded sample cut the vectors into overlapping shards: a vector is at home with its nearest
centroid and a guest with the next ones. Centroids within the cosine of one another are one, so a group of near
copies has one shard however large the table; how many shards a vector visits follows from links of the sample
that the centroids did not see. Each shard block builds a robust-pruned graph of its rows, the
adjacency lists of a vector's blocks are united, and every home row searches its shard: greedily from the
block's medoid and from itself, then, once inside the range, on to all neighbours in range. What the search
finds is verified by the cosine in double precision.

A crowded shard (a group of near copies may be a third of all rows) is dealt into blocks of bounded size, and
its queries into chunks; each task joins one chunk with one block. Tasks return counts and a spanning forest of
the links found, never the pairs. Equal vectors are one node with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm.frames import shared_folder, stored
from tillwatch.operators.components import connected_components

#: Rows that fit the centroids; their number bounds the training, whatever the table.
SAMPLE_ROWS = 20_000
#: Home rows a shard should have, most centroids (they are broadcast), rows of a block, least shards per vector.
SHARD_ROWS, MAX_SHARDS, BLOCK_ROWS, OVERLAP = 400, 4096, 2000, 3
DEGREE, CANDIDATES, STRANGERS, ALPHA, BEAM = 24, 48, 12, 1.2, 16
#: Share of the sample's links whose ends must meet in a shard, and rows whose links are looked at.
PLACED, AUDIT_ROWS = 0.98, 2000


def unit_rows(vectors: list[np.ndarray | None], width: int) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, whose square may leave the range of doubles."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            out[i] = v
    most = np.abs(out).max(axis=1, keepdims=True, initial=0.0)
    out /= np.where(most > 0, most, 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def centroids_of(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on the bounded sample."""
    pick = np.random.Generator(np.random.PCG64(3)).permutation(len(sample))[:count]
    centres = sample[pick]
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def merged_centres(centres: np.ndarray, cosine: float) -> np.ndarray:
    """Centroids with more than the cosine's distance between them: the one with most others within it stands for them."""
    close = centres @ centres.T >= cosine
    np.fill_diagonal(close, True)
    left, kept = np.ones(len(centres), bool), []
    degree = close.sum(1)
    while left.any():
        lead = int(np.where(left, degree, -1).argmax())
        gone = close[lead] & left
        kept.append(lead)
        left &= ~gone
        degree -= close[:, gone].sum(1)
    return centres[np.sort(kept)]


def overlap_needed(sample: np.ndarray, centres: np.ndarray, cosine: float, least: int) -> int:
    """Shards per vector, least or more, with which PLACED of the sample's links meet, over all links and by row."""
    k, asking = len(centres), sample[:AUDIT_ROWS]
    order = np.argsort(-(sample @ centres.T), axis=1, kind="stable").astype(np.int32)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(k, dtype=np.int32)[None, :], 1)
    links, rows = np.zeros(k), np.zeros(k)
    for low in range(0, len(asking), 250):
        close = asking[low : low + 250] @ sample.T >= cosine
        close[np.arange(len(close)), np.arange(low, low + len(close))] = False
        for i in np.flatnonzero(close.any(1)):
            met = np.bincount(rank[close[i], order[low + i, 0]], minlength=k)
            links += met
            rows += met / met.sum()
    if not rows.sum():
        return min(least, k)
    enough = [int(np.searchsorted(np.cumsum(x) / x.sum(), PLACED - 1e-9)) + 1 for x in (links, rows)]
    return min(k, max(least, *enough))


def _placed(batches: Iterator[pa.RecordBatch], centres: np.ndarray, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = unit_rows([x.values.to_numpy(zero_copy_only=False) for x in batch.column("vector")], centres.shape[1])
        near = np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :overlap]
        n, k = near.shape
        at = np.repeat(np.arange(n), k)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(at)), batch.column("weight").take(pa.array(at)), batch.column("vector").take(pa.array(at)),
             pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(k) == 0, n))],
            ["vec_id", "weight", "vector", "shard", "home"])


def robust_prune(vectors: np.ndarray, degree: int, candidates: int, strangers: int, alpha: float, seed: int) -> list[np.ndarray]:
    """Neighbours (row numbers) of every row: nearest first, leaving out what a kept one already leads to."""
    n = len(vectors)
    random = np.random.Generator(np.random.PCG64(seed))
    out: list[np.ndarray] = []
    for low in range(0, n, 250):
        near = vectors[low : low + 250] @ vectors.T
        near[np.arange(len(near)), np.arange(low, low + len(near))] = -2
        k = min(candidates, n - 1)
        best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.zeros((len(near), 0), int)
        best = np.concatenate([best, random.integers(0, n, (len(near), strangers))], axis=1)
        close = np.take_along_axis(near, best, 1)
        order = np.argsort(-close, axis=1, kind="stable")
        best, close = np.take_along_axis(best, order, 1), np.take_along_axis(close, order, 1)
        alive = close > -1.5
        among = np.einsum("qad,qbd->qab", vectors[best], vectors[best])
        kept = np.zeros_like(alive)
        far = np.sqrt(np.maximum(2 - 2 * close, 0))
        between = np.sqrt(np.maximum(2 - 2 * among, 0))
        for c in range(best.shape[1]):
            take = alive[:, c] & (kept.sum(1) < degree)
            kept[:, c] = take
            led = alpha * between[:, c, :] <= far
            led[:, : c + 1] = False
            alive &= ~(led & take[:, None])
        out += [best[i][kept[i]] for i in range(len(near))]
    return out


def _built(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("vec_id")
    ids = frame["vec_id"].to_numpy()
    vectors = unit_rows(list(frame["vector"]), len(frame["vector"].iloc[0]))
    near = robust_prune(vectors, DEGREE, CANDIDATES, STRANGERS, ALPHA, len(ids))
    return pd.DataFrame({"vec_id": ids, "near": [ids[x] for x in near]})


def _adjacency(ids: np.ndarray, near: list) -> np.ndarray:
    """United lists restricted to the block's rows, both ways, as a padded matrix (-1: none)."""
    place = {v: i for i, v in enumerate(ids)}
    pairs = [(i, place[v]) for i, own in enumerate(near) if own is not None for v in own if v in place]
    edges = np.array(pairs or [(0, 0)], np.int64)
    edges = np.unique(np.concatenate([edges, edges[:, ::-1]]), axis=0)
    edges = edges[edges[:, 0] != edges[:, 1]]
    counts = np.bincount(edges[:, 0], minlength=len(ids))
    table = np.full((len(ids), max(1, counts.max() if len(edges) else 1)), -1)
    table[edges[:, 0], np.arange(len(edges)) - np.repeat(np.cumsum(counts) - counts, counts)] = edges[:, 1]
    return table


def _dots(a: np.ndarray, rows: np.ndarray, b: np.ndarray, others: np.ndarray, step: int = 30_000) -> np.ndarray:
    """Products of the named rows pair by pair, a bounded number at a time."""
    out = np.empty(len(rows))
    for low in range(0, len(rows), step):
        out[low : low + step] = np.einsum("kd,kd->k", a[rows[low : low + step]], b[others[low : low + step]])
    return out


def range_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, own: np.ndarray, cosine: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs with at least the cosine that greedy search reaches; own: the query's row or -1."""
    q, n = len(queries), len(vectors)
    medoid = int((vectors @ vectors.mean(0)).argmax())
    seen = np.zeros((q, n), bool)
    best = np.full((q, beam), -1)
    score = np.full((q, beam), -np.inf)
    done = np.ones((q, beam), bool)
    best[:, 0], score[:, 0], done[:, 0] = medoid, queries @ vectors[medoid], False
    inside = np.flatnonzero(own >= 0)
    best[inside, 1], score[inside, 1], done[inside, 1] = own[inside], 1.0, False
    seen[:, medoid] = True
    seen[inside, own[inside]] = True
    active = np.arange(q)
    while len(active):
        open_score = np.where(done[active], -np.inf, score[active])
        spot = open_score.argmax(1)
        live = open_score[np.arange(len(active)), spot] > -np.inf
        active, spot = active[live], spot[live]
        if not len(active):
            break
        done[active, spot] = True
        ahead = links[best[active, spot]]
        fresh = (ahead >= 0) & ~seen[active[:, None], ahead]
        a, b = np.nonzero(fresh)
        value = np.full(ahead.shape, -np.inf)
        value[a, b] = _dots(vectors, ahead[a, b], queries, active[a])
        seen[active[a], ahead[a, b]] = True
        ids = np.concatenate([best[active], ahead], 1)
        scores = np.concatenate([score[active], value], 1)
        flags = np.concatenate([done[active], ~fresh], 1)
        top = np.argpartition(-scores, beam - 1, axis=1)[:, :beam]
        best[active], score[active], done[active] = (np.take_along_axis(x, top, 1) for x in (ids, scores, flags))
    hit = score >= cosine
    who, slot = np.nonzero(hit)
    what = best[who, slot]
    found_q, found_v = [who], [what]
    reached = np.zeros((q, n), bool)
    reached[who, what] = True
    while len(who):
        ahead_of = np.zeros((q, n + 1), bool)
        for low in range(0, len(who), 5000):
            ahead_of[who[low : low + 5000, None], links[what[low : low + 5000]]] = True
        who, what = np.nonzero(ahead_of[:, :n] & ~reached)
        reached[who, what] = True
        close = _dots(vectors, what, queries, who) >= cosine
        who, what = who[close], what[close]
        found_q.append(who)
        found_v.append(what)
    pairs = np.unique(np.concatenate(found_q) * n + np.concatenate(found_v))
    return pairs // n, pairs % n


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a and b pair by pair; parent holds roots before and after."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def _searched(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    data = frame[frame["data"]].sort_values("vec_id")
    asking = frame[frame["query"]].sort_values("vec_id")
    if not len(data) or not len(asking):
        return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "found": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
    width = len(data["vector"].iloc[0])
    ids, vectors = data["vec_id"].to_numpy(), unit_rows(list(data["vector"]), width)
    weight = data["weight"].to_numpy()
    links = _adjacency(ids, list(data["near"]))
    names, queries = asking["vec_id"].to_numpy(), unit_rows(list(asking["vector"]), width)
    at = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
    own = np.where(ids[at] == names, at, -1)
    counts = np.zeros(len(names), np.int64)
    nodes = np.union1d(names, ids)
    parent = np.arange(len(nodes))
    ask, have = np.searchsorted(nodes, names), np.searchsorted(nodes, ids)

    for low in range(0, len(names), 250):
        who, what = range_search(vectors, links, queries[low : low + 250], own[low : low + 250], cosine)
        who = who + low
        other = names[who] != ids[what]
        exact = _dots(queries, who, vectors, what) >= cosine
        who, what = who[other & exact], what[other & exact]
        np.add.at(counts, who, weight[what])
        _hook(parent, ask[who], have[what])
    tied = np.flatnonzero(parent != np.arange(len(nodes)))
    return pd.DataFrame({
        "vec_id": np.concatenate([names, nodes[tied]]),
        "found": np.concatenate([counts, np.zeros(len(tied), np.int64)]),
        "root": np.concatenate([names, nodes[parent[tied]]])})


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has a length and finite components, as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))


def near_vectors(embeddings: DataFrame, cosine: float = 0.95, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id, embedding; other columns are not read).

    Vectors link at a cosine of at least ``cosine`` (double precision). Null, empty and zero vectors, those with
    null or non-finite components and those with a null id link with nothing (a null id has a null component and
    is kept). Vectors of another length than most link only among their own. Equal vectors link with each other;
    repeated rows of one id and vector are one vector, shown as often as it stands. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    folder = shared_folder(spark)
    fine = usable(embeddings)
    named = fine.select("vec_id", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(5), "vector").alias("h2"), "vector").distinct()
    named = stored(named, f"{folder}/named")
    groups = named.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    members = stored(named.select("vec_id", "h1", "h2").join(groups, ["h1", "h2"]).select("vec_id", "h1", "h2", "rep", "weight"), f"{folder}/members")
    nodes = stored(
        named.join(members.where("vec_id = rep").select("vec_id", "h1", "h2", "weight"), ["vec_id", "h1", "h2"])
        .select("vec_id", "weight", "vector", F.size("vector").alias("width")), f"{folder}/nodes")

    counts, edges = [], [members.where("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))]
    for row in nodes.groupBy("width").count().toLocalIterator():
        results = _linked(spark, nodes.where(F.col("width") == row["width"]), row["count"], f"{folder}/width-{row['width']}", cosine, shard_rows, block_rows, overlap)
        counts.append(results.groupBy("vec_id").agg(F.sum("found").alias("found")))
        edges.append(results.where("vec_id <> root").select(F.col("root").alias("a"), F.col("vec_id").alias("b")))
    made = iter(range(1_000_000))
    whole = edges[0]
    for more in edges[1:]:
        whole = whole.unionByName(more)
    components = connected_components(whole, lambda df: stored(df, f"{folder}/step-{next(made)}"))
    found = counts[0] if counts else members.select("vec_id", F.lit(0).cast("long").alias("found")).limit(0)
    for more in counts[1:]:
        found = found.unionByName(more)
    per_id = (members.join(found.withColumnRenamed("vec_id", "rep"), "rep", "left")
              .select("vec_id", (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("links"))
              .groupBy("vec_id").agg(F.max("links").alias("links")))
    result = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
              .join(per_id, "vec_id", "left").join(components.withColumnRenamed("node", "vec_id"), "vec_id", "left"))
    component = F.coalesce("component", "vec_id")
    return result.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _linked(spark: SparkSession, nodes: DataFrame, rows: int, folder: str, cosine: float, shard_rows: int, block_rows: int, overlap: int) -> DataFrame:
    """(vec_id, found, root) rows of one vector length: links counted by query, and forest edges."""
    part = min(1.0, SAMPLE_ROWS / max(rows, 1))
    sample = nodes.where(F.pmod(F.xxhash64(F.lit(23), "vec_id"), F.lit(1 << 20)) < int(part * (1 << 20))).select("vector").limit(2 * SAMPLE_ROWS)
    drawn = [np.asarray(r["vector"]) for r in sample.toLocalIterator()] or [np.asarray(nodes.first()["vector"])]
    count = int(np.clip(rows // shard_rows, 1, min(MAX_SHARDS, len(drawn))))
    drawn = unit_rows(drawn, len(drawn[0]))
    # A larger table's rows are mostly strange to the centroids: so must be the rows that tell the overlap.
    seen, strange = (drawn, drawn) if rows <= SAMPLE_ROWS else (drawn[::2], drawn[1::2])
    centres = merged_centres(centroids_of(seen, min(count, len(seen))), cosine)
    overlap = overlap_needed(strange, centres, cosine, overlap)
    shared = spark.sparkContext.broadcast(centres)
    placed = stored(
        nodes.mapInArrow(lambda x: _placed(x, shared.value, overlap), "vec_id long, weight long, vector array<double>, shard int, home boolean"), f"{folder}/placed")

    sizes = placed.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).cast("int").alias("blocks"))
    dealt = placed.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64(F.lit(31), "vec_id"), F.col("blocks")).cast("int"))
    near = dealt.groupBy("shard", "block").applyInPandas(_built, "vec_id long, near array<long>")
    united = stored(near.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), f"{folder}/united")

    ready = dealt.join(united, "vec_id")
    every = lambda: F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ["vec_id", "weight", "vector", "near", "shard"]
    as_data = ready.select(*columns, every().alias("chunk"), "block", F.lit(True).alias("data"), (F.col("home") & (F.col("blocks") == 1)).alias("query"))
    as_query = ready.where("home AND blocks > 1").select(
        *columns[:3], F.lit(None).cast("array<long>").alias("near"), "shard", F.col("block").alias("chunk"), every().alias("block"), F.lit(False).alias("data"), F.lit(True).alias("query"))
    tasks = as_data.unionByName(as_query).groupBy("shard", "chunk", "block")
    return stored(tasks.applyInPandas(lambda frame: _searched(frame, cosine), "vec_id long, found long, root long"), f"{folder}/found")


def audit_recall(embeddings: DataFrame, result: DataFrame, cosine: float = 0.95, every: int = 20) -> float:
    """Links counted in result over links by brute force, of the ids divisible by ``every`` against all rows, in blocks."""
    fine = usable(embeddings).distinct()
    queries = fine.where(F.col("vec_id") % every == 0)
    block = lambda df, n: df.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    left, right = block(queries, 8), block(fine, 16)
    a = left.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(15)))).select("g", "h", "vec_id", "vector", F.lit(True).alias("query"))
    b = right.select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("g"), F.col("g").alias("h"), "vec_id", "vector", F.lit(False).alias("query"))

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        q, d = frame[frame["query"]], frame[~frame["query"]]
        if not len(q) or not len(d):
            return pd.DataFrame({"vec_id": q["vec_id"], "n": np.zeros(len(q), np.int64)})
        width = len(d["vector"].iloc[0])
        close = unit_rows(list(q["vector"]), width) @ unit_rows(list(d["vector"]), width).T >= cosine
        close &= q["vec_id"].to_numpy()[:, None] != d["vec_id"].to_numpy()[None, :]
        return pd.DataFrame({"vec_id": q["vec_id"], "n": close.sum(1)})

    truth = a.unionByName(b).groupBy("g", "h").applyInPandas(counted, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    row = truth.join(result.select("vec_id", "n_links").distinct(), "vec_id").agg(F.sum(F.least("n", "n_links")).alias("hit"), F.sum("n").alias("all")).first()
    return 1.0 if not row["all"] else row["hit"] / row["all"]
