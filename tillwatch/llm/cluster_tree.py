"""Approximate nearest neighbours in a hierarchical k-means tree.

Equal vectors are one node of the index. The branches of the tree are centroids of a bounded sample of all nodes, and
each branch's leaves are centroids of a bounded sample of that branch, fitted by Spark per branch; then every node goes
down to a leaf. Their number grows with the table up to ``MOST_LEAVES``, whose centroids are what is broadcast.

A query walks the tree best bin first: a priority queue holds the bins seen by the distance of their centroid, the
nearest one is opened, and a branch puts its leaves into the queue. How many leaves a query visits is calibrated: for a
bounded number of queries the true neighbours are found by brute force, and visits widen until the leaves visited hold the wanted
share of them. Visits and leaves meet in a shuffle; a crowded leaf is dealt into blocks, the queries that visit it into chunks.
A query's first leaves give a bound for its k-th distance; from the other leaves only nodes within it are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch.llm.frames import shared_folder, shuffle_partitions, stored

#: Nodes a leaf should hold; most branches, and most leaves of a branch.
LEAF_ROWS, MOST_BRANCHES = 100, 256
MOST_LEAVES = MOST_BRANCHES * MOST_BRANCHES
#: Nodes that fit the branches, and nodes of one branch that fit its leaves.
SAMPLE_ROWS, BRANCH_SAMPLE = 16_384, 8192
#: Queries compared with everything, and the share of their neighbours the visits must reach.
CALIBRATION, RECALL = 256, 0.97
#: Nodes of a block and queries of a chunk of a leaf, and the leaves that give a query its bound.
BLOCK_ROWS, CHUNK_QUERIES, FIRST_LEAVES = 2048, 2048, 8


def k_means(rows: np.ndarray, count: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """At most count centroids; an empty cluster keeps its place."""
    if count <= 1 or len(rows) <= 1:
        return rows.mean(0, keepdims=True)
    centres = rows[np.random.Generator(np.random.PCG64(seed)).permutation(len(rows))[:count]]
    for _ in range(rounds):
        home = nearest_centre(rows, centres)
        order = np.argsort(home, kind="stable")
        full, first = np.unique(home[order], return_index=True)
        sizes = np.diff(np.append(first, len(rows)))
        centres = centres.copy()
        centres[full] = np.add.reduceat(rows[order], first, axis=0) / sizes[:, None]
    return centres


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmin(half - rows[k : k + 2048] @ centres.T, 1) for k in range(0, len(rows), 2048)] or [np.zeros(0, np.int64)])


class Tree:
    """Branch centroids and, per branch, leaf centroids; distances are taken after one common scaling."""

    def __init__(self, branches: np.ndarray, leaves: list[np.ndarray], scale: float) -> None:
        self.branches, self.leaves, self.scale = branches, leaves, scale
        self.first = np.cumsum([0, *[len(x) for x in leaves]])

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        """Rows over the scale; far beyond the sample a component stands at the edge, which only misplaces it."""
        return np.clip(rows / self.scale, -1e6, 1e6)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Leaf number of each row: down the nearest branch to its nearest leaf."""
        rows = self.scaled(rows)
        branch, out = nearest_centre(rows, self.branches), np.zeros(len(rows), np.int64)
        for b in np.unique(branch):
            mine = np.flatnonzero(branch == b)
            out[mine] = self.first[b] + nearest_centre(rows[mine], self.leaves[b])
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaf numbers, best bin first."""
        q = self.scaled(query)
        away = ((self.branches - q) ** 2).sum(1)
        bins = [(float(d), -1, b) for b, d in enumerate(away)]
        heapq.heapify(bins)
        while bins:
            _, kind, number = heapq.heappop(bins)
            if kind >= 0:
                yield number
                continue
            for k, d in enumerate(((self.leaves[number] - q) ** 2).sum(1).tolist()):
                heapq.heappush(bins, (d, 0, int(self.first[number]) + k))


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision; scaled where squares would leave its range."""
    apart = rows - query
    most = np.abs(apart).max(initial=0.0)
    if most == 0 or 1e-140 < most < 1e140:
        found = np.sqrt((apart * apart).sum(1))
        if most == 0 or found.min(initial=1.0) > 1e-140:
            return found
    scale = np.abs(apart).max(1, initial=0.0)
    apart /= np.where(scale > 0, scale, 1)[:, None]
    return scale * np.sqrt((apart * apart).sum(1))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0.0)


def _nearest_of_block(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """Per query of a chunk the k nearest nodes of the block within its bound, by distance and node."""
    asks, rows = frame[frame["asks"]], frame[~frame["asks"]]
    if not len(asks) or not len(rows):
        return pd.DataFrame({"query": [], "node": [], "score": []}).astype({"query": "int64", "node": "int64", "score": "float64"})
    data, nodes = np.stack(rows["vector"].to_list()), rows["node"].to_numpy()
    order = np.argsort(nodes)
    data, nodes, out = data[order], nodes[order], []
    for query, vector, bound in zip(asks["node"], asks["vector"], asks["bound"]):
        score = distances(data, vector)
        within = np.flatnonzero(score <= bound)
        best = within[np.argsort(score[within], kind="stable")[:k]]
        out.append(pd.DataFrame({"query": query, "node": nodes[best], "score": score[best]}))
    return pd.concat(out)


def _sampled(nodes: DataFrame, rate: Column | float, salt: int) -> DataFrame:
    return nodes.where(F.pmod(F.xxhash64(F.lit(salt), "node"), F.lit(1 << 30)) < F.least(F.lit(1.0), rate if isinstance(rate, Column) else F.lit(rate)) * (1 << 30))


def fit_tree(nodes: DataFrame, width: int, count: int, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Tree over nodes (node, vector of one width); two bounded samples, gathered per branch for the second level."""
    spark = nodes.sparkSession
    leaves = int(min(max(1, count // leaf_rows), MOST_LEAVES))
    branches = int(np.ceil(np.sqrt(leaves)))
    drawn = _sampled(nodes, 0.9 * SAMPLE_ROWS / count, 1).orderBy("node").limit(SAMPLE_ROWS).select("vector").collect()
    sample = np.array([r.vector for r in drawn], float).reshape(-1, width)
    if not len(sample):
        sample = np.array([r.vector for r in nodes.select("vector").limit(1).collect()], float).reshape(-1, width)
    scale = float(np.abs(sample).max()) or 1.0
    top = k_means(sample / scale, branches)
    shared = spark.sparkContext.broadcast(Tree(top, [top[k : k + 1] for k in range(len(top))], scale))

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = shared.value.place(_matrix(batch.column("vector"), width))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("vector"), pa.array(at)], ["node", "vector", "branch"])

    branched = nodes.select("node", "vector").mapInArrow(branch, "node long, vector array<double>, branch long")
    sizes = {r.branch: r.n for r in branched.groupBy("branch").agg(F.count("*").alias("n")).collect()}
    rates = F.lit(0.0)
    for k, n in sizes.items():
        rates = F.when(F.col("branch") == k, 0.9 * BRANCH_SAMPLE / n).otherwise(rates)

    def leaf_centres(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["branch"].iloc[0])
        rows = shared.value.scaled(np.stack(frame.sort_values("node")["vector"].iloc[:BRANCH_SAMPLE].to_list()))
        wanted = min(MOST_BRANCHES, max(1, round(sizes[number] / leaf_rows)))
        return pd.DataFrame({"branch": number, "centre": list(k_means(rows, wanted))})

    fitted = _sampled(branched, rates, 2).groupBy("branch").applyInPandas(leaf_centres, "branch long, centre array<double>").collect()
    children: dict[int, list] = {}
    for row in fitted:
        children.setdefault(row.branch, []).append(row.centre)
    return Tree(top, [np.array(children[k]) if k in children else top[k : k + 1] for k in range(len(top))], scale)


def calibrated_visits(tree: Tree, placed: DataFrame, asks: DataFrame, width: int, k: int, recall: float) -> tuple[int, float]:
    """(leaves to visit, share of true neighbours they hold), by brute force over a bounded number of queries."""
    spark = placed.sparkSession
    drawn = asks.orderBy(F.xxhash64(F.lit(3), "node")).limit(CALIBRATION).select("node", "vector").collect()
    names, queries = [r.node for r in drawn], np.array([r.vector for r in drawn], float).reshape(-1, width)
    shared = spark.sparkContext.broadcast((names, queries))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            data = _matrix(batch.column("vector"), width)
            node, leaf = (batch.column(c).to_numpy() for c in ("node", "leaf"))
            for name, query in zip(ids, vectors):
                score = distances(data, query)
                best = np.argpartition(score, k - 1)[:k] if len(score) > k else np.arange(len(score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(best), pa.int64()), pa.array(node[best]), pa.array(leaf[best]), pa.array(score[best])],
                    ["query", "node", "leaf", "score"])

    near = placed.select("node", "vector", "leaf").mapInArrow(compare, "query long, node long, leaf long, score double")
    ranked = near.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("score", "node"))).where(F.col("r") <= k)
    wanted: dict[int, list[int]] = {}
    for row in ranked.select("query", "leaf").collect():
        wanted.setdefault(row.query, []).append(row.leaf)
    needed = []
    for name, query in zip(names, queries):
        open_leaves, place = set(wanted.get(name, [])), {}
        for n, leaf in enumerate(tree.visits(query), 1):
            if leaf in open_leaves:
                place[leaf] = n
                if len(place) == len(open_leaves):
                    break
        needed += [place[leaf] for leaf in wanted.get(name, [])]
    if not needed:
        return 1, 1.0
    visits, needed = 1, np.array(needed)
    while (needed <= visits).mean() < recall:
        visits += max(1, visits // 4)
    return visits, float((needed <= visits).mean())


def _searched(nodes: DataFrame, asks: DataFrame, width: int, k: int, leaf_rows: int, recall: float, folder: str) -> DataFrame:
    """(query, node, score): the k nearest nodes found for each asking node, itself among them."""
    spark = nodes.sparkSession
    count = nodes.count()
    tree = fit_tree(nodes, width, count, leaf_rows)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.place(_matrix(batch.column("vector"), width))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("vector"), pa.array(leaf)], ["node", "vector", "leaf"])

    placed = stored(nodes.select("node", "vector").mapInArrow(place, "node long, vector array<double>, leaf long"), f"{folder}/placed-{width}")
    visits, _ = calibrated_visits(tree, placed, asks, width, k, recall)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                leaves = []
                for query in _matrix(part.column("vector"), width):
                    found = shared.value.visits(query)
                    leaves.append([leaf for _, leaf in zip(range(visits), found)])
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("vector"), pa.array(leaves, pa.list_(pa.int64()))], ["node", "vector", "leaves"])

    walked = stored(asks.select("node", "vector").mapInArrow(walk, "node long, vector array<double>, leaves array<long>"), f"{folder}/walked-{width}")
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"))
    best = W.partitionBy("query").orderBy("score", "node")

    def scanned(asking: DataFrame) -> DataFrame:
        """asking (node, vector, bound, leaves): the k best nodes of those leaves within the bound."""
        parts = lambda c, size: F.greatest(F.lit(1), F.ceil(F.col(c) / size)).cast("int")
        visiting = asking.select("node", "vector", "bound", F.explode("leaves").alias("leaf"))
        chunks = visiting.groupBy("leaf").agg(F.count("*").alias("n")).select("leaf", parts("n", CHUNK_QUERIES).alias("chunks"))
        dealt = F.broadcast(sizes.select("leaf", parts("n", BLOCK_ROWS).alias("blocks")).join(chunks, "leaf"))
        slot, upto = F.xxhash64(F.lit(5), "node"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        data = placed.join(dealt, "leaf").select(
            "node", "vector", F.lit(0.0).alias("bound"), "leaf", F.pmod(slot, F.col("blocks")).cast("int").alias("block"), upto("chunks").alias("chunk"), F.lit(False).alias("asks"))
        asks = visiting.join(dealt, "leaf").select(
            "node", "vector", "bound", "leaf", upto("blocks").alias("block"), F.pmod(slot, F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("asks"))
        tasks = data.unionByName(asks).repartition(shuffle_partitions(spark), "leaf", "block", "chunk")
        found = tasks.groupBy("leaf", "block", "chunk").applyInPandas(lambda x: _nearest_of_block(x, k), "query long, node long, score double")
        return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)

    first = stored(scanned(walked.select("node", "vector", F.lit(float("inf")).alias("bound"), F.slice("leaves", 1, FIRST_LEAVES).alias("leaves"))), f"{folder}/first-{width}")
    if visits <= FIRST_LEAVES:
        return first.drop("r")
    bounds = first.where(F.col("r") == k).select(F.col("query").alias("node"), F.col("score").alias("bound"))
    others = walked.join(bounds, "node", "left").select(
        "node", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), F.slice("leaves", FIRST_LEAVES + 1, visits).alias("leaves"))
    both = first.drop("r").unionByName(scanned(others).drop("r"))
    return both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def nearest_vectors(
    table: DataFrame, asks: Column, k: int = 10, recall: float = RECALL, leaf_rows: int = LEAF_ROWS,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``asks`` selects the k nearest other rows found.

    Nearness is the Euclidean distance in double precision of the original vectors, ties go to the smaller id; with
    fewer than k candidates all are returned. Rows whose id is null, or whose vector is null, empty, zero or holds null or
    non-finite components, take no part; vectors meet only vectors of their own length. Of rows that repeat an id the smallest
    vector stands for it. Of equal vectors the k + 1 smallest ids are kept: no other can be among k nearest.
    """
    spark = table.sparkSession
    folder = shared_folder(spark)
    vector = F.transform(vector_column, lambda x: x.cast("double"))
    rows = table.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"), asks.alias("asks"))
    single = stored(rows.where(usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks")), f"{folder}/rows")
    smallest = W.partitionBy("vector").orderBy("vec_id")
    few = single.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    nodes = stored(
        few.groupBy("vector").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("width", F.size("vector")),
        f"{folder}/nodes")
    queries = stored(
        single.where("asks").select(F.col("vec_id").alias("query_id"), "vector").join(nodes.select("vector", "node"), "vector").select("query_id", "node"),
        f"{folder}/queries")
    asking = stored(nodes.join(queries.select("node").distinct(), "node", "left_semi").select("node", "vector", "width"), f"{folder}/asking")
    found = None
    for (width,) in sorted(tuple(r) for r in asking.select("width").distinct().collect()):
        part = _searched(
            nodes.where(F.col("width") == width), asking.where(F.col("width") == width).select("node", "vector"), width, k + 1, leaf_rows, recall, folder)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    named = found.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    lists = named.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    gathered = lists.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    answered = queries.join(gathered.withColumnRenamed("query", "node"), "node")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
