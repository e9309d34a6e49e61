"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

*Nodes* are the different vectors; a node keeps the smallest ids of its rows, as many as a result can name, so
that a vector held by a third of all rows costs one node and loses no answer.

*Graph.* The first neighbours come from ``TREES`` random projection trees, fitted on at most ``SAMPLE`` vectors; every
node is dealt to a leaf of each and compared there. Then NN-descent: around each node a sample of its
neighbours and of the nodes it is a neighbour of meet in a join; pairs with a new edge are compared, and every
node keeps its best ``DEGREE``. Rounds end when few edges change.

*Search.* A query holds its ``BEAM`` best nodes; each round expands those not expanded yet along graph edges
of both directions, in one join for all queries, until nothing closer is left. Distances of the result
are computed in double precision on the original vectors.

All exchanges are bounded per node: reverse lists are cut by a ranked limit that applies before the shuffle
(hubs), leaves by blocks. Nothing but the sample and counts reaches the driver.

Defined cases: rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do vectors of another length than the most frequent one; rows equal in id and
vector are one; a query's own are all rows of its id; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import grouped_by, map_batches, release, stored

NEIGHBOURS = 10
DEGREE = 32
TREES = 8
LEAF = 128
FROM_LEAF = 12  # edges a node takes from a leaf
SAMPLE = 20_000
NEW, OLD = 16, 8  # edges of a node that meet in a round, each way
TOLD = 6  # nearer nodes that a node hears of in one meeting
ROUNDS = 4
CHANGED = 0.05
BEAM = 224
SEARCH_ROUNDS = 12


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(rows: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & fine & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("embedding") == (sizes["size"] if sizes else 0))


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """``(node, embedding, ids)``: the different vectors and their ``keep`` smallest ids."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    least = rows.distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)
    grouped = least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return grouped.select(F.monotonically_increasing_id().alias("node"), "embedding", "ids")


class ProjectionTree:
    """Splits at the median of the projection on the line between two random points."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.normal: list[np.ndarray] = []
        self.cut: list[float] = []
        self.child: list[list[int]] = []  # a split, or minus one minus a leaf
        self.leaves = 0
        todo = [(np.arange(len(sample)), None)]
        while todo:
            rows, parent = todo.pop()
            me = None
            if len(rows) > leaf:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                side = sample[rows] @ (a - b)
                cut = float(np.median(side))
                low = side < cut
                if low.any() and not low.all():
                    me = len(self.normal)
                    self.normal.append(a - b)
                    self.cut.append(cut)
                    self.child.append([0, 0])
                    todo += [(rows[low], (me, 0)), (rows[~low], (me, 1))]
            if me is None:
                me = -1 - self.leaves
                self.leaves += 1
            if parent:
                self.child[parent[0]][parent[1]] = me

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        at = np.full(len(vectors), 0 if self.normal else -1, np.int64)
        child = np.array(self.child, np.int64).reshape(-1, 2)
        while len(inner := np.flatnonzero(at >= 0)):
            for split in np.unique(at[inner]):
                rows = inner[at[inner] == split]
                at[rows] = child[split, (vectors[rows] @ self.normal[split] >= self.cut[split]).astype(np.int64)]
        return -1 - at


def _distances(a: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows, centred first for precision."""
    a = a.astype(np.float64)
    a = a - a.mean(axis=0)
    norm = (a * a).sum(axis=1)
    return np.maximum(norm[:, None] + norm[None, :] - 2 * a @ a.T, 0).astype(np.float32)


_EDGE = "node bigint, other bigint, distance float"


def _edges(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d, pa.float32())], ["node", "other", "distance"])


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """Of every node its ``degree`` nearest others; ``new`` is true where no side knew the edge."""
    once = edges.groupBy("node", "other").agg(F.min("distance").alias("distance"), F.min("new").alias("new"))
    order = Window.partitionBy("node").orderBy("distance", "other")
    return once.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= degree).drop("nth")


def first_edges(nodes: DataFrame, count: int, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """Each node's nearest in its leaf of each tree."""
    drawn = nodes.select("node", "embedding").orderBy(F.xxhash64("node")).limit(sample).toPandas()
    points = np.array(drawn["embedding"].tolist(), np.float32)
    most = max(4, leaf * len(points) // max(count, 1))
    forest = [ProjectionTree(points, most, seed) for seed in range(trees)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, 1), np.float32)
            for t, tree in enumerate(forest):
                if len(vectors):
                    key = pa.array(tree.leaf_of(vectors) * len(forest) + t)
                    yield pa.RecordBatch.from_arrays([key, *batch.columns], ["leaf", "node", "embedding"])

    leaves = map_batches(nodes.select("node", "embedding"), deal, "leaf bigint, node bigint, embedding array<float>")
    sizes = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / (4 * leaf)).alias("blocks"))
    block = F.pmod(F.xxhash64("node", "leaf"), F.col("blocks"))
    dealt = leaves.join(sizes, "leaf").select(F.xxhash64("leaf", block).alias("leaf"), "node", "embedding")
    ordered = dealt.repartition("leaf").sortWithinPartitions("leaf", "node")

    def compare(batches):
        for group in grouped_by(batches, "leaf"):
            ids = group.column("node").to_numpy()
            near = _distances(_matrix(group.column("embedding")))
            np.fill_diagonal(near, np.inf)
            k = min(FROM_LEAF, len(ids) - 1)
            if k > 0:
                best = np.argpartition(near, k - 1, axis=1)[:, :k]
                rows = np.repeat(np.arange(len(ids)), k)
                yield _edges(ids[rows], ids[best.ravel()], near[rows, best.ravel()])

    return map_batches(ordered, compare, _EDGE).withColumn("new", F.lit(True))


def _some(edges: DataFrame, centre: str, member: str, turn: int) -> DataFrame:
    """A sample of the edges of each centre, new and old ones apart."""
    order = Window.partitionBy("centre", "new").orderBy(F.xxhash64("member", F.lit(turn)), "member")
    picked = edges.select(F.col(centre).alias("centre"), F.col(member).alias("member"), "new")
    picked = picked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(NEW, OLD))
    return picked.where(F.col("new") | (F.col("nth") <= OLD)).drop("nth")


def descend(graph: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """Edges found among neighbours of neighbours that beat the worst edge of their node."""
    worst = graph.groupBy("node").agg(F.max("distance").alias("worst"))
    vectors = nodes.select("node", "embedding").join(worst, "node", "left").withColumnRenamed("node", "member")
    around = _some(graph, "node", "other", turn).unionByName(_some(graph, "other", "node", turn))
    around = around.groupBy("centre", "member").agg(F.max("new").alias("new")).join(vectors, "member")
    ordered = around.select("centre", "member", "new", "worst", "embedding").repartition("centre").sortWithinPartitions("centre", "member")

    def meet(batches):
        for group in grouped_by(batches, "centre"):
            new = group.column("new").to_numpy(zero_copy_only=False).astype(bool)
            if len(new) < 2 or not new.any():
                continue
            ids = group.column("member").to_numpy()
            worst = group.column("worst").to_numpy(zero_copy_only=False).astype(np.float32)
            near = _distances(_matrix(group.column("embedding")))
            better = (new[:, None] | new[None, :]) & ~(near >= worst[:, None])
            np.fill_diagonal(better, False)
            near[~better] = np.inf
            k = min(TOLD, len(ids) - 1)
            best = np.argpartition(near, k - 1, axis=1)[:, :k]
            a, b = np.repeat(np.arange(len(ids)), k), best.ravel()
            told = better[a, b]
            if told.any():
                yield _edges(ids[a[told]], ids[b[told]], near[a[told], b[told]])

    return map_batches(ordered, meet, _EDGE)


def neighbour_graph(nodes: DataFrame, count: int, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """``(node, other, distance)``: about the ``degree`` nearest others of each node; distances squared."""
    graph = stored(_best(first_edges(nodes, count), degree))
    for turn in range(rounds):
        found = descend(graph, nodes, turn).withColumn("new", F.lit(True))
        before, graph = graph, stored(_best(graph.withColumn("new", F.lit(False)).unionByName(found), degree))
        release(before)
        if graph.where("new").count() < CHANGED * degree * count:
            break
    return graph.drop("new")


def greedy_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = BEAM, rounds: int = SEARCH_ROUNDS) -> DataFrame:
    """``(query, node, distance)``: the best nodes found. ``queries`` has ``query``, ``node`` to begin at and ``target``, a vector."""
    back = Window.partitionBy("node").orderBy("distance", "other")
    reverse = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "distance")
    reverse = reverse.withColumn("nth", F.row_number().over(back)).where(F.col("nth") <= DEGREE).drop("nth")
    ways = stored(graph.select("node", "other", "distance").unionByName(reverse).select("node", "other").distinct())
    targets = queries.select("query", "target")

    def measured(pairs: DataFrame) -> DataFrame:
        full = pairs.join(targets, "query").join(nodes.select("node", "embedding"), "node").select("query", "node", "target", "embedding")

        def measure(batches):
            for batch in batches:
                if batch.num_rows:
                    apart = _matrix(batch.column(2)).astype(np.float64) - _matrix(batch.column(3)).astype(np.float64)
                    d = pa.array(np.sqrt((apart * apart).sum(axis=1)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), d], ["query", "node", "distance"])

        return map_batches(full, measure, "query bigint, node bigint, distance double")

    order = Window.partitionBy("query").orderBy("distance", "node")
    held = stored(measured(queries.select("query", "node").distinct()).withColumn("done", F.lit(False)))
    for _ in range(rounds):
        open_ = held.where(~F.col("done"))
        if open_.isEmpty():
            break
        steps = open_.select("query", "node").join(ways, "node").select("query", F.col("other").alias("node")).distinct()
        fresh = measured(steps.join(held.select("query", "node"), ["query", "node"], "left_anti")).withColumn("done", F.lit(False))
        both = held.withColumn("done", F.lit(True)).unionByName(fresh)
        before, held = held, stored(both.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= beam).drop("nth"))
        release(before)
    return held.drop("done")


def nearest(rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for the ids of ``queries`` their ``k`` nearest rows of ``rows (vec_id, embedding)``."""
    rows = usable(rows)
    nodes = stored(nodes_of(rows, k + 1))
    count = nodes.count()
    if not count:
        return rows.selectExpr("vec_id as query_id", "0 as rank", "vec_id", "cast(0 as double) as score").limit(0)
    graph = neighbour_graph(nodes, count)
    asked = rows.join(queries.select("vec_id").distinct(), "vec_id").distinct()
    asked = stored(asked.join(nodes.select("node", "embedding"), "embedding").select(
        F.col("vec_id").alias("query"), "node", F.col("embedding").alias("target")
    ))
    found = greedy_search(asked, nodes, graph)
    named = found.join(nodes.select("node", "ids"), "node").select("query", "distance", F.explode("ids").alias("vec_id")).where("vec_id <> query")
    once = named.groupBy("query", "vec_id").agg(F.min("distance").alias("score"))
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
