"""Near-duplicate join on word n-grams by chosen paths.

A document is the set of its ``SHINGLE``-word runs (1 to 4 words: one run of all). Equal sets become one node.
A node has ``WIDTH`` minimum hashes, its tokens. A run of the join starts with all nodes in one bucket and splits
buckets on sampled tokens: of each bucket every token place is chosen with probability ``1 / (JACCARD * WIDTH)``,
at least one, and nodes with equal token there go on together. A bucket of at most ``BUCKET`` nodes is compared by
brute force; larger ones are split again, ``DEPTH`` times, and what is still larger is compared in pairs of
blocks. Runs are repeated until the recall of a pair at the threshold is ``RECALL``; see ``runs_needed``.

Brute force compares tokens and hands on, for each node, the first of its component in the bucket, never the pairs.
Nodes thus joined are candidates; then the exact Jaccard similarity of all pairs of a candidate component is computed
from the whole texts, again in pairs of bounded blocks. Counts of links and components of true links leave these tasks.

So no bucket, group of near copies or hot passage is listed in one task, and copies cost one node. Work in
a component of ``m`` different sets grows with its square, as any exact count of links does, but in blocks.

Defined cases: null and empty texts are alone; documents with equal ids are told apart by their text; repeated
rows are copies; a class is named by the smallest id in it (nulls last).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import grouped_by, map_batches, put_back, release, set_aside, slices, stored, utf8
from logweave.llm.hashing import inside_row, mix, odd_numbers, runs, words
from logweave.operators.joins import lookup_join

SHINGLE = 5
JACCARD = 0.8
WIDTH = 64
BUCKET = 4096
DEPTH = 4
RECALL = 0.999
#: Pairs whose tokens agree less are no candidates; four standard deviations below the threshold.
ALIKE = JACCARD - 4 * math.sqrt(JACCARD * (1 - JACCARD) / WIDTH)
#: Nodes and set members of a block of the exact comparison.
BLOCK_NODES = 1024
BLOCK_MEMBERS = 1_000_000
_ODD = odd_numbers(WIDTH, 11)


def runs_needed(recall: float = RECALL, similarity: float = JACCARD) -> int:
    """Runs after which a pair of this similarity has met with probability ``recall``, however deep its buckets."""
    p = 1 / (JACCARD * WIDTH)
    counts = [math.comb(WIDTH, k) * p**k * (1 - p) ** (WIDTH - k) for k in range(WIDTH + 1)]
    counts = [0.0, counts[0] + counts[1], *counts[2:]]  # none chosen: one is
    met = 1.0
    for _ in range(DEPTH):
        met = 1 - sum(c * (1 - similarity * met) ** k for k, c in enumerate(counts))
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def shingle_sets(data: np.ndarray, places: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each row, sorted, and the ``n + 1`` places where the rows begin."""
    found = words(data, places)
    starts = inside_row(found.first, size)
    hashes = runs(found.hashes, size, 1)[starts]
    row = np.searchsorted(found.first, starts, "right") - 1
    counts = np.diff(found.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        odd = odd_numbers(size, 2)
        own = [(found.hashes[found.first[r] : found.first[r + 1]] * odd[: counts[r]]).sum(dtype=np.uint64) for r in short]
        hashes = np.concatenate([hashes, mix(np.array(own, np.uint64))])
        row = np.concatenate([row, short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(places)))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, one, two, members, tokens)``: a 128-bit name of the set, its size, and its minimum hashes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = utf8(batch.column(2))
            for low, high in slices(places):
                hashes, first = shingle_sets(data[places[low] : places[high]], places[low : high + 1] - places[low])
                size = np.diff(first)
                full = np.flatnonzero(size)
                tokens = np.zeros((high - low, WIDTH), np.int32)
                names = np.zeros((2, high - low), np.uint64)
                if len(full):
                    at = first[full]
                    for i, odd in enumerate(_ODD):
                        tokens[full, i] = (np.minimum.reduceat(hashes * odd, at) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    names[0, full] = np.add.reduceat(hashes, at)
                    names[1, full] = np.add.reduceat(mix(hashes), at)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(tokens.ravel()), WIDTH).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], batch.column(1)[low:high], *(pa.array(n.view(np.int64)) for n in names),
                     pa.array(size, pa.int64()), flat],
                    ["doc_id", "row", "one", "two", "members", "tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row bigint, one bigint, two bigint, members bigint, tokens array<int>"
    return map_batches(docs.select("doc_id", row_key().alias("row"), "text"), read, schema)


def _choices(key: Column) -> Column:
    """The token places chosen for a bucket: each by chance, at least one."""
    most = 1 << 20
    share = int(most / (JACCARD * WIDTH))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.pmod(F.xxhash64(key, i), F.lit(most)) < share)
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.array(F.pmod(F.xxhash64(key), F.lit(WIDTH)).cast("int")))


def _split(rows: DataFrame, key: Column) -> DataFrame:
    """``(node, tokens, key)`` rows into the buckets below ``key``."""
    chosen = rows.withColumn("key", key).withColumn("place", F.explode(_choices(F.col("key"))))
    return chosen.withColumn("key", F.xxhash64("key", "place", F.element_at("tokens", F.col("place") + 1)))


def _in_blocks(rows: DataFrame, key: str, blocks: Column, node: str = "node") -> DataFrame:
    """Deal the rows of every key into blocks and give each pair of blocks a key of its own, ``pair``.

    ``side`` is 0 or 1 in a pair of two blocks, and 2 in a pair of a block with itself.
    """
    rows = rows.withColumn("_blocks", blocks.cast("int")).withColumn("_own", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    pair = F.xxhash64(F.col(key), F.least("_own", "_other"), F.greatest("_own", "_other"))
    return rows.withColumn("side", side).withColumn("pair", pair).drop("_blocks", "_own", "_other")


def buckets(nodes: DataFrame, run_count: int, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """``(key, node)``: the buckets of two and more nodes to compare, of all runs."""
    tokens = nodes.select("node", "tokens")
    roots = F.explode(F.array(*[F.xxhash64(F.lit("run"), F.lit(r)) for r in range(run_count)]))
    rows = _split(tokens.withColumn("root", roots), F.col("root")).select("key", "node")
    done = None
    for level in range(depth):
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        counted = stored(rows.join(sizes, "key"))
        small = counted.where(F.col("n") <= bucket).select("key", "node")
        done = small if done is None else done.unionByName(small)
        large = counted.where(F.col("n") > bucket)
        if large.isEmpty():
            return done
        if level == depth - 1:
            halves = F.ceil(2 * F.col("n") / bucket)
            # the two sides of a pair are compared as one bucket
            return done.unionByName(_in_blocks(large, "key", halves).select(F.col("pair").alias("key"), "node"))
        rows = _split(large.join(tokens, "node"), F.col("key")).select("key", "node")
    return done


def _names(n: int, near) -> np.ndarray:
    """For each of ``n`` nodes the first one of its component; ``near(i, others)`` tells which of ``others`` touch ``i``."""
    name = np.full(n, -1)
    for begin in range(n):
        if name[begin] >= 0:
            continue
        name[begin] = begin
        todo = [begin]
        while todo:
            i = todo.pop()
            others = np.flatnonzero(name < 0)
            if not len(others):
                return name
            found = others[near(i, others)]
            name[found] = begin
            todo += found.tolist()
    return name


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` edges to ``(node, component)``, by contraction.

    Every node points to the least of itself and its neighbours, and edges are drawn between the nodes pointed at
    until none is left. The first round orders nodes by id, which settles stars; later rounds by a hash that
    changes, so that chains shrink by a constant factor as well. Minima are combined before the shuffle.
    """
    edges, named, turn = stored(edges), None, 0
    while True:
        rank = lambda c: F.struct((F.xxhash64(c, F.lit(turn)) if turn else F.lit(0)).alias("r"), F.col(c).alias("id"))  # noqa: B023, E731
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select(F.col("u").alias("node"), F.least("m", rank("u"))["id"].alias("component"))
        least = stored(least)
        named = least if named is None else stored(
            named.join(least.toDF("component", "next"), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        )
        drawn = edges.join(least.toDF("u", "a"), "u").join(least.toDF("v", "b"), "v").where("a <> b")
        edges = stored(drawn.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        if edges.isEmpty():
            return named
        turn += 1


def candidate_links(nodes: DataFrame, found: DataFrame, alike: float = ALIKE) -> DataFrame:
    """``(u, v)``: per bucket, the nodes joined by enough equal tokens, each with the first of its component."""
    filled = found.join(nodes.select("node", "tokens"), "node")
    ordered = filled.repartition("key").sortWithinPartitions("key", "node")

    def read(batches):
        for group in grouped_by(batches, "key"):
            ids = group.column("node").to_numpy()
            tokens = group.column("tokens").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
            name = _names(len(ids), lambda i, others: (tokens[others] == tokens[i]).sum(axis=1) >= alike * WIDTH)
            linked = np.flatnonzero(name != np.arange(len(ids)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[name[linked]])], ["u", "v"])

    return map_batches(ordered.select("key", "node", "tokens"), read, "u bigint, v bigint").distinct()


def overlaps(members: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The sizes of all intersections of ``n`` sets given as (member, owner) pairs.

    Members of more than half of the sets are counted by the sets that lack them, so that near copies cost
    what they differ in.
    """
    order = np.argsort(members, kind="stable")
    members, owner = members[order], owner[order]
    first = np.flatnonzero(np.append(True, members[1:] != members[:-1])) if len(members) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(members)))
    common = count * 2 > n
    out = np.full((n, n), int(common.sum()), np.int32)
    inside = np.repeat(common, count)
    groups: list[np.ndarray] = [owner[a : a + k] for a, k in zip(first[~common], count[~common]) if k > 1]
    if common.any():
        lacks = np.ones(n, np.int64) * int(common.sum()) - np.bincount(owner[inside], minlength=n)
        out -= (lacks[:, None] + lacks[None, :]).astype(np.int32)
        partial = common & (count < n)
        for at in np.array_split(np.flatnonzero(partial), max(1, int(partial.sum() * n // 10_000_000) + 1)):
            holds = np.zeros((len(at), n), bool)
            for r, k in enumerate(at):
                holds[r, owner[first[k] : first[k] + count[k]]] = True
            groups += [np.flatnonzero(~row) for row in holds]
    by_size: dict[int, list[np.ndarray]] = {}
    for g in groups:
        if len(g) < 32:
            by_size.setdefault(len(g), []).append(g)
        else:
            out[np.ix_(g, g)] += 1
    flat = out.reshape(-1)
    for size, same in by_size.items():
        table = np.array(same)
        for part in np.array_split(table, len(table) * size * size // 4_000_000 + 1):
            cells = (part[:, :, None].astype(np.int64) * n + part[:, None, :]).ravel()
            at, n_at = np.unique(cells, return_counts=True)
            flat[at] += n_at.astype(np.int32)
    return out


def verified_links(docs: DataFrame, nodes: DataFrame, components: DataFrame, least: float = JACCARD) -> DataFrame:
    """``(u, v, links)``: per block pair, the links of each node and the first node of its component of true links."""
    sized = nodes.join(components, "node").select("node", "row", "one", "two", "copies", "members", "component")
    totals = sized.groupBy("component").agg(F.count("*").alias("m"), F.sum("members").alias("total"))
    chosen = sized.join(totals, "component").withColumn("weight", F.lit(1))
    texts = lookup_join(docs.select(row_key().alias("row"), "text"), chosen, "row", "weight")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("total") / BLOCK_MEMBERS), F.lit(1))
    dealt = _in_blocks(texts.dropDuplicates(["node"]), "component", blocks)
    ordered = dealt.select("pair", "side", "node", "copies", "text").repartition("pair").sortWithinPartitions("pair", "node")

    def read(batches):
        for group in grouped_by(batches, "pair"):
            ids, copies, side = (group.column(c).to_numpy() for c in ("node", "copies", "side"))
            members, first = shingle_sets(*utf8(group.column("text").combine_chunks()))
            size = np.diff(first)
            both = overlaps(members, np.repeat(np.arange(len(ids)), size), len(ids))
            near = both >= least * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(near, False)
            near &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
            links = near @ copies
            name = _names(len(ids), lambda i, others: near[i, others])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[name]), pa.array(links, pa.int64())], ["u", "v", "links"])

    return map_batches(ordered, read, "u bigint, v bigint, links bigint")


def near_duplicates(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """``(doc_id, row, class_id, class_row, n_links)``, one row per document.

    ``n_links`` counts the other documents of similarity ``JACCARD`` or more; ``class_row`` is the ``row_key`` of
    the document that names the class.
    """
    found = stored(sketches(docs))
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    sets = found.where("members > 0").groupBy("one", "two").agg(
        F.min(named).alias("name"), F.count("*").alias("copies"), F.first("members").alias("members"), F.first("tokens").alias("tokens")
    )
    nodes = stored(sets.select(F.monotonically_increasing_id().alias("node"), F.col("name.row").alias("row"), "*"))
    edges = stored(candidate_links(nodes, buckets(nodes, runs_needed(recall))))
    links = stored(verified_links(docs, nodes, components(edges)))
    counts = links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    parts = components(links.where("u <> v").select("u", "v"))
    classes = nodes.join(parts, "node").groupBy("component").agg(F.min("name").alias("best"))
    best = parts.join(classes, "component").select("node", "best")
    full = nodes.join(counts, "node", "left").join(best, "node", "left").select(
        "one", "two", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("best", "name").alias("best")
    )
    joined = found.where("members > 0").select("doc_id", "row", "one", "two").join(stored(full), ["one", "two"])
    empty = found.where("members = 0").select("doc_id", "row", F.col("doc_id").alias("class_id"), F.col("row").alias("class_row"), F.lit(0).cast("long").alias("n_links"))
    return joined.select("doc_id", "row", F.col("best.doc_id").alias("class_id"), F.col("best.row").alias("class_row"), "n_links").unionByName(empty)


def one_per_class(docs: DataFrame) -> DataFrame:
    """The documents that name their class; texts without words all stay, of rows equal in id and text one."""
    classes = near_duplicates(docs)
    names = classes.where(F.col("row") == F.col("class_row")).select("row").distinct()
    kept, taken = set_aside(docs, "_row")
    once = kept.withColumn("_row", row_key()).join(names.withColumnRenamed("row", "_row"), "_row", "left_semi")
    return put_back(once.dropDuplicates(["_row"]).drop("_row"), taken).select(*docs.columns)
