"""Drain and Jaccard-Drain: prefix trees over the first tokens, with groups at their leaves.

The tree itself is a Spark job. Which child a line enters depends only on the order in which the keys of
a node first appear: the first ``children - 1`` distinct keys get a child of their own, later ones share
the wildcard child. So the leaf of every line follows from ``min(LineID)`` per key path, and leaves can be
replayed independently of each other. One exception: where a token equals the wildcard itself, unknown
keys may match inside that child before they get their own; such a node is replayed as one route.

*Free text* fills the leaves of rare keys with groups of one line. Where lines of the largest leaves are rarely alike, lines are compared
inside their leaves first (``overlap``, in blocks, in parallel). A group that no line has joined is joined by a line that has enough tokens in
the same places, so a line that is not alike to any other of its leaf opens a group that is not kept for later lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.text import WILDCARD, tokenize
from logweave.operators.joins import lookup_join
from logweave.operators.overlap import alike, alike_rows, blocks_of, keys_of
from logweave.operators.replay import ALONE, BLOCK_LINES, NOT_ALONE, Group, blocks_needed, replay, root_of, with_templates
from logweave.session import materialize, ship

FEW_PATHS = 100_000
RUN = 512  # groups of a leaf that are not indexed yet
MANY = 12  # groups of a leaf that are compared with a line at once
LARGE = 2000  # lines of a leaf that is worth comparing its lines first
FREE_LEAVES = 8  # the largest leaves, of which samples are compared
FREE_SAMPLE = 256  # lines of each
FREE_SHARE = 0.25  # of them that are alike to another one, at most
FREE_BYTES = 16 << 20  # of contents in a block of free text


@dataclass(frozen=True)
class TreeRules:
    """What the two miners do differently."""

    levels: int  # keys between the root and a leaf
    children: int
    threshold: float
    count_is_key: bool  # the token count is the first key
    stores_from: int  # lines with fewer tokens open a group that no later line can find
    line_view: Callable[[list[str]], object]  # what ``score`` needs of a line
    template_view: Callable[[list[str]], object]  # and of a template
    score: Callable[[object, object], tuple[float, int]]  # (similarity, wildcards of the template)
    merge: Callable[[list[str], list[str]], list[str]]
    by_position: bool  # whether ``score`` compares tokens at equal places

    def keys(self, tokens: list[str]) -> list[str]:
        if self.count_is_key:
            return [str(len(tokens)), *tokens[: self.levels - 1]]
        return tokens[: self.levels]


class _Leaf(list):
    """The groups of a leaf and, once there are ``MANY``, their templates as one matrix of token numbers.

    All but the last rows are indexed by place and token, in runs of sorted keys that are merged as they grow. A line that must
    share ``least`` of ``n`` known tokens with a template shares one of any ``n - least + 1``, so the rarest of these
    lead to all rows that can match. What a row has lost since is seen when it is compared; rows that became longer are loose.
    """

    def __init__(self):
        self.table = None  # a row a group, 0 where a template has ended
        self.runs: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # first row, row behind the last, keys, their rows
        self.loose: set[int] = set()

    def __reduce__(self):
        return _Leaf, (), None, iter(self)  # the matrix is made again

    def write(self, row: int, template: list[str], numbers: dict[str, int]) -> None:
        height, width = self.table.shape
        if row >= height or len(template) > width:
            grown = np.zeros((2 * row if row >= height else height, max(width, len(template))), np.int32)
            grown[:height, :width] = self.table
            self.table = grown
        if row < self._indexed() and np.count_nonzero(self.table[row]) < len(template):
            self.loose.add(row)
        self.table[row] = 0
        self.table[row, : len(template)] = [numbers.setdefault(t, len(numbers) + 1) for t in template]

    def _indexed(self) -> int:
        return self.runs[-1][1] if self.runs else 0

    def _index(self) -> None:
        first, end = self._indexed(), len(self)
        while self.runs and self.runs[-1][1] - self.runs[-1][0] <= end - first:
            first = self.runs.pop()[0]
        row, place = np.nonzero(self.table[first:end])
        keys = place.astype(np.int64) << 32 | self.table[first:end][row, place]
        order = np.argsort(keys, kind="stable")
        self.runs.append((first, end, keys[order], (first + row[order]).astype(np.int32)))
        self.loose = {r for r in self.loose if r < first}

    def _candidates(self, line: np.ndarray, least: int) -> np.ndarray | None:
        """Rows that may equal the line in ``least`` places, in their order; ``None`` for all."""
        if len(self) - self._indexed() >= RUN:
            self._index()
        if not self.runs or least < 1:
            return None
        place = np.flatnonzero(line > 0)
        if len(place) < least:
            return np.zeros(0, np.int64)
        keys = place.astype(np.int64) << 32 | line[place]
        spans = [(np.searchsorted(run[2], keys), np.searchsorted(run[2], keys, "right")) for run in self.runs]
        held = sum(high - low for low, high in spans)
        chosen = np.argsort(held, kind="stable")[: len(place) - least + 1]
        found = [np.arange(self._indexed(), len(self)), np.fromiter(self.loose, np.int64)]
        for (low, high), run in zip(spans, self.runs):
            found += [run[3][low[k] : high[k]] for k in chosen if low[k] < high[k]]
        return np.unique(np.concatenate(found))

    def nearest(self, tokens: list[str], numbers: dict[str, int], least: int) -> tuple[int, int] | None:
        """The first row of the highest rank and its number of equal tokens, if ``least`` are."""
        if self.table is None:
            self.table = np.zeros((len(self), 1), np.int32)
            for row, group in enumerate(self):
                self.write(row, group.tokens, numbers)
        width = min(len(tokens), self.table.shape[1])
        # what no template has equals nothing, nor does the wildcard
        line = np.array([-1 if t == WILDCARD else numbers.get(t, -1) for t in tokens[:width]], np.int32)
        may = self._candidates(line, least)
        rows = self.table[: len(self), :width] if may is None else self.table[may, :width]
        if not len(rows):
            return None
        equal = np.count_nonzero(rows == line, axis=1)
        most = int(equal.max())
        if most < least:
            return None
        best = np.flatnonzero(equal == most)
        if len(best) > 1:
            wildcards = np.count_nonzero(rows[best] == numbers.get(WILDCARD, -2), axis=1)
            best = best[wildcards.argmax() :]
        return int(best[0] if may is None else may[best[0]]), most


@lru_cache(maxsize=1 << 16)
def _least_equal(n: int, threshold: float) -> int:
    """The fewest of ``n`` tokens whose share is above the threshold."""
    return next((k for k in range(n + 1) if _ratio(k, n) > threshold), n + 1)


class PrefixTreeMiner:
    """The part of the tree below a route; usually just one leaf."""

    def __init__(self, rules: TreeRules, level: int, flagged: bool = False):
        self.rules = rules
        self.level = level
        self.flagged = flagged
        self.root: tuple[dict, _Leaf] = ({}, _Leaf())
        self.numbers: dict[str, int] = {}  # of the tokens in the matrices of leaves
        self.met: tuple[_Leaf, int] | None = None  # where the last group was found

    def __getstate__(self):
        return self.rules, self.level, self.root, self.flagged

    def __setstate__(self, state):
        self.rules, self.level, self.root, self.flagged = state
        self.numbers, self.met = {}, None

    def _keys(self, tokens: list[str]) -> list[str]:
        return self.rules.keys(tokens)[self.level :]

    def find(self, tokens: list[str]) -> Group | None:
        node = self.root
        for key in self._keys(tokens):
            children = node[0]
            node = children.get(key) or children.get(WILDCARD)
            if node is None:
                return None
        self.met = None
        if self.rules.by_position and len(node[1]) >= MANY:
            found = node[1].nearest(tokens, self.numbers, _least_equal(len(tokens), self.rules.threshold))
            if found is None:
                return None
            self.met = node[1], found[0]
            return node[1][found[0]]
        best, best_rank = None, None
        line, score = self.rules.line_view(tokens), self.rules.score
        for group in node[1]:
            rank = score(line, self._view(group))
            if best is None or rank > best_rank:
                best, best_rank = group, rank
        if best is not None and best_rank[0] > self.rules.threshold:
            return best
        return None

    def _view(self, group: Group):
        if group.view is None:
            group.view = self.rules.template_view(group.tokens)
        return group.view

    def absorb(self, group: Group, tokens: list[str]) -> bool:
        merged = self.rules.merge(tokens, group.tokens)
        if merged == group.tokens:
            return False
        group.tokens, group.view = merged, None
        if self.met is not None:
            leaf, row = self.met
            leaf.write(row, merged, self.numbers)
        return True

    def open(self, group: Group) -> bool:
        node, grown = self.root, False
        for key in self._keys(group.tokens):
            children = node[0]
            if key not in children and len(children) + 1 >= self.rules.children:
                key = WILDCARD
            grown = grown or key not in children
            node = children.setdefault(key, ({}, _Leaf()))
        if len(group.tokens) < self.rules.stores_from:
            return grown
        node[1].append(group)
        if node[1].table is not None:
            node[1].write(len(node[1]) - 1, group.tokens, self.numbers)
        return True


@lru_cache(maxsize=1 << 16)
def _ratio(part: int, whole: int) -> float:
    return float(np.float32(part) / np.float32(whole))


def _position_score(tokens: list[str], template: list[str]) -> tuple[float, int]:
    compared = template if len(template) <= len(tokens) else template[: len(tokens)]
    wildcards = compared.count(WILDCARD)
    equal = sum(map(eq, tokens, compared))
    if wildcards and WILDCARD in tokens:
        equal -= sum(a == b == WILDCARD for a, b in zip(tokens, compared))
    return _ratio(equal, len(tokens)), wildcards


def _position_merge(tokens, template):
    merged = [a if a == b else WILDCARD for a, b in zip(tokens, template)]
    return merged + tokens[len(merged) :]


@lru_cache(maxsize=1 << 16)
def _boosted(part: int, whole: int) -> float:
    similarity = np.float32(part) / np.float32(whole) if whole else np.float32(1)
    return float(min(similarity * np.float32(1.3), np.float32(1)))


def _constants(template: list[str]) -> tuple[frozenset[str], int]:
    return frozenset(template) - {WILDCARD}, template.count(WILDCARD)


def _set_score(line: frozenset[str], view: tuple[frozenset[str], int]) -> tuple[float, int]:
    constants, wildcards = view
    common = len(line & constants)
    return _boosted(common, len(line) + len(constants) - common), wildcards


def _set_merge(tokens, template):
    if len(tokens) == len(template):
        return _position_merge(tokens, template)
    longer, other = (tokens, template) if len(tokens) > len(template) else (template, tokens)
    other = set(other)
    return [t if t in other else WILDCARD for t in longer]


def drain_rules(depth: int = 4, children: int = 100, sim_thr: float = 0.4) -> TreeRules:
    if depth < 3:
        raise ValueError("depth must be at least 3")
    return TreeRules(
        levels=depth - 1,
        children=children,
        threshold=float(np.float32(sim_thr)),
        count_is_key=True,
        stores_from=depth - 1,
        line_view=list,
        template_view=list,
        score=_position_score,
        merge=_position_merge,
        by_position=True,
    )


def jaccard_rules(depth: int = 4, children: int = 100, sim_thr: float = 0.4) -> TreeRules:
    if depth < 2:
        raise ValueError("depth must be at least 2")
    return TreeRules(
        levels=depth - 1,
        children=children,
        threshold=float(np.float32(sim_thr)),
        count_is_key=False,
        stores_from=depth,
        line_view=frozenset,
        template_view=_constants,
        score=_set_score,
        merge=_set_merge,
        by_position=False,
    )


def mine_drain(df: DataFrame, depth=4, children=100, sim_thr=0.4, block_lines=BLOCK_LINES, log: str | None = None) -> DataFrame:
    return _mine(df, drain_rules(depth, children, sim_thr), block_lines, log)


def mine_jaccard_drain(df: DataFrame, depth=4, children=100, sim_thr=0.4, block_lines=BLOCK_LINES, log: str | None = None) -> DataFrame:
    return _mine(df, jaccard_rules(depth, children, sim_thr), block_lines, log)


def _mine(df: DataFrame, rules: TreeRules, block_lines: int, log: str | None) -> DataFrame:
    """``log`` names a column that tells several logs apart; each has a root of its own in the tree."""
    lines = df.where(F.col("content").isNotNull()).select(root_of(log).alias("root"), "LineID", "content")
    keyed = lines.withColumn("keys", _key_column(rules))
    paths = materialize(
        keyed.groupBy("root", "keys").agg(
            F.min("LineID").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes")
        )
    )
    different, *size = paths.agg(F.count("*"), F.sum("n"), F.sum("bytes")).first()
    n_blocks = blocks_needed(*size, block_lines)
    if different > FEW_PATHS and _plain(paths, rules):
        # the keys are the route
        routed = keyed.select(
            "LineID",
            "content",
            F.when(F.size("keys") == rules.levels, F.concat("root", F.array_join("keys", " "))).alias("route"),
            F.lit(rules.levels).alias("level"),
        )
    else:
        routes = (_few_routes if different <= FEW_PATHS else _routes)(paths, rules)
        routed = lookup_join(keyed, routes.select("root", "keys", "route", "level", "n"), ["root", "keys"], weight="n")
    routed = routed.where(F.col("route").isNotNull())
    flagged = _flagged(routed, rules) if rules.by_position and (size[0] or 0) >= LARGE else None
    if flagged is not None:
        routed, n_blocks = flagged, max(n_blocks, -(-size[1] // FREE_BYTES))
    is_flagged = flagged is not None
    mined = replay(routed, lambda level: PrefixTreeMiner(rules, level, is_flagged), n_blocks)
    # lines that end above the leaves are not replayed and keep their own text
    return with_templates(df, mined, log).withColumn("Template", F.coalesce("Template", "content"))


def _flagged(routed: DataFrame, rules: TreeRules) -> DataFrame | None:
    """``routed`` with ``ALONE`` or ``NOT_ALONE`` before the contents; ``None`` if its large leaves are not free text."""
    leaves = routed.where(F.col("level") == rules.levels).groupBy("route")
    sizes = leaves.agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes")).where(F.col("n") >= LARGE)
    sizes = materialize(sizes.withColumn("blocks", blocks_of(F.col("n"), F.col("bytes"))))
    groups = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2).alias("n")).first()["n"]
    if groups is None:
        return None
    least = lambda n: _least_equal(n, rules.threshold)
    largest = sizes.orderBy(F.desc("n"), "route").limit(FREE_LEAVES).select("route")
    nth = F.row_number().over(Window.partitionBy("route").orderBy(F.xxhash64("LineID", "content"), "LineID"))
    sample = routed.join(F.broadcast(largest), "route").withColumn("nth", nth).where(F.col("nth") <= FREE_SAMPLE)
    texts: dict[str, list[tuple[str, int]]] = {}
    for row in sample.select("route", "content", "nth").toLocalIterator():
        texts.setdefault(row.route, []).append((row.content, row.nth))
    found = [alike(keys_of([c for c, _ in own], by_place=True), None, least, (np.array([n for _, n in own]), None))[0] for own in texts.values()]
    if np.concatenate(found).mean() > FREE_SHARE:
        return None
    rows = materialize(routed.select("route", "level", "LineID", "content").withColumn("row", F.monotonically_increasing_id()))
    placed = materialize(lookup_join(rows, sizes.select("route", "blocks", "n"), "route", weight="n", how="left"))
    met = alike_rows(placed.where("blocks is not null"), int(groups), least, "LineID").withColumn("met", F.lit(True))
    alone = F.col("blocks").isNotNull() & F.col("met").isNull() & (F.col("level") == rules.levels)
    content = F.concat(F.when(alone, F.lit(ALONE)).otherwise(F.lit(NOT_ALONE)), "content").alias("content")
    return materialize(placed.join(met, "row", "left").select("route", "level", "LineID", content))


def _key_column(rules: TreeRules) -> Column:
    tokens = tokenize(F.col("content"))
    if rules.count_is_key:
        return F.concat(F.array(F.size(tokens).cast("string")), F.slice(tokens, 1, rules.levels - 1))
    return F.slice(tokens, 1, rules.levels)


def _plain(paths: DataFrame, rules: TreeRules) -> bool:
    """Whether every key has a child of its own, or no line reaches a leaf at all."""
    nodes = (
        paths.select("root", "keys", F.posexplode("keys").alias("level", "key"))
        .select("root", F.slice("keys", F.lit(1), F.col("level")).alias("node"), "key", F.size("keys").alias("size"))
        .groupBy("root", "node")
        .agg(
            F.count_distinct("key").alias("n"),
            F.max((F.col("key") == WILDCARD).cast("int")).alias("wild"),
            F.max("size").alias("size"),
        )
        .agg(F.max("n").alias("n"), F.max("wild").alias("wild"), F.max("size").alias("size"))
        .first()
    )
    if nodes["n"] is None:
        return True
    return not nodes["wild"] and (nodes["n"] < rules.children or nodes["size"] < rules.levels)


def _few_routes(paths: DataFrame, rules: TreeRules) -> DataFrame:
    """``_routes`` of at most ``FEW_PATHS`` key paths, all in one task: a few kilobytes in a log, and one job instead of
    several a level."""

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        table = table.sort_by("first")
        keys = table.column("keys").to_pylist()
        route, level, mixed = table.column("root").to_pylist(), [0] * len(keys), [False] * len(keys)
        for depth in range(rules.levels):
            met: dict[str, dict[str, None]] = {}  # the keys of a node in the order of their first lines
            for i, own in enumerate(keys):
                if not mixed[i] and len(own) > depth:
                    met.setdefault(route[i], {})[own[depth]] = None
            named = {node: set(list(found)[: rules.children - 1]) for node, found in met.items()}
            for i, own in enumerate(keys):
                node = route[i]
                mixed[i] = mixed[i] or WILDCARD in met.get(node, ())
                if not mixed[i] and len(own) > depth:
                    route[i] = f"{node} ={own[depth]}" if own[depth] in named[node] else f"{node} *"
                    level[i] = depth + 1
        ends = [r if m or len(own) == rules.levels else None for r, m, own in zip(route, mixed, keys)]
        arrays = [table.column("root").combine_chunks(), table.column("keys").combine_chunks(), pa.array(ends, pa.string()), pa.array(level, pa.int32()), table.column("n").combine_chunks()]
        yield pa.RecordBatch.from_arrays(arrays, ["root", "keys", "route", "level", "n"])

    ship(paths.sparkSession)
    rows = paths.select("root", "keys", "first", "n").coalesce(1)
    return rows.mapInArrow(routes, "root string, keys array<string>, route string, level int, n long")


def _routes(paths: DataFrame, rules: TreeRules) -> DataFrame:
    """Per key path its ``route`` (NULL if it ends above the leaves) and the ``level`` the route reaches."""
    paths = paths.withColumns({"route": F.col("root"), "level": F.lit(0), "mixed": F.lit(False)})
    for level in range(rules.levels):
        paths = materialize(_one_level(paths.withColumn("key", F.get("keys", F.lit(level))), rules, level))
    ends_at_leaf = F.col("mixed") | (F.size("keys") == rules.levels)
    return paths.withColumn("route", F.when(ends_at_leaf, F.col("route"))).drop("mixed")


def _one_level(paths: DataFrame, rules: TreeRules, level: int) -> DataFrame:
    keys = (
        paths.where(~F.col("mixed") & F.col("key").isNotNull())
        .groupBy("route", "key")
        .agg(F.min("first").alias("first"))
    )
    # Spark cuts every node to its first keys before the shuffle, so nodes with many keys do not travel
    own = (
        keys.withColumn("place", F.row_number().over(Window.partitionBy("route").orderBy("first")))
        .where(F.col("place") <= rules.children - 1)
        .select("route", "key", F.lit(True).alias("own"))
    )
    wild = keys.where(F.col("key") == WILDCARD).select("route", F.lit(True).alias("wild"))
    step = F.when(F.col("own"), F.concat(F.lit(" ="), F.col("key"))).otherwise(F.lit(" *"))
    moves = ~F.col("mixed") & F.col("key").isNotNull()
    return (
        paths.join(wild, "route", "left")
        .join(own, ["route", "key"], "left")
        .withColumn("mixed", F.col("mixed") | F.coalesce("wild", F.lit(False)))
        .withColumn("level", F.when(moves, F.lit(level + 1)).otherwise(F.col("level")))
        .withColumn("route", F.when(moves, F.concat("route", step)).otherwise(F.col("route")))
        .drop("key", "own", "wild")
    )
