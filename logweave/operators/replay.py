"""Exact parallel replay of order-dependent grouping, as a prefix scan of miner states.

Some miners look at lines one by one and let each line change what later lines are compared with. Most
lines change nothing, though: they fall into a group that already covers them. ``replay`` uses that.

1. Lines are range-partitioned by (route, LineID) into blocks of bounded size. Routes are independent of
   each other; a hot route simply spans many blocks.
2. Every block is replayed on its own from an empty state. For routes inside one block this is final. For the others
   the lines that changed the state are the *delta* of the block (few, whatever the number of lines).
3. Deltas are combined over blocks in a tree: a node replays the deltas of ``FAN_IN`` children and keeps the lines
   that still change something. Back from the root, a node turns the state before it and the deltas of its
   children into the state before each child. So every block gets one state, whose size is that of the templates.
4. Every block is replayed again from its state. A change that was not in its delta, or one that a node of the tree had
   dropped, means that later states were wrong; then step 3 is repeated for that route with the new deltas. When there
   is none, each block started from the true state and the result equals a sequential run.

Each round makes at least one more block of an unfinished route exact, so the loop ends; usually two or
three rounds do. No task ever holds the lines of more than one block, or more than ``FAN_IN`` deltas and one state.

What a miner answers depends only on which tokens of a line equal tokens of its templates, or each other. ``Replay``
remembers the answer for this *shape* of a line, so a log of a few hundred templates costs a few look-ups a line.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.joins import lookup_join
from logweave.session import materialize, ship

BLOCK_LINES = 500_000
BLOCK_BYTES = 128 << 20
FAN_IN = 16
KNOWN_SHAPES = 200_000
STEP_LINES = 8192  # lines of a block that are Python objects at a time

INPUT = ["route", "level", "LineID", "content"]
_ROWS = "block long, route string, level int, LineID long, content string, leader long, Template string, changed boolean, new boolean"
_DELTA = "route string, level int, node long, LineID long, content string, kept boolean"
_STATES = "route string, node long, state binary, LineID long, leader long, Template string"


class Group:
    """Lines that share a template; ``leader`` is the LineID that opened it.

    ``view`` is a miner's own digest of the tokens, dropped when they change.
    """

    __slots__ = ("leader", "tokens", "view")

    def __init__(self, leader: int, tokens: list[str]):
        self.leader = leader
        self.tokens = tokens
        self.view = None


ALONE = "+"  # begins the content of a line whose group no other line can join, where contents are ``flagged``
NOT_ALONE = "-"  # and that of the others


class Replay:
    """Feeds the lines of one route to a miner and remembers answers while its state stands still.

    A miner with ``flagged`` takes contents that begin with ``ALONE`` or ``NOT_ALONE``; groups of lines alone are not kept.
    """

    def __init__(self, miner):
        self.miner = miner
        self.flagged = getattr(miner, "flagged", False)
        self.known: dict[tuple, Group] = {}
        self.one: dict[str, str] = {}  # the tokens that templates ever had; they share one string for a token

    def __getstate__(self):
        return self.miner, self.one, self.flagged

    def __setstate__(self, state):
        self.miner, self.one, self.flagged = state
        self.known = {}

    @property
    def vocabulary(self):
        return self.one.keys()

    def _shape(self, tokens: list[str]) -> tuple:
        """The tokens, those that no template ever had as numbers in the order of their first places."""
        words, others = self.one, {}
        return tuple([t if t in words else others.setdefault(t, len(others)) for t in tokens])

    def step(self, line_id: int, content: str) -> tuple[Group, bool]:
        alone = self.flagged and content.startswith(ALONE)
        tokens = (content[1:] if self.flagged else content).split(" ")
        shape = self._shape(tokens)
        group = self.known.get(shape)
        if group is not None:
            return group, False
        group = self.miner.find(tokens)
        found = group is not None
        if found:
            changed = self.miner.absorb(group, tokens)
        else:
            group = Group(line_id, [self.one.get(t, t) for t in tokens])
            changed = not alone and self.miner.open(group)
        if changed:
            self.known.clear()
            one = self.one.setdefault
            for t in tokens:
                one(t, t)
            group.tokens[:] = [one(t, t) for t in group.tokens]
        elif found:
            if len(self.known) >= KNOWN_SHAPES:
                self.known.clear()
            self.known[shape] = group
        return group, changed


# (level) -> miner with ``find(tokens) -> group or None``, ``open(group) -> changed`` and
# ``absorb(group, tokens) -> changed``
MinerFactory = Callable[[int], object]


def blocks_needed(n_lines: int | None, n_bytes: int | None, block_lines: int = BLOCK_LINES) -> int:
    return max(1, math.ceil((n_lines or 0) / block_lines), math.ceil((n_bytes or 0) / BLOCK_BYTES))


def size_of(lines: DataFrame) -> tuple[int | None, int | None]:
    """Number and bytes of contents."""
    return tuple(lines.agg(F.count("*"), F.sum(F.octet_length("content"))).first())


_LOG_END = "\0"  # between the name of a log and the route inside it


def root_of(log: str | None) -> Column:
    """The beginning of all routes of a log; ``log`` names the column that tells logs apart."""
    return F.concat(F.col(log), F.lit(_LOG_END)) if log else F.lit("")


def with_templates(df: DataFrame, mined: DataFrame, log: str | None) -> DataFrame:
    """``df`` with the ``Template`` of the replayed lines."""
    if not log:
        return df.join(mined.select("LineID", "Template"), "LineID", "left")
    named = mined.select(F.substring_index("route", _LOG_END, 1).alias(log), "LineID", "Template")
    return df.join(named, [log, "LineID"], "left")


def replay(lines: DataFrame, make_miner: MinerFactory, n_blocks: int) -> DataFrame:
    """``(route, level, LineID, content)`` to ``(route, LineID, leader, Template)``."""
    ship(lines.sparkSession)
    output = ["route", "LineID", "leader", "Template"]
    first = (
        lines.select(*INPUT)
        .repartitionByRange(n_blocks, "route", "LineID")
        .sortWithinPartitions("route", "LineID")
        .withColumn("block", F.spark_partition_id())
        .mapInArrow(_first_pass(make_miner, n_blocks > 1), _ROWS)
    )
    if n_blocks == 1:
        return first.select(*output)

    done = materialize(first)
    # rows that keep their content belong to the first or last route of their block
    ends = done.where("content is not null").groupBy("route").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    spanning = materialize(ends.where("low < high").select("route"))
    result = done.join(spanning, "route", "left_anti").select(*output)
    rows, lost = done.join(spanning, "route", "left_semi"), None
    while spanning.take(1):
        states = materialize(_scan(rows, make_miner, n_blocks, lost))
        before = states.where("state is not null").select("route", F.col("node").alias("block"), "state")
        known = rows.drop("leader", "Template", "new")
        done = materialize(known.groupBy("route", "block").cogroup(before.groupBy("route", "block")).applyInArrow(_next_pass, _ROWS))
        dropped = states.where("LineID is not null").select("route", "node", "LineID")
        spanning = materialize(done.where("new").select("route").union(dropped.select("route")).distinct())
        settled = done.join(spanning, "route", "left_anti").select(*output)
        shared = settled.where("Template is null").drop("Template")
        templates = states.where("leader is not null").select("route", "leader", "Template")
        templates = templates.join(shared.groupBy("route", "leader").agg(F.count("*").alias("n")), ["route", "leader"])
        shared = lookup_join(shared, templates, ["route", "leader"], weight="n").select(*output)
        result = result.unionByName(settled.where("Template is not null")).unionByName(shared)
        rows = done.join(spanning, "route", "left_semi")
        lost = dropped if lost is None else lost.unionByName(dropped)
    return result


def _first_pass(make_miner: MinerFactory, may_span: bool):
    """Blocks from an empty state. Rows of the first and the last route keep their content.

    A batch goes out when its last route has ended. Until then it is held as Arrow columns, beside one group a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route = run_ = None
        nth = -1  # of the route in the block
        held: list[tuple] = []

        def finished(last: int) -> Iterator[pa.RecordBatch]:
            for columns, groups, changed, places in held:
                texts: dict[int, str] = {}
                for group in groups:
                    if id(group) not in texts:
                        texts[id(group)] = " ".join(group.tokens)
                n = len(groups)
                keep = pa.array((places == 0) | (places == last) if may_span else np.zeros(n, bool))
                columns["content"] = pc.if_else(keep, columns["content"], pa.scalar(None, pa.string()))
                columns["leader"] = pa.array([g.leader for g in groups], pa.int64())
                columns["Template"] = pa.array([texts[id(g)] for g in groups], pa.string())
                columns["changed"] = pa.array(changed, pa.bool_())
                columns["new"] = pa.array(np.zeros(n, bool))
                yield pa.RecordBatch.from_arrays([columns[c].cast(t) for c, t in zip(_NAMES, _TYPES)], _NAMES)
            held.clear()

        for batch in batches:
            routes, levels, ids, contents = (batch.column(i).to_pylist() for i in range(4))
            groups, changed, places = [], [], []
            for row_route, row_level, line_id, content in zip(routes, levels, ids, contents):
                if row_route != route or run_ is None:
                    if run_ is not None and not groups:
                        yield from finished(-1)
                    route, nth, run_ = row_route, nth + 1, Replay(make_miner(row_level))
                group, new = run_.step(line_id, content)
                groups.append(group)
                changed.append(new)
                places.append(nth)
            if not groups:
                continue
            if places[0] != nth:
                yield from finished(-1)  # the batches before hold only routes that have ended
            own = pa.array(np.arange(batch.num_rows))  # copies, so that the batch itself can go
            columns = {c: batch.column(i).take(own) for i, c in enumerate(INPUT) if c != "route"}
            columns["route"] = batch.column(0).dictionary_encode()
            columns["block"] = batch.column(4).dictionary_encode()
            held.append((columns, groups, np.array(changed, bool), np.array(places, np.int32)))
        yield from finished(nth)

    return run


_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]


def _next_pass(key, rows, before):
    """A block from the state before it; ``new`` marks changes that were not expected."""
    rows = rows.sort_by("LineID")
    run = pickle.loads(before.column("state")[0].as_py())
    found: dict[str, list[pa.Array]] = {"leader": [], "Template": [], "changed": [], "new": []}
    for begin in range(0, len(rows), STEP_LINES):
        part = rows.slice(begin, STEP_LINES)
        ids = part.column("LineID").to_pylist()
        steps = [run.step(i, c) for i, c in zip(ids, part.column("content").to_pylist())]
        # a line that opened a group without a change has it for itself
        own = [" ".join(g.tokens) if g.leader == i and not c else None for i, (g, c) in zip(ids, steps)]
        new = [c and not e for (_, c), e in zip(steps, part.column("changed").to_pylist())]
        found["leader"].append(pa.array([g.leader for g, _ in steps], pa.int64()))
        found["Template"].append(pa.array(own, pa.string()))
        found["changed"].append(pa.array([c for _, c in steps], pa.bool_()))
        found["new"].append(pa.array(new, pa.bool_()))
    columns = {n: pa.chunked_array(found[n], t) if n in found else rows.column(n) for n, t in zip(_NAMES, _TYPES)}
    return pa.table(columns)


def _scan(rows: DataFrame, make_miner: MinerFactory, n_blocks: int, lost: DataFrame | None) -> DataFrame:
    """What ``_STATES`` says: the ``state`` before each block, ``LineID`` of changes that a node of the tree dropped, and
    ``Template`` of each ``leader`` at the end. ``lost`` are the changes dropped in earlier rounds."""
    places = rows.select("route", "level", F.col("block").alias("node")).distinct()
    delta = rows.where("changed").select("route", "level", F.col("block").alias("node"), "LineID", "content", F.lit(True).alias("kept"))
    if lost is not None:
        must = lost.select("route", "LineID").distinct().withColumn("must", F.lit(True))
        delta = delta.join(must, ["route", "LineID"], "left")
    else:
        delta = delta.withColumn("must", F.lit(False))
    delta = delta.withColumn("must", F.coalesce("must", F.lit(False)))

    def thinned(key, children):
        children = children.sort_by("LineID")
        run = Replay(make_miner(children.column("level")[0].as_py()))
        steps = zip(children.column("LineID").to_pylist(), children.column("content").to_pylist(), children.column("must").to_pylist())
        kept = [run.step(i, c)[1] or must for i, c, must in steps]
        return children.drop_columns(["up"]).set_column(children.column_names.index("kept"), "kept", pa.array(kept, pa.bool_()))

    tree, nodes = [], n_blocks
    while nodes > FAN_IN:  # from the blocks up
        up = F.floor(F.col("node") / FAN_IN)
        known = delta.withColumn("up", up).select("route", "level", "node", "LineID", "content", "kept", "must", "up")
        annotated = materialize(known.groupBy("route", "up").applyInArrow(thinned, _DELTA + ", must boolean"))
        tree.append((annotated, places))
        delta, places = annotated.where("kept").withColumn("node", up).withColumn("kept", F.lit(True)), places.withColumn("node", up).distinct()
        nodes = math.ceil(nodes / FAN_IN)
    tree.append((delta, places))

    def spread(root: bool):
        def states(key, group):
            """The state before each child, from the one before the node and the deltas of the children."""
            group = group.sort_by([("node", "ascending"), ("LineID", "ascending")])
            columns = [group.column(c).to_pylist() for c in ("node", "LineID", "content", "kept", "state")]
            start = next((s for s in columns[4] if s is not None), None)
            run = pickle.loads(start) if start else Replay(make_miner(group.column("level")[0].as_py()))
            route, out, groups, last = key[0].as_py(), [], {}, None
            for node, line_id, content, kept, state in zip(*columns):
                if state is not None:
                    continue
                if node != last:
                    out.append((route, node, pickle.dumps(run), None, None, None))
                    last = node
                if line_id is not None:
                    met, changed = run.step(line_id, content)
                    groups[met.leader] = met
                    if changed and not kept:
                        out.append((route, node, None, line_id, None, None))
            if root:
                out += [(route, None, None, None, leader, " ".join(g.tokens)) for leader, g in groups.items()]
            return pa.table([pa.array(c, t) for c, t in zip(zip(*out), _STATE_TYPES)], _STATE_NAMES)

        return states

    found = below = None
    for delta, places in reversed(tree):  # and down again
        given = delta.select("route", "level", "node", "LineID", "content", "kept", F.lit(None).cast("binary").alias("state"))
        empty = places.select("route", "level", "node", F.lit(None).cast("long").alias("LineID"), F.lit(None).cast("string").alias("content"), F.lit(True).alias("kept"), F.lit(None).cast("binary").alias("state"))
        up = F.floor(F.col("node") / FAN_IN) if below is not None else F.lit(0).cast("long")
        group = given.unionByName(empty).withColumn("up", up)
        if below is not None:
            start = below.where("state is not null").select(
                "route", F.lit(0).alias("level"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("LineID"),
                F.lit(None).cast("string").alias("content"), F.lit(True).alias("kept"), "state", F.col("node").alias("up"),
            )
            group = group.unionByName(start)
        states = materialize(group.groupBy("route", "up").applyInArrow(spread(below is None), _STATES))
        rest = states.where("LineID is not null or leader is not null")
        found = rest if found is None else found.unionByName(rest)
        below = states
    return found.unionByName(below.where("state is not null"))


_STATE_NAMES = [c.split()[0] for c in _STATES.split(", ")]
_STATE_TYPES = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
