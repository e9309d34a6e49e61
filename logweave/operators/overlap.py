"""Lines that have many tokens in common with another line, found in blocks, whatever the order of the lines.

A line is a list of keys, one for a token and how often the line had it before, so common keys count common tokens, repeated ones apart;
or one for a token and its place, so common keys count equal places.
Two lines are *alike* if they have as many keys in common as both ask for or, with an ``order``, as the later one asks for. In the order of how often a block has a key, rare
ones first, two lines with ``o`` common keys of which one has ``n`` share ``SURE`` of their first ``n - o + SURE`` keys, so only these are
listed and counted, and the few lines that reach ``SURE`` are compared key by key. Keys are hashes; two that collide make lines alike that are
not, never the other way round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.joins import lookup_join
from logweave.session import materialize, ship

ROWS = 32_768  # lines of a block
BYTES = 16 << 20  # and bytes of their contents
FEW = 4096  # lines that are not dealt to several blocks
SURE = 10  # common keys that are counted before lines are compared
KNOWN_TOKENS = 1_000_000
MOST_PARTITIONS = 2000


def keys_of(contents: list[str], by_place: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The keys of lines one after the other, and the ``n + 1`` places where lines begin."""
    known: dict[str, int] = {}
    hashes, nth, places = [], [], [0]
    for content in contents:
        seen: dict[str, int] = {}
        for place, t in enumerate(content.split(" ")):
            n = seen.get(t, 0)
            seen[t] = n + 1
            h = known.get(t)
            if h is None:
                if len(known) >= KNOWN_TOKENS:
                    known.clear()
                h = known[t] = crc32(t.encode("utf-8", "surrogatepass"))
            hashes.append(h)
            nth.append(place if by_place else n)
        places.append(len(hashes))
    keys = np.array(hashes, np.uint64) + np.array(nth, np.uint64) * np.uint64(0x9E3779B1)
    return keys.astype(np.uint32), np.array(places, np.int64)


class _Side:
    """The ranks of the keys of each line in ascending order, 0 for keys the index does not have."""

    def __init__(self, rank: np.ndarray, places: np.ndarray, asks: np.ndarray, common: np.ndarray):
        self.places, self.sizes, self.asks = places, np.diff(places), asks
        row = np.repeat(np.arange(len(self.sizes), dtype=np.int64), self.sizes)
        self.ranks = np.sort(row << 32 | rank) & 0xFFFFFFFF
        first = np.minimum(self.sizes - common + SURE, self.sizes)
        self.listed = np.arange(len(row)) - np.repeat(places[:-1], self.sizes) < np.repeat(first, self.sizes)
        self.row = row

    def keys(self, row: int) -> np.ndarray:
        return self.ranks[self.places[row] : self.places[row + 1]]


def _asks(places: np.ndarray, least: Callable[[int], int]) -> np.ndarray:
    different, at = np.unique(np.diff(places), return_inverse=True)
    return np.array([least(n) for n in different.tolist()], np.int64)[at]


def _cut(side: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` keys of each line."""
    sizes = np.diff(side[1])
    nth = np.arange(len(side[0])) - np.repeat(side[1][:-1], sizes)
    return side[0][nth < size], np.concatenate([[0], np.cumsum(np.minimum(sizes, size))])


def alike(
    left: tuple[np.ndarray, np.ndarray],
    right: tuple[np.ndarray, np.ndarray] | None,
    least: Callable[[int], int],
    order: tuple[np.ndarray, np.ndarray | None] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Which lines of ``left``, and of ``right``, are alike to one of the other side; without ``right`` to another of ``left``.

    A side is what ``keys_of`` returns; a line with ``n`` keys asks for ``least(n)``. ``order`` are the numbers of the lines of both sides,
    whose keys are by place.
    """
    asks = [_asks(side[1], least) for side in (left, left if right is None else right)]
    if not len(asks[0]) or not len(asks[1]):
        return tuple(np.zeros(len(a), bool) for a in asks)
    common, fewest = asks, SURE
    if order is not None:
        common, fewest = [np.minimum(a, b.min()) for a, b in zip(asks, asks[::-1])], asks[0].min()
        when, then = order[0], order[0] if right is None else order[1]
        if right is not None:  # no place behind the longest line of the other side can be equal
            left, right = _cut(left, int(np.diff(right[1]).max())), _cut(right, int(np.diff(left[1]).max()))

    def needed_by(rows, p):
        ask = asks[1][p]
        if order is None:
            return np.maximum(asks[0][rows], ask)
        of = asks[0][rows]
        return np.where(when[rows] > then[p], of, np.where(when[rows] < then[p], ask, np.minimum(of, ask)))

    names, at, often = np.unique(left[0], return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, often))] = np.arange(1, len(names) + 1)
    index = _Side(rank[at], left[1], asks[0], common[0])
    probe = index
    if right is not None:
        place = np.minimum(np.searchsorted(names, right[0]), len(names) - 1)
        probe = _Side(np.where(names[place] == right[0], rank[place], 0), right[1], asks[1], common[1])
    listed = index.ranks[index.listed]
    by_key = np.argsort(listed, kind="stable")
    rows, first = index.row[index.listed][by_key], np.searchsorted(listed[by_key], np.arange(len(names) + 2))
    found = np.zeros(len(index.sizes), bool)
    mine = found if right is None else np.zeros(len(probe.sizes), bool)
    held = np.zeros(len(names) + 1, bool)
    own = np.concatenate([[0], np.cumsum(probe.listed)])[probe.places]
    keys = probe.ranks[probe.listed]
    begins, ends = first[keys], first[keys + 1]
    ends = np.where(keys == 0, begins, ends)
    for p in range(len(probe.sizes)):
        lists = [rows[a:b] for a, b in zip(begins[own[p] : own[p + 1]].tolist(), ends[own[p] : own[p + 1]].tolist()) if a < b]
        if not lists:
            continue
        ask, size = probe.asks[p], probe.sizes[p]
        met = np.bincount(np.concatenate(lists))
        near = np.flatnonzero(met >= min(SURE, ask, fewest))
        needed = needed_by(near, p)
        near = near[(met[near] >= np.minimum(SURE, needed)) & (needed <= np.minimum(index.sizes[near], size))]
        if right is None:
            near = near[near != p]
        if mine[p]:
            near = near[~found[near]]
        if not len(near):
            continue
        all_ = probe.keys(p)
        held[all_] = True
        held[0] = False
        for row in near.tolist():
            if (not mine[p] or not found[row]) and np.count_nonzero(held[index.keys(row)]) >= needed_by(row, p):
                found[row] = mine[p] = True
        held[all_] = False
    return found, mine


def _side(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = rows.column("keys").combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    places = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint32), places - places[0]


def blocks_of(n_lines, n_bytes):
    """The number of blocks of a route, a column; at least four of a large one, so that its pairs of blocks keep several cores busy."""
    return F.greatest(F.ceil(n_lines / ROWS), F.ceil(n_bytes / BYTES), F.least(F.ceil(n_lines / FEW), F.lit(4).cast("long")))


def alike_rows(lines: DataFrame, groups: int, least: Callable[[int], int], order: str | None = None) -> DataFrame:
    """The ``row`` of each of ``lines`` (``row``, ``route``, ``content``, ``blocks`` of the route) that is alike to another one of its route.

    ``groups`` is the number of pairs of blocks; ``order`` names the column of the numbers of lines, whose keys are by place then.
    Lines of about equal length are in one block.
    """
    ship(lines.sparkSession)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = keys_of(batch.column("content").to_pylist(), order is not None)
            lists = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(keys.view(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "route", "blocks", "at")), lists], ["row", "route", "blocks", "at", "keys"])

    def compare(key, rows):
        one, two = (rows.filter(pc.equal(rows.column("side"), s)) for s in (0, 1))
        alone = key[1].as_py() == key[2].as_py()
        when = None if order is None else tuple(x.column("at").to_numpy() for x in (one, two))
        found, mine = alike(_side(one), None if alone else _side(two), least, when)
        parts = [one.column("row").to_numpy()[found]] + ([] if alone else [two.column("row").to_numpy()[mine]])
        return pa.table({"row": pa.array(np.concatenate(parts), pa.int64())})

    at = F.coalesce(F.col(order), F.lit(-(1 << 62))) if order else F.lit(0).cast("long")
    given = lines.select("row", "route", "blocks", "content", at.alias("at"))
    keyed = materialize(given.mapInArrow(number, "row long, route string, blocks long, at long, keys array<int>")).withColumn("size", F.size("keys"))
    sizes = keyed.groupBy("route", "size").agg(F.count("*").alias("n"))
    before = Window.partitionBy("route").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("of", F.sum("n").over(Window.partitionBy("route")))
    share = F.col("before") + F.col("rows") * (F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / (1 << 20))
    placed = lookup_join(keyed, sizes.withColumn("rows", F.col("n")), ["route", "size"], weight="n")
    own = F.least(F.floor(share * F.col("blocks") / F.col("of")), F.col("blocks") - 1).cast("long")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = placed.withColumn("own", own).withColumn("other", other)
    met = met.select("row", "route", "at", "keys", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    pairs = met.repartition(min(4 * groups, MOST_PARTITIONS), "route", "i", "j").groupBy("route", "i", "j").applyInArrow(compare, "row long")
    return materialize(pairs.distinct())
