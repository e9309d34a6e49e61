"""Density clustering of vectors (DBSCAN).

All pairs within ``eps`` are found block by block: places are ordered by a grid on their leading axes and packed into blocks of
``CELL_POINTS`` rows, blocks into groups. A task compares two groups, of which it holds no more than ``2 * GROUP`` places; groups and
blocks whose bounding boxes are farther apart than ``eps`` are passed over. A product of two blocks in single precision decides
all pairs but those within its rounding error of ``eps``, which are computed again in double precision. No pair leaves
its task: degrees, a spanning forest of the links and the smallest cluster next to a place do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.components import connected_components
from logweave.operators.joins import lookup_join
from logweave.operators.sequence import with_rank
from logweave.session import materialize, ship

GRID_AXES = 3
CELL_POINTS = 1024  # places of a block, compared at once with those of another
GROUP = 1 << 15  # places of either side of a task
GROUPS = 16  # fewer only if blocks are not full
NOISE = -1


def neighbour_counts(points: DataFrame, eps: float) -> DataFrame:
    """``(id, vector)`` to ``(id, neighbours)``: points within ``eps``, the point itself included."""
    places = _numbered(points, eps)
    counted = _degrees(places, eps).join(places.select("nr", "place", "weight"), "nr").drop("nr")
    return lookup_join(_ids(points, eps), counted, "place", weight="weight").select(
        "id", F.col("degree").alias("neighbours")
    )


def density_clusters(points: DataFrame, eps: float, min_points: int = 5) -> DataFrame:
    """``(id, vector)`` to ``(id, cluster)``, clusters numbered from 0 by their smallest id, noise -1.

    Equal vectors are one weighted place. Places fall into small boxes whose diagonal is ``eps``, so all
    core places of a box belong together and the graph to connect has boxes, not points, as nodes: a
    crowd of near-equal vectors is a handful of nodes instead of all its pairs.
    """
    places = _numbered(points, eps)
    cores = _degrees(places, eps).where(F.col("degree") >= min_points).select("nr")
    places = materialize(
        places.join(cores.withColumn("core", F.lit(True)), "nr", "left").withColumn(
            "core", F.coalesce("core", F.lit(False))
        )
    )
    # places are numbered by their first ids, a box without any id is in no cluster
    named = F.when(F.col("first").isNotNull(), F.col("nr"))
    boxes = places.where("core").groupBy("box").agg(F.min(named).alias("node"), F.count("*").alias("n"))
    core_places = materialize(lookup_join(places.where("core"), boxes, "box", weight="n").where("node is not null"))
    # what belongs together in a group comes first, so that two groups report few links
    for which in ("a = b", "a < b"):
        edges = _tiles(_packed(core_places, "node"), None, eps, _forest, "u long, v long", which)
        linked = core_places.join(connected_components(edges), "node", "left")
        core_places = materialize(linked.withColumn("node", F.coalesce("component", "node")).drop("component"))
    core_places = core_places.withColumnRenamed("node", "component")
    # a border place joins the neighbouring cluster of the smallest name
    others = places.where("not core")
    border = _tiles(_packed(others, "nr"), _packed(core_places, "component"), eps, _smallest_near, "nr long, component long")
    border = border.groupBy("nr").agg(F.min("component").alias("component"))
    member = materialize(core_places.select("nr", "component").unionByName(border))
    names = member.groupBy("component").agg(F.min("nr").alias("low"))
    numbered = with_rank(names, [F.asc("low")], "cluster").select("component", "cluster")
    by_place = places.join(member.join(numbered, "component"), "nr", "left").select(
        "place", F.coalesce("cluster", F.lit(NOISE)).cast("int").alias("cluster"), "weight"
    )
    return lookup_join(_ids(points, eps), by_place, "place", weight="weight").select("id", "cluster")


def _vector() -> Column:
    # one zero: -0.0 and 0.0 are the same place
    return F.transform("vector", lambda x: x.cast("double") + F.lit(0.0))


def _ids(points: DataFrame, eps: float) -> DataFrame:
    return points.select("id", _vector().alias("place"))


def _places(points: DataFrame, eps: float) -> DataFrame:
    """Distinct vectors with their weight, their box, and their cell on the leading axes."""
    size = F.size("place")
    side = F.lit(eps) / F.sqrt(size)
    return (
        _ids(points, eps)
        .groupBy("place")
        .agg(F.count("*").alias("weight"), F.min("id").alias("first"))
        .withColumns(
            {
                "box": F.transform("place", lambda x: F.floor(x / side)),
                "cell": F.transform(F.slice("place", 1, GRID_AXES), lambda x: F.floor(x / F.lit(eps))),
            }
        )
    )


def _numbered(points: DataFrame, eps: float) -> DataFrame:
    """The places, numbered by their first ids."""
    return materialize(with_rank(_places(points, eps), [F.asc_nulls_last("first"), F.xxhash64("place")], "nr"))


def _degrees(places: DataFrame, eps: float) -> DataFrame:
    """``(nr, degree)``: the points within ``eps`` of a place; no row where there is none."""
    found = _tiles(_packed(places, "weight"), None, eps, _near_weights, "nr long, degree long")
    return materialize(found.groupBy("nr").agg(F.sum("degree").alias("degree")))


# --- blocks --------------------------------------------------------------------------------------

_PACKED = "group int, size int, nr binary, value binary, rows binary, low array<double>, high array<double>"
_SIDE = ["nr", "value", "rows", "low", "high"]


def _packed(places: DataFrame, value: str) -> DataFrame:
    """Blocks of places with a number each; vectors without a distance to any other are in none."""
    ship(places.sparkSession)
    infinite = F.lit(float("inf"))
    finite = F.forall("place", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    usable = places.where(F.coalesce(finite, F.lit(False)))
    n = usable.count()
    groups = max(1, math.ceil(n / GROUP), min(GROUPS, math.ceil(n / CELL_POINTS)))
    order = ["cell", F.slice("place", 1, GRID_AXES), F.xxhash64("place")]
    ordered = usable.repartitionByRange(groups, *order).sortWithinPartitions(*order)
    rows = ordered.select(F.spark_partition_id().alias("group"), "nr", F.col(value).alias("value"), "place")
    most = CELL_POINTS
    return materialize(rows.mapInArrow(lambda batches: _pack(batches, most), _PACKED))


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple]] = {}  # by the length of vectors, which are compared only with their like

    def block(group: int, size: int) -> pa.RecordBatch:
        nr, value, rows = (np.concatenate(c) for c in zip(*held.pop(size)))
        row = [group, size, nr.tobytes(), value.tobytes(), rows.tobytes(), rows.min(axis=0).tolist(), rows.max(axis=0).tolist()]
        floats = pa.list_(pa.float64())
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), floats, floats]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [c.split()[0] for c in _PACKED.split(", ")])

    for batch in batches:
        for begin in range(0, batch.num_rows, most):
            part = batch.slice(begin, most)
            group, place = part.column(0)[0].as_py(), part.column(3)
            nr, value = (np.asarray(part.column(i), np.int64) for i in (1, 2))
            sizes = np.asarray(place.value_lengths())
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                rows = place.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
                if sum(len(h[0]) for h in held.get(size, ())) + len(at) > most:
                    yield block(group, size)
                held.setdefault(size, []).append((nr[at], value[at], rows))
    for size in list(held):
        yield block(group, size)


def _boxes(packed: DataFrame, side: str) -> DataFrame:
    """The bounding box of every group."""
    sides = packed.select("group", "size", F.posexplode_outer(F.arrays_zip("low", "high")).alias("axis", "of"))
    axes = sides.groupBy("group", "size", "axis").agg(F.min("of.low").alias("low"), F.max("of.high").alias("high"))
    box = F.sort_array(F.collect_list(F.struct("axis", "low", "high"))).alias(f"{side}_box")
    return axes.groupBy(F.col("group").alias(side), "size").agg(box)


def _tiles(left: DataFrame, right: DataFrame | None, eps: float, work: Callable, schema: str, which: str = "true") -> DataFrame:
    """``work`` on the blocks of every two groups that may hold places within ``eps``; without ``right`` both are of ``left``.
    Of these pairs of groups ``which`` picks some."""
    own = right is None
    right = left if own else right
    gap = F.zip_with("a_box", "b_box", lambda a, b: F.greatest(a["low"] - b["high"], b["low"] - a["high"], F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)) * F.coalesce(x, F.lit(0.0)))
    pairs = _boxes(left, "a").join(F.broadcast(_boxes(right, "b")), "size").where(apart <= _reach2(eps))
    pairs = materialize((pairs.where("a <= b") if own else pairs).where(which).select("a", "b", "size"))
    tasks = max(1, min(2 * pairs.count(), 4096))

    def dealt(packed: DataFrame, side: str, those: DataFrame) -> DataFrame:
        blocks = packed.withColumnRenamed("group", side).join(F.broadcast(those), [side, "size"])
        return blocks.select("a", "b", "size", F.lit(side).alias("side"), *_SIDE)

    blocks = dealt(left, "a", pairs).unionByName(dealt(right, "b", pairs.where("a < b") if own else pairs))

    def compared(key, table):
        size = key[2].as_py()
        sides: dict[str, list[_Block]] = {"a": [], "b": []}
        for row in range(table.num_rows):
            cells = {c: table.column(c)[row] for c in ("side", *_SIDE)}
            sides[cells.pop("side").as_py()].append(_Block(size, **cells))
        alone = own and key[0].as_py() == key[1].as_py()
        first, second = sides["a"], sides["a" if alone else "b"]
        several = ((x, y, near) for i, x in enumerate(first) for y in second[i if alone else 0 :] if (near := x.near(y, eps)) is not None)
        columns = work(several, own)
        return pa.table([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in schema.split(", ")])

    keys = ["a", "b", "size"]
    return blocks.repartition(tasks, *keys).groupBy(*keys).applyInArrow(compared, schema)


def _reach2(eps: float) -> float:
    """``eps`` squared and more than rounding can add to a sum of squares."""
    return eps * eps * (1 + 1e-9)


class _Block:
    def __init__(self, size: int, nr, value, rows, low, high):
        self.nr, self.value = (np.frombuffer(c.as_py(), np.int64) for c in (nr, value))
        self.rows = np.frombuffer(rows.as_py(), np.float64).reshape(len(self.nr), size)
        self.low, self.high = (np.array(c.as_py(), np.float64) for c in (low, high))

    def near(self, other: _Block, eps: float) -> np.ndarray | None:
        """Which rows lie within ``eps`` of which rows of ``other``, ``None`` if none can."""
        with np.errstate(all="ignore"):
            gaps = np.maximum(np.maximum(self.low - other.high, other.low - self.high), 0)
            if gaps @ gaps > _reach2(eps):
                return None
            limit, centre = eps * eps, (self.low + self.high) / 2
            x, y = (np.asarray(rows - centre, np.float32) for rows in (self.rows, other.rows))
            xx, yy = (np.einsum("ij,ij->i", z, z) for z in (x, y))
            # the terms of a squared distance add up to less than ``scale``, its error to less than a share of that
            scale = 2 * (float(xx.max()) + float(yy.max()) + float(limit))
            offset = np.abs(centre).max(initial=0.0)
            slack = scale * (x.shape[1] + 8) * 2.0**-23 + offset * math.sqrt(scale * max(x.shape[1], 1)) * 2.0**-50
            if not np.isfinite(slack) or limit < 1e-30:
                found, unsure = np.zeros((len(x), len(y)), bool), np.ones((len(x), len(y)), bool)
            else:
                left = np.column_stack([-2 * x, xx, np.ones(len(x), np.float32)])
                right = np.column_stack([y, np.ones(len(y), np.float32), yy])
                apart = left @ right.T
                found = apart <= np.float32(limit - slack)
                unsure = (apart <= np.float32(limit + slack)) & ~found
            if unsure.any():
                i, j = np.nonzero(unsure)
                for at in range(0, len(i), 1 << 16):
                    a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    total = np.zeros(len(a))
                    for axis in range(x.shape[1]):  # in the order of the axes, one after the other
                        gap = self.rows[a, axis] - other.rows[b, axis]
                        total += gap * gap
                    found[a, b] = total <= limit
            return found


def _near_weights(pairs, own: bool) -> tuple:
    """The weights around each place, summed up."""
    total: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def add(block: _Block, weights: np.ndarray) -> None:
        total.setdefault(id(block), (block.nr, np.zeros(len(block.nr), np.int64)))[1][:] += weights

    def around(near: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
        if (weights == 1).all():
            return np.count_nonzero(near, axis=axis)
        return near @ weights if axis else weights @ near

    for x, y, near in pairs:
        add(x, around(near, y.value, 1))
        if y is not x:
            add(y, around(near, x.value, 0))
    if not total:
        return (), ()
    nr, degree = (np.concatenate(c) for c in zip(*total.values()))
    return nr[degree > 0], degree[degree > 0]


def _forest(pairs, own: bool) -> tuple:
    """Edges that connect what the pairs connect; not more than there are nodes."""
    root: dict[int, int] = {}

    def top(nodes: np.ndarray) -> np.ndarray:
        names, where = np.unique(nodes, return_inverse=True)
        tops = []
        for n in names.tolist():
            at = root.setdefault(n, n)
            while root[at] != at:
                root[at] = at = root[root[at]]
            tops.append(at)
        return np.array(tops, np.int64)[where]

    for x, y, near in pairs:
        a, b = top(x.value), top(y.value)
        i, j = np.nonzero(near & (a[:, None] != b[None, :]))
        if not len(i):
            continue
        for u, v in np.unique(np.column_stack([a[i], b[j]]), axis=0).tolist():
            while root[u] != u:
                u = root[u]
            while root[v] != v:
                v = root[v]
            root[max(u, v)] = min(u, v)
    edges = [(n, above) for n, above in root.items() if n != above]
    return tuple(zip(*edges)) or ((), ())


def _smallest_near(pairs, own: bool) -> tuple:
    """The smallest value near each place of the left side."""
    most = np.iinfo(np.int64).max
    least: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for x, y, near in pairs:
        nr, found = least.setdefault(id(x), (x.nr, np.full(len(x.nr), most)))
        np.minimum(found, np.where(near, y.value, most).min(axis=1), out=found)
    if not least:
        return (), ()
    nr, found = (np.concatenate(c) for c in zip(*least.values()))
    return nr[found < most], found[found < most]
