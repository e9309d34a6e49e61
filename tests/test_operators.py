import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import density
from logweave.operators.components import connected_components
from logweave.operators.density import density_clusters, neighbour_counts
from logweave.operators.joins import lookup_join
from logweave.operators.sequence import with_next, with_rank


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_a_hot_key_beyond_the_broadcast_size(spark, how, monkeypatch):
    monkeypatch.setattr("logweave.operators.joins.TASK_ROWS", 50)
    keys = ["hot"] * 3000 + [f"k{i}" for i in range(50)] + [None, "missing"]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k string")
    table = spark.createDataFrame([("hot", 3000, 1)] + [(f"k{i}", 1, i) for i in range(50)], "k string, n long, v long")
    small = lookup_join(rows, table, "k", "n", how)
    salted = lookup_join(rows, table, "k", "n", how, max_bytes=0)
    assert salted.columns == small.columns == ["k", "id", "v"]
    assert sorted(salted.collect(), key=str) == sorted(small.collect(), key=str)
    assert salted.count() == (3050 if how == "inner" else 3052)


def test_with_next_over_gaps_and_blocks(spark):
    rnd = random.Random(3)
    positions = sorted(rnd.sample(range(100_000), 700) + [10**12, 10**12 + 5])
    rows = [(p, rnd.choice("ab"), None if rnd.random() < 0.2 else rnd.randint(0, 9)) for p in positions]
    df = spark.createDataFrame(rows, "p long, part string, v int")
    for block in (1, 16, 1000):
        got = {r["p"]: r["_next"] and r["_next"]["v"] for r in with_next(df, "p", ["v"], block=block).collect()}
        assert got == {r[0]: n[2] for r, n in zip(rows, rows[1:])} | {rows[-1][0]: None}
    got = with_next(df, "p", ["p"], ["part"], block=100).collect()
    for part in "ab":
        own = [r[0] for r in rows if r[1] == part]
        assert {r["p"]: r["_next"] and r["_next"]["p"] for r in got if r["part"] == part} == dict(
            zip(own, own[1:] + [None])
        )


def test_with_next_keeps_null_partitions(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (300, None), (301, "a")], "p long, part string")
    got = {r["p"]: r["_next"] and r["_next"]["p"] for r in with_next(df, "p", ["p"], ["part"], block=10).collect()}
    assert got == {1: 300, 2: 301, 300: None, 301: None}


def test_with_rank(spark):
    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    got = {r["v"]: r["r"] for r in with_rank(df, [F.desc("v")], "r").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values, reverse=True))}


def _components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_connected_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)]
    edges += [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 40)]
    df = spark.createDataFrame(edges, "u long, v long")
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == _components(nodes, [e for e in edges if e[0] != e[1]])


def _dbscan(points, eps, least):
    near = {
        i: [j for j, q in points.items() if sum((a - b) ** 2 for a, b in zip(p, q)) <= eps * eps]
        for i, p in points.items()
    }
    core = {i for i in points if len(near[i]) >= least}
    component = _components(core, [(i, j) for i in core for j in near[i] if j in core])
    for i in set(points) - core:
        names = [component[j] for j in near[i] if j in core]
        component[i] = min(names) if names else None
    order = {c: k for k, c in enumerate(sorted({component[i] for i in core}))}
    return {i: order.get(component[i], -1) for i in points}, {i: len(near[i]) for i in points}


@pytest.mark.parametrize("dims,eps,least,cell_points", [(2, 0.5, 5, 8), (5, 1.4, 6, 1024)])
def test_density_clusters_equal_brute_force(spark, monkeypatch, dims, eps, least, cell_points):
    monkeypatch.setattr(density, "CELL_POINTS", cell_points)
    rnd = random.Random(dims)
    centres = [[rnd.uniform(-4, 4) for _ in range(dims)] for _ in range(4)]
    points = {i: [c + rnd.gauss(0, 0.4) for c in rnd.choice(centres)] for i in range(150)}
    points.update({150 + i: points[0] for i in range(30)})  # copies
    points.update({190 + i: [rnd.uniform(-6, 6) for _ in range(dims)] for i in range(20)})
    df = spark.createDataFrame(list(points.items()), "id long, vector array<double>")
    clusters, degrees = _dbscan(points, eps, least)
    assert {r["id"]: r["neighbours"] for r in neighbour_counts(df, eps).collect()} == degrees
    assert {r["id"]: r["cluster"] for r in density_clusters(df, eps, least).collect()} == clusters


def test_density_compares_blocks(spark, monkeypatch):
    monkeypatch.setattr(density, "CELL_POINTS", 16)
    written, real = [], density.materialize
    monkeypatch.setattr(density, "materialize", lambda df: written.append(real(df)) or written[-1])
    rnd = random.Random(11)
    points = {i: [rnd.gauss(0, 0.3) for _ in range(20)] for i in range(300)}
    points[300] = [*points[0][:19], points[0][19] + 2.0]  # exactly eps away
    points.update({301: [float("nan")] * 20, 302: [float("inf")] * 20, 303: [1e30] * 20, 304: [1e30] * 20, 305: [0.0] * 3})
    df = spark.createDataFrame(list(points.items()), "id long, vector array<double>").unionByName(
        spark.createDataFrame([(400, None), (401, [None] * 20)], "id long, vector array<double>")
    )
    clusters, degrees = _dbscan({i: p for i, p in points.items() if i < 301 or i in (303, 304)}, 2.0, 6)
    assert {r["id"]: r["neighbours"] for r in neighbour_counts(df, 2.0).collect()} == degrees | {305: 1}
    found = {r["id"]: r["cluster"] for r in density_clusters(df, 2.0, 6).collect()}
    assert found == clusters | {i: -1 for i in (301, 302, 305, 401)}
    blocks = [w for w in written if "rows" in w.columns]
    assert blocks and all(w.where("octet_length(rows) > 16 * 20 * 8").isEmpty() for w in blocks)


def test_lookup_join_spares_the_driver_tables_of_tens_of_megabytes(spark):
    table = spark.range(450_000).select(F.col("id").alias("k"), F.lit(1).alias("n"), F.col("id").alias("v"))
    joined = lookup_join(spark.range(10).select(F.col("id").alias("k")), table, "k", "n")
    assert "_salt" in joined._jdf.queryExecution().logical().toString()
    assert sorted(joined.collect()) == [(i, i) for i in range(10)]
