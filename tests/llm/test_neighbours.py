import numpy as np
import pytest

from logweave.llm import neighbours as N

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(ids, x, k=10):
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        d[ids == ids[q]] = np.inf
        yield int(ids[q]), [(int(ids[i]), d[i]) for i in np.lexsort((ids, d))[:k] if np.isfinite(d[i])]


def result(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_against_brute_force(spark, sf):
    table = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = table.toPandas()
    got = result(N.nearest(table, table.where("vec_id % 100 = 0")).collect())
    hits = total = 0
    for query, want in brute(rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), np.float32)):
        exact = dict(want)
        hits += len(exact.keys() & {v for v, _ in got[query]})
        total += len(want)
        assert all(abs(exact[v] - d) < 1e-12 for v, d in got[query] if v in exact)
    assert hits / total >= 0.95


def test_one_vector_held_by_most_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(v) for v in rng.standard_normal(3)], 0) for i in range(600)]
    got = result(N.nearest(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA).where("vec_id % 100 = 0")).collect())
    want = dict(brute(np.arange(600), np.array([r[1] for r in rows], np.float32)))
    assert got.keys() == want.keys()
    assert [v for v, _ in got[100]] == [v for v, _ in want[100]] == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1),
        (6, [None, 1.0], 1), (7, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (200, None, 1), (8, [1.0, 0.0], None), (8, [1.0, 0.0], None), (9, [-0.0, 1.0], 2),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    got = result(N.nearest(table, table.where("vec_id % 100 = 0")).collect())
    far = 2**0.5
    assert got == {0: [(8, 0.0), (9, pytest.approx(far)), (100, pytest.approx(far))], 100: [(9, 0.0), (0, pytest.approx(far)), (8, pytest.approx(far))]}
    empty = spark.createDataFrame([], SCHEMA)
    assert N.nearest(empty, empty).count() == 0


def test_trees_deal_every_vector():
    x = np.random.default_rng(0).standard_normal((500, 8)).astype(np.float32)
    tree = N.ProjectionTree(x, 20, 1)
    leaf = tree.leaf_of(x)
    assert leaf.min() >= 0 and np.bincount(leaf).max() <= 20 and len(np.unique(leaf)) == tree.leaves
    same = N.ProjectionTree(np.ones((50, 4), np.float32), 10, 1)
    assert same.leaf_of(np.ones((3, 4), np.float32)).tolist() == [0, 0, 0]
