import math
from fractions import Fraction

import numpy as np
import pytest

from logweave.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<double>, label int, n string, component double"


def table_of(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "own", 0.5) for i, v in vectors], schema)


def model_of(vectors, most=32):
    """Plain numpy on the same numbers, with Python's integers where exactness is asked for."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[k] for row in x) for k in range(d)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(row, s)) for row in x]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(row, s)] for row in x])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:most]
    return n, deviation, centred, values[order], vectors_[:, order], values.sum()


def got(df):
    rows = df.toPandas().sort_values(["component", "vec_id"], kind="stable")
    k = rows.component.max()
    assert sorted(rows.component.unique()) == list(range(1, k + 1)) and rows.identity_error.nunique() == 1 and rows.n.nunique() == 1
    return rows, k


def agrees(rows, vectors, k, tolerance=1e-8):
    n, deviation, centred, values, axes, trace = model_of(vectors)
    assert rows.n.iloc[0] == n and rows.identity_error.iloc[0] < 1e-9
    for j in range(k):
        one = rows[rows.component == j + 1]
        assert one.deviation.tolist() == deviation
        assert one.explained.iloc[0] == pytest.approx(values[j] / trace, rel=1e-9)
        want, have = centred @ axes[:, j] / math.sqrt(values[j]), one.whitened.to_numpy()
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < tolerance


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_against_floating_point(spark, sf):
    table = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    plain = table.orderBy("vec_id").toPandas()
    rows, k = got(W.whiten(table))
    assert k == 32 and len(rows) == 32 * len(plain)
    agrees(rows, plain.embedding.tolist(), k, 1e-6)


def test_polynomial_is_exact():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 9):
        a = rng.integers(-9, 9, (d, d))
        a = (a.T @ a).tolist()
        # coefficients by traces of powers, in fractions
        power, sums, want = np.eye(d, dtype=object) * 1, [], [Fraction(1)]
        for k in range(1, d + 1):
            power = power @ np.array(a, object)
            sums.append(sum(power[i, i] for i in range(d)))
            want.append(-sum(want[k - 1 - i] * sums[i] for i in range(k)) / k)
        primes = W.primes_below(1 << 31, 8)
        residues = [(p, W.polynomial_modulo(np.array(a, np.int64), p)) for p in primes]
        assert W.remaindered(residues) == [int(c) for c in want[::-1]]


def test_primes():
    assert W.primes_below(60, 17) == [59, 53, 47, 43, 41, 37, 31, 29, 23, 19, 17, 13, 11, 7, 5, 3, 2]
    assert W.primes_below(1 << 31, 2) == [2147483647, 2147483629]


def test_roots_and_multiplicity():
    # (t - 2)^3 (t - 5) (t - 1000001) (t - 1000003) t^2
    poly = [1]
    for root in (2, 2, 2, 5, 1000001, 1000003, 0, 0):
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0])]
    assert [W.roots_above(poly, t, 0) for t in (0, 1, 2, 4, 5, 1000002, 1000003)] == [6, 6, 3, 3, 2, 1, 0]
    found = W.isolated(poly, 32)
    assert [m for *_, m in found] == [1, 1, 1, 3]
    for (low, high, places, m), want in zip(found, (1000003, 1000001, 5, 2)):
        t, at = W.refined(poly[2:], low, high, places) if m == 1 else (high, places)
        assert abs(Fraction(t, 1 << at) - want) <= Fraction(want, 1 << W.PLACES - 1)


def test_close_and_equal_eigenvalues(spark):
    # axes of the same variance, and two that differ by one part in ten thousand
    vectors = [(0, [0.0] * 6)]
    for k, size in enumerate((4, 4, 4, 9, 9.0009765625, 1)):
        vectors += [(2 * k + 1, [size * (i == k) for i in range(6)]), (2 * k + 2, [-size * (i == k) for i in range(6)])]
    rows, k = got(W.whiten(table_of(spark, vectors)))
    assert k == 6 and rows.identity_error.iloc[0] < 1e-12
    share = rows.groupby("component").explained.first().to_numpy()
    assert share.sum() == pytest.approx(1, rel=1e-12) and share[2] == share[3] == share[4] and (np.diff(share) <= 0).all()


def test_exact_beyond_64_bits(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [c * 10.0**e for c, e in zip(rng.standard_normal(3), (0, 9, 25))]) for i in range(40)]
    rows, k = got(W.whiten(table_of(spark, vectors)))
    assert k == 3 and rows.identity_error.iloc[0] < 1e-9 and rows.deviation.isna().all()
    n, total, products = W.sums(W.usable(table_of(spark, vectors)))
    x = [[math.floor(Fraction(c) * 64) for c in v] for _, v in vectors]
    assert n == 40 and total == [sum(r[k] for r in x) for k in range(3)]
    assert products == [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, [0.0, 0.0]), (None, [5.0, 5.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [-0.01, 0.3]),
    ]
    table = table_of(spark, vectors)
    found = W.whiten(table).collect()
    kept = [1, 2, 3, None, 3, 10]
    assert sorted(str(r.vec_id) for r in found) == sorted(str(i) for i in kept * 2) and {r.n for r in found} == {6}
    rows, k = got(W.whiten(table.fillna({"vec_id": 4})))
    agrees(rows, [v for i, v in sorted(((4 if i is None else i, v) for i, v in vectors if v and len(v) == 2 and v[0] not in (None, inf) and v[0] == v[0]))], k)
    assert W.whiten(table.limit(0)).count() == 0
    assert W.whiten(table.where("vec_id = 3")).count() == 0  # no variance
    line = [(r.component, round(r.whitened, 9)) for r in W.whiten(table_of(spark, [(1, [0.0, 1.0]), (2, [2.0, 1.0])])).orderBy("vec_id").collect()]
    assert line == [(1, -1.0), (1, 1.0)]
