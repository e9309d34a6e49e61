"""Embedding whitening from an exact characteristic polynomial.

Entries are floored to 64ths, so sums and the scatter matrix ``n * sum(x x') - S S'`` are integers. They are added
up in Spark as limbs of 40 bits, whatever their size. From there on:

1. *Polynomial.* For each of as many 31-bit primes as its coefficients need, a task reduces the scatter matrix to
   Hessenberg form modulo the prime and expands its characteristic polynomial; Chinese remainders give the integers. The
   scatter matrix has no negative eigenvalue, so ``(1 + trace / d) ** d`` bounds all coefficients.
2. *Roots.* All roots are real, so the sign changes of the polynomial shifted to ``t`` are exactly the number of roots above
   ``t``. Bisection by that number isolates the largest roots, one task a root refines it to ``PLACES`` binary places by
   the sign of the polynomial. Roots that agree in all these places are one of higher multiplicity.
3. *Components.* Inverse iteration in fixed-point integers finds the null space of the matrix less the root; of a multiple
   root an orthonormal basis.

A scan each then measures the covariance of the whitened vectors and whitens all rows. Only sums, residues and
components, whose number depends on the dimensions alone, reach the driver.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do vectors of
another length than the most frequent one; repeated rows count as often as they are there, a null id stays null; directions
without any variance are no components, so of equal vectors, or of one, nothing is returned; a deviation beyond 64 bits
is null. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import map_batches

COMPONENTS = 32
PLACES = 128  # binary places of a root, relative to it
LIMB = 40
_BELOW = 1 << 31


# --- integers -------------------------------------------------------------------------------------


def usable(rows: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select("vec_id", "embedding").where(fine & (F.size("embedding") > 0))
    most = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("embedding") == (most["size"] if most else 0))


def floored(x: np.ndarray) -> np.ndarray:
    """``floor(64 x)``, as 64-bit integers where they hold it, else as Python's."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < 2.0**52:
        return np.floor(64 * x).astype(np.int64)
    return np.array([[int(v) * 64 if abs(v) >= 2.0**53 else math.floor(64 * v) for v in row] for row in x.tolist()], object)


def _entries(column: pa.Array) -> np.ndarray:
    return floored(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _products(x: np.ndarray) -> np.ndarray:
    """``x' x`` exactly."""
    if x.dtype != object:
        most = int(np.abs(x).max()) ** 2 * len(x)
        if most < 1 << 53:
            wide = x.astype(np.float64)
            return (wide.T @ wide).astype(np.int64).astype(object)
        if most < 1 << 63:
            return (x.T @ x).astype(object)
    x = x.astype(object)
    return x.T @ x


def limbs(values: list[int]) -> tuple[list[int], list[int], list[int]]:
    """``(index, limb, part)`` with ``value = sum(part << (LIMB * limb))``."""
    index, place, part = [], [], []
    for i, value in enumerate(values):
        sign, rest, at = (-1 if value < 0 else 1), abs(value), 0
        while rest:
            index.append(i)
            place.append(at)
            part.append(sign * (rest & ((1 << LIMB) - 1)))
            rest >>= LIMB
            at += 1
    return index, place, part


def sums(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """The number of vectors, the sums of their entries and of the products of entries, all of ``floor(64 c)``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _entries(batch.column(0))
                n, total, products = n + len(x), total + x.astype(object).sum(axis=0), products + _products(x)
        if n:
            index, place, part = limbs([n, len(total), *total, *products[np.tril_indices(len(total))]])
            # the length is the same for all
            yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(place), pa.array(part, pa.int64())], ["index", "limb", "part"])

    parts = map_batches(rows.select("embedding"), add, "index bigint, limb bigint, part bigint")
    found = parts.groupBy("index", "limb").agg(F.sum("part").alias("part"), F.max("part").alias("most")).collect()
    values: dict[int, int] = {}
    for r in found:
        values[r["index"]] = values.get(r["index"], 0) + ((r["most"] if r["index"] == 1 else r["part"]) << (LIMB * r["limb"]))
    n, d = values.get(0, 0), values.get(1, 0)
    total = [values.get(2 + i, 0) for i in range(d)]
    products = [[0] * d for _ in range(d)]
    for at, (i, j) in enumerate(zip(*np.tril_indices(d))):
        products[i][j] = products[j][i] = values.get(2 + d + at, 0)
    return n, total, products


def scatter(n: int, total: list[int], products: list[list[int]]) -> list[list[int]]:
    """``n * n`` times the covariance."""
    return [[n * q - a * b for q, b in zip(row, total)] for row, a in zip(products, total)]


# --- characteristic polynomial --------------------------------------------------------------------


def primes_below(limit: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``limit``, at most 2**31."""
    small = np.ones(1 << 16, bool)
    small[:2] = False
    for p in range(2, 256):
        if small[p]:
            small[p * p :: p] = False
    factors, out, high = np.flatnonzero(small), [], limit
    while len(out) < count:
        low = max(2, high - (1 << 15))
        prime = np.ones(high - low, bool)
        for p in factors[factors * factors < high].tolist():
            prime[max(p * p, -(-low // p) * p) - low :: p] = False
        out += (np.flatnonzero(prime)[::-1] + low).tolist()
        high = low
    return out[:count]


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo the prime ``p``, zero below the first subdiagonal."""
    a = a.copy()
    for k in range(len(a) - 2):
        some = np.flatnonzero(a[k + 1 :, k])
        if not len(some):
            continue
        at = k + 1 + int(some[0])
        if at != k + 1:
            a[[at, k + 1]] = a[[k + 1, at]]
            a[:, [at, k + 1]] = a[:, [k + 1, at]]
        ratio = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - ratio[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * ratio % p).sum(axis=1)) % p
    return a


def polynomial_modulo(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of ``det(t - a)`` modulo ``p``, the constant one first."""
    h, d = hessenberg(a % p, p), len(a)
    rows = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks
    rows[0, 0] = 1
    for k in range(1, d + 1):
        rows[k, 1:] = rows[k - 1, :-1]
        rows[k] = (rows[k] - int(h[k - 1, k - 1]) * rows[k - 1] % p) % p
        below, factors = 1, []
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            factors.append(int(h[i - 1, k - 1]) * below % p)
        if factors:
            rows[k] = (rows[k] - (np.array(factors[::-1])[:, None] * rows[: k - 1] % p).sum(axis=0)) % p
    return rows[d].tolist()


def remaindered(residues: list[tuple[int, list[int]]]) -> list[int]:
    """The integers of least magnitude with these residues."""
    values, modulus = [0] * len(residues[0][1]), 1
    for p, residue in residues:
        inverse = pow(modulus, -1, p)
        values = [v + modulus * ((r - v) * inverse % p) for v, r in zip(values, residue)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in values]


def characteristic(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients of ``det(t - matrix)`` of a matrix without negative eigenvalues, the constant one first."""
    d = len(matrix)
    bound = 2 * (-(-((d + sum(matrix[i][i] for i in range(d))) ** d) // d**d)) + 1
    count = bound.bit_length() // 30 + 1  # every prime used is above 2**30
    shared = spark.sparkContext.broadcast((matrix, primes_below(_BELOW, count)))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, primes = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                p = primes[i]
                residue = polynomial_modulo(np.array([[v % p for v in row] for row in rows], np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([residue], pa.list_(pa.int64()))], ["prime", "residue"])

    tasks = min(count, 4 * spark.sparkContext.defaultParallelism)
    found = map_batches(spark.range(0, count, 1, tasks), reduce, "prime bigint, residue array<bigint>").collect()
    return remaindered([(r.prime, r.residue) for r in found])


# --- roots ----------------------------------------------------------------------------------------


def roots_above(poly: list[int], t: int, places: int) -> int:
    """How many roots of a polynomial with real roots only exceed ``t / 2**places``."""
    shifted = [c << (places * (len(poly) - 1 - k)) for k, c in enumerate(poly)]
    for start in range(len(shifted) - 1):
        for k in range(len(shifted) - 2, start - 1, -1):
            shifted[k] += t * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def isolated(poly: list[int], most: int) -> list[tuple[int, int, int, int]]:
    """``(low, high, places, multiplicity)`` from the largest root down: it is in ``(low, high] / 2**places``, alone or as a
    multiple root to ``PLACES`` places. Roots of zero are left out."""
    poly = poly[next(k for k, c in enumerate(poly) if c) :]
    count = len(poly) - 1
    top = 1 << (-poly[-2]).bit_length() if count else 0  # the sum of all roots, none negative
    out, taken = [], 0
    todo = [(0, top, 0, count, 0)]  # with the numbers of roots above both ends
    while todo and taken < most:
        low, high, places, above_low, above_high = todo.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if inside == 1 or (high - low == 1 and low >> PLACES):
            out.append((low, high, places, inside))
            taken += inside
            continue
        if high - low == 1:
            low, high, places = 2 * low, 2 * high, places + 1
        middle = (low + high) // 2
        above = roots_above(poly, middle, places)
        todo += [(low, middle, places, above_low, above), (middle, high, places, above, above_high)]
    return out


def _sign(poly: list[int], t: int, places: int) -> int:
    value = 0
    for k, c in enumerate(reversed(poly)):
        value = value * t + (c << (places * k))
    return (value > 0) - (value < 0)


def refined(poly: list[int], low: int, high: int, places: int) -> tuple[int, int]:
    """A simple root that is alone in ``(low, high]``, to ``PLACES`` binary places: ``(t, places)``."""
    above = _sign(poly, high, places)
    if not above:
        return high, places
    while not (high - low == 1 and low >> PLACES):
        if high - low == 1:
            low, high, places = 2 * low, 2 * high, places + 1
        middle = (low + high) // 2
        sign = _sign(poly, middle, places)
        if not sign:
            return middle, places
        low, high = (low, middle) if sign == above else (middle, high)
    return high, places


# --- components -----------------------------------------------------------------------------------


def null_vectors(matrix: list[list[int]], root: int, places: int, count: int) -> list[list[float]]:
    """``count`` orthonormal vectors that the matrix multiplies by ``root / 2**places``."""
    d, more = len(matrix), max(0, PLACES + 1 - root.bit_length())
    root, places = root << more, places + more  # a root met exactly may have few places
    a = np.array([[v << places for v in row] for row in matrix], object)
    a[np.arange(d), np.arange(d)] -= root
    width = 2 * max(int(v).bit_length() for v in a.ravel()) + 128
    order, ratios = [], []
    for k in range(d):
        at = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        order.append(at)
        if at != k:
            a[[at, k]] = a[[k, at]]
        if not a[k, k]:
            a[k, k] = 1
        ratio = np.array([(v << width) // a[k, k] for v in a[k + 1 :, k]], object)
        ratios.append(ratio)
        if len(ratio):
            a[k + 1 :, k:] -= (ratio[:, None] * a[k, k:][None, :]) >> width

    def solved(b: np.ndarray) -> np.ndarray:
        for k in range(d):
            b[[k, order[k]]] = b[[order[k], k]]
            b[k + 1 :] -= (ratios[k] * b[k]) >> width
        for k in range(d - 1, -1, -1):
            rest = sum(a[k, k + 1 :] * b[k + 1 :]) if k + 1 < d else 0
            b[k] = ((b[k] << width) - rest) // a[k, k]
        return b

    def unit(b: np.ndarray) -> np.ndarray:
        return np.array([(v << width) // math.isqrt(sum(b * b)) for v in b], object)

    rng = np.random.default_rng(d)
    out: list[np.ndarray] = []
    for _ in range(count):
        b = unit(np.array([int(v) for v in rng.integers(1 << 40, 1 << 41, d) * rng.choice([-1, 1], d)], object))
        for _ in range(3):
            b = unit(solved(b))
            for other in out:
                b = b - ((other * (sum(b * other) >> width)) >> width)
            b = unit(b)
        out.append(b)
    vectors = [[float(Fraction(int(v), 1 << width)) for v in b] for b in out]
    return [v if max(v, key=abs) > 0 else [-c for c in v] for v in vectors]


@dataclass
class Whitening:
    """``components`` has one unit vector a row, ``eigenvalues`` are those of the covariance of ``x``."""

    n: int
    sums: list[int]  # of floor(64 c); x is larger by a million
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, exactly."""
        most = 0 if not x.size else self.n * int(np.abs(x).max()) + max(map(abs, self.sums))
        if x.dtype != object and most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        if centred.dtype == object:
            plain = np.array([[float(Fraction(int(v), self.n)) for v in row] for row in centred])
        else:
            plain = centred / self.n
        return plain @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T


def deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares; none where 64 bits do not hold them."""
    if centred.dtype != object and centred.size and int(np.abs(centred).max()) ** 2 * centred.shape[1] < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in centred)]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The model of all ``rows`` (as ``usable`` gives them); none without any variance."""
    spark = rows.sparkSession
    n, total, products = sums(rows)
    matrix = scatter(n, total, products)
    common = math.gcd(*(v for row in matrix for v in row)) if n else 0
    if not common:
        return None
    matrix = [[v // common for v in row] for row in matrix]
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    poly = characteristic(spark, matrix)
    places = isolated(poly, components)
    poly = poly[next(k for k, c in enumerate(poly) if c) :]
    shared = spark.sparkContext.broadcast((matrix, poly, places))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, poly, places = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                low, high, at, count = places[i]
                root, at = refined(poly, low, high, at) if count == 1 else (high, at)
                vectors = null_vectors(matrix, root, at, count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * count), pa.array([str(root)] * count), pa.array([at] * count), pa.array(vectors, pa.list_(pa.float64()))],
                    ["i", "root", "places", "vector"],
                )

    solved = map_batches(spark.range(0, len(places), 1, len(places)), solve, "i bigint, root string, places bigint, vector array<double>").collect()
    solved = sorted(solved, key=lambda r: r.i)[:components]
    roots = [Fraction(int(r.root), 1 << r.places) for r in solved]
    model = Whitening(
        n, total, np.array([r.vector for r in solved]), np.array([float(r * common / (n * n)) for r in roots]), np.array([float(r / trace) for r in roots])
    )
    model.identity_error = _identity_error(rows, model)
    return model


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened covariance less the identity, measured over all rows."""
    shared, k = rows.sparkSession.sparkContext.broadcast(model), len(model.components)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k + 1, k)), False
        for batch in batches:
            if batch.num_rows:
                white = shared.value.whitened(shared.value.centred(_entries(batch.column(0))))
                total += np.vstack([white.sum(axis=0), white.T @ white])
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "part"])

    parts = map_batches(rows.select("embedding"), add, "at bigint, part double")
    total = np.zeros((k + 1) * k)
    for r in parts.groupBy("at").agg(F.sum("part").alias("part")).collect():
        total[r["at"]] = r["part"]
    mean, squares = total[:k] / model.n, total[k:].reshape(k, k) / model.n
    return float(np.abs(squares - np.outer(mean, mean) - np.eye(k)).max())


_OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """One row per vector and component."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.components)
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = model.centred(_entries(batch.column(1)))
            each = pa.array(np.repeat(np.arange(len(centred)), k))
            size = len(centred) * k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(centred))), pa.array(np.full(size, model.n)),
                    pa.array(deviations(centred), pa.int64()).take(each), pa.array(model.whitened(centred).ravel()),
                    pa.array(np.tile(model.explained, len(centred))), pa.array(np.full(size, model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_batches(rows.select(F.col("vec_id").cast("bigint"), "embedding"), whiten, _OUT)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``rows`` need ``vec_id`` and ``embedding``; ``(vec_id, component, n, deviation, whitened, explained, identity_error)``."""
    fine = usable(rows)
    model = fit(fine, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], _OUT)
    return transform(fine, model)
