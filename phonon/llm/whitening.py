"""Embedding whitening by the exact characteristic polynomial (operator 12).

Every entry c becomes the whole number y = floor(64 c). The scatter matrix
n * sum(y y') - S S' of the whole table is then a matrix of whole numbers, its
characteristic polynomial has whole coefficients, and its eigenvalues are
known to any precision wanted:

1. one pass adds up the whole-number sums and products (per task, then one
   grouped sum of a number of rows fixed by the dimension);
2. the polynomial is computed modulo many 31-bit primes, a task each, by
   reduction to Hessenberg form, and put together by Chinese remaindering; the
   number of primes follows from Maclaurin's bound on the coefficients;
3. the largest roots are isolated by Descartes' rule of signs, which is exact
   for polynomials whose roots are all real, and bisected to ``BITS`` bits;
4. each root's null space is found by inverse iteration with fixed-point
   numbers of whole digits, a task each; a root of multiplicity m gives m
   orthonormal vectors;
5. one pass measures the covariance of the whitened rows, one writes them.

Only sums, the polynomial and the components reach the driver: their size is
given by the dimension (at most ``MAX_DIMENSION``) and never by the rows.
Shifting every entry by a constant (the contract's 1000000) changes no
difference from the mean, so it is left out of the sums.

Defined results: rows whose vector is null, empty or holds a null, non-finite
or huge (2**46 and over) entry are dropped, as are rows of another than the
most frequent dimension (ties: the larger). Ids may be null or repeated; every
remaining row comes back. Components of eigenvalue zero have no whitened value
and are left out, so a table whose vectors are all equal, or an empty one,
gives no rows. ``deviation`` is null where it does not fit a long. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonon.llm.common import kept_in_worker
from phonon.session import ship_package

SCALE = 64
LIMIT = float(1 << 46)            # entries from here on are dropped: 64 c would leave the exact doubles
MAX_DIMENSION = 2048              # the driver holds the square of it
BITS = 192                        # relative precision of a root
LIMB = 60                         # sums travel in two parts, so that no decimal overflows
ROWS = 4096                       # rows multiplied at once


# ---- whole-number sums -------------------------------------------------------------------------

def whole(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    """floor(64 c) of the vectors of column 1: whole numbers held exactly in doubles."""
    values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    return np.floor(values.reshape(-1, dimension) * SCALE)


def products(y: np.ndarray) -> np.ndarray:
    """y' y exactly, as an array of Python integers."""
    top = float(np.abs(y).max(initial=0.0))
    if top * top * len(y) < 2.0 ** 53:
        return (y.T @ y).astype(np.int64).astype(object)
    big = y.astype(np.int64).astype(object)
    return big.T.dot(big)


def moments(vectors: DataFrame, dimension: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sums, sums of products) over all rows of (id, vector), exact."""
    upper = np.triu_indices(dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("whitening")
        n, total = 0, np.zeros(dimension, object)
        gram = np.zeros((dimension, dimension), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = whole(batch.slice(at, ROWS), dimension)
                n += len(y)
                total += np.array([int(v) for v in y.astype(object).sum(axis=0)]
                                  if np.abs(y).max() > 2.0 ** 40 else y.sum(axis=0).astype(np.int64), object)
                gram += products(y)
        i = np.concatenate((upper[0], np.arange(dimension), [-1]))
        j = np.concatenate((upper[1], np.full(dimension, -1), [-1]))
        v = [*gram[upper].tolist(), *total.tolist(), n]
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()),
             pa.array([int(x) >> LIMB for x in v], pa.int64()).cast(kind),
             pa.array([int(x) & ((1 << LIMB) - 1) for x in v], pa.int64()).cast(kind)],
            names=["i", "j", "high", "low"])

    got = (vectors.mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
           .groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect())
    sums, gram, n = np.zeros(dimension, object), np.zeros((dimension, dimension), object), 0
    for r in got:
        v = (int(r["high"]) << LIMB) + int(r["low"])
        if r["i"] < 0:
            n = v
        elif r["j"] < 0:
            sums[r["i"]] = v
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = v
    return n, sums, gram


# ---- characteristic polynomial -----------------------------------------------------------------

def is_prime(n: int) -> bool:
    """Miller-Rabin, exact below 2**32 with these bases."""
    if n % 2 == 0:
        return n == 2
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        if a % n == 0:
            continue
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2**31 whose product exceeds twice ``bound``."""
    out, have, p = [], 1, (1 << 31) - 1
    while have <= 2 * bound:
        if is_prime(p):
            out.append(p)
            have *= p
        p -= 2
    return out


def coefficient_bound(trace: int, dimension: int) -> int:
    """At least every coefficient of the characteristic polynomial of a positive semidefinite
    matrix: the elementary symmetric means fall below the powers of the mean root (Maclaurin)."""
    mean = -(-trace // dimension)
    return max(math.comb(dimension, k) * mean ** k for k in range(dimension + 1))


def characteristic_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients (constant first, monic) of det(x I - matrix) modulo a prime below 2**31."""
    h = np.array(matrix % p, dtype=np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[pivot, k + 1]] = h[[k + 1, pivot]]
            h[:, [pivot, k + 1]] = h[:, [k + 1, pivot]]
        factor = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:, k:] = (h[k + 2:, k:] - factor[:, None] * h[k + 1, k:] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factor % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), dtype=np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        poly[k, 1:] = poly[k - 1, :-1]
        weight, chain = np.zeros(k, dtype=np.int64), 1
        for i in range(k - 1, -1, -1):
            weight[i] = int(h[i, k - 1]) * chain % p
            chain = chain * int(h[i, i - 1]) % p if i else 0
        poly[k] = (poly[k] - (weight[:, None] * poly[:k] % p).sum(axis=0)) % p
    return poly[d].tolist()


def combine(residues: dict[int, list[int]]) -> list[int]:
    """Whole coefficients, between minus and plus half the product, by Chinese remaindering."""
    modulus = math.prod(residues)
    out = [0] * len(next(iter(residues.values())))
    for p, coefs in residues.items():
        rest = modulus // p
        unit = rest * pow(rest, -1, p)
        out = [a + c * unit for a, c in zip(out, coefs, strict=True)]
    return [c - modulus if (c := a % modulus) > modulus // 2 else c for a in out]


def characteristic(spark: SparkSession, scatter: np.ndarray) -> list[int]:
    """Exact characteristic polynomial, constant first; one task works on a few primes."""
    trace = sum(int(scatter[k, k]) for k in range(len(scatter)))
    primes = primes_for(coefficient_bound(trace, len(scatter)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()),
                 pa.array([characteristic_mod(scatter, primes[k]) for k in at], pa.list_(pa.int64()))],
                names=["k", "coefs"])

    parts = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rows = spark.range(0, len(primes), 1, parts).mapInArrow(run, "k long, coefs array<long>").collect()
    return combine({primes[r["k"]]: list(r["coefs"]) for r in rows})


# ---- roots ---------------------------------------------------------------------------------------

def roots_above(poly: list[int], t: int, shift: int) -> int:
    """Number of roots above t / 2**shift of a polynomial all of whose roots are real: the sign
    changes of the polynomial moved there (Descartes), counted with multiplicity."""
    d = len(poly) - 1
    c = [a << (shift * (d - k)) for k, a in enumerate(poly)]
    for k in range(d):
        for i in range(d - 1, k - 1, -1):
            c[i] += t * c[i + 1]
    signs = [a > 0 for a in c if a]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign_at(poly: list[int], t: int, shift: int) -> int:
    """Sign of the polynomial at t / 2**shift."""
    acc, up = 0, 0
    for a in reversed(poly):
        acc = acc * t + (a << up)
        up += shift
    return (acc > 0) - (acc < 0)


def largest_roots(poly: list[int], wanted: int) -> list[tuple[int, int, int]]:
    """[(t, shift, multiplicity)], falling: the positive roots t / 2**shift, each to ``BITS`` bits,
    until ``wanted`` of them are had (with multiplicity, the last one whole)."""
    zeros = next(k for k, a in enumerate(poly) if a)
    poly = poly[zeros:]
    d = len(poly) - 1
    if not d:
        return []
    out: list[tuple[int, int, int]] = []
    top = -poly[d - 1] + 1                    # the roots add up to the trace
    # (low, high, shift, roots above low, roots above high): roots in (low, high]
    stack = [(0, top, 0, d, 0)]
    while stack and sum(m for *_, m in out) < wanted:
        low, high, shift, above_low, above_high = stack.pop()
        count = above_low - above_high
        if not count:
            continue
        if count == 1:
            out.append((*bisected(poly, low, high, shift), 1))
            continue
        if low and (low.bit_length() - (high - low).bit_length()) > BITS:
            out.append((high, shift, count))      # one root, as often as it is counted
            continue
        if high - low == 1:
            low, high, shift = low << 1, high << 1, shift + 1
        # the first cuts halve the exponent's range: roots differ by orders of magnitude
        mid = 1 << ((low.bit_length() + high.bit_length()) // 2) if low.bit_length() + 2 < high.bit_length() \
            else (low + high) // 2
        mid = min(max(mid, low + 1), high - 1)
        above = roots_above(poly, mid, shift)
        stack.append((low, mid, shift, above_low, above))
        stack.append((mid, high, shift, above, above_high))
    return out


def bisected(poly: list[int], low: int, high: int, shift: int) -> tuple[int, int]:
    """The only root in (low, high] / 2**shift, a simple one, to ``BITS`` bits."""
    upper = sign_at(poly, high, shift)
    if upper == 0:
        return high, shift
    while not low or low.bit_length() - (high - low).bit_length() <= BITS:
        if high - low == 1:
            low, high, shift = low << 1, high << 1, shift + 1
        mid = (low + high) // 2
        s = sign_at(poly, mid, shift)
        if s == 0:
            return mid, shift
        if s == upper:
            high = mid
        else:
            low = mid
    return (low + high) // 2, shift


# ---- null spaces -----------------------------------------------------------------------------------

def unit(v: np.ndarray, digits: int) -> np.ndarray:
    """``v`` scaled to length 1, in fixed point of ``digits`` bits."""
    size = max(int(abs(x)).bit_length() for x in v)
    up = digits + 64 - size
    v = np.array([int(x) << up if up >= 0 else int(x) >> -up for x in v], object)
    length = math.isqrt(sum(int(x) * int(x) for x in v))
    return np.array([(int(x) << digits) // length for x in v], object)


def null_space(matrix: np.ndarray, t: int, shift: int, multiplicity: int) -> np.ndarray:
    """(multiplicity, d) orthonormal doubles spanning the null space of matrix - (t / 2**shift) I,
    by inverse iteration with a triangular factorisation in fixed point."""
    d = len(matrix)
    digits = 2 * BITS + 64
    # rows scaled by the root, so that entries are of order one
    a = np.array([[(int(matrix[i, j]) << (shift + digits)) // t for j in range(d)] for i in range(d)], object)
    one = 1 << digits
    for k in range(d):
        a[k, k] -= one
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if a[k, k] == 0:
            a[k, k] = 1                       # the last digit: a null direction
        for i in range(k + 1, d):
            if a[i, k]:
                f = (int(a[i, k]) << digits) // int(a[k, k])
                a[i, k] = f
                a[i, k + 1:] -= (f * a[k, k + 1:]) >> digits

    def solve(b: np.ndarray) -> np.ndarray:
        x = [int(b[i]) for i in order]
        for k in range(1, d):
            x[k] -= sum(int(p) * q for p, q in zip(a[k, :k], x[:k], strict=True)) >> digits
        for k in range(d - 1, -1, -1):
            rest = sum(int(p) * q for p, q in zip(a[k, k + 1:], x[k + 1:], strict=True)) >> digits
            x[k] = ((x[k] - rest) << digits) // int(a[k, k])
        return np.array(x, object)

    draw = np.random.default_rng(d)
    block = [unit(np.array(draw.integers(-2 ** 40, 2 ** 40, d).tolist(), object), digits)
             for _ in range(multiplicity)]
    for _ in range(3):
        done: list[np.ndarray] = []
        for b in block:
            v = unit(solve(b), digits)
            for _ in range(2):
                for w in done:
                    v = v - ((int(v.dot(w)) >> digits) * w >> digits)
                v = unit(v, digits)
            done.append(v)
        block = done
    return np.array([[int(x) / one for x in v] for v in block])


def components(spark: SparkSession, scatter: np.ndarray, wanted: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """([(t, shift)], (k, d) unit vectors): the largest eigenvalues t / 2**shift and their vectors."""
    roots = largest_roots(characteristic(spark, scatter), wanted)
    if not roots:
        return [], np.zeros((0, len(scatter)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                got = null_space(scatter, *roots[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(got), pa.int64()), pa.array(range(len(got)), pa.int32()),
                     pa.array(got.tolist(), pa.list_(pa.float64()))], names=["k", "j", "v"])

    rows = spark.range(0, len(roots), 1, len(roots)).mapInArrow(run, "k long, j int, v array<double>").collect()
    rows = sorted(rows, key=lambda r: (r["k"], r["j"]))[:wanted]
    return [roots[r["k"]][:2] for r in rows], np.array([r["v"] for r in rows])


# ---- the operator ------------------------------------------------------------------------------------

def ratio(a: int, b: int) -> float:
    """a / b of whole numbers of any size."""
    return a / b if b.bit_length() < 900 and abs(a).bit_length() < 900 else \
        (a >> (b.bit_length() - 200)) / (b >> (b.bit_length() - 200))


def whitening_map(n: int, sums: np.ndarray, weights: np.ndarray) -> Callable[[np.ndarray], tuple]:
    """Map from whole rows to (n y - S as exact whole numbers, whitened rows)."""
    plain = [int(s) for s in sums]
    small = np.array(plain, np.int64) if max(map(abs, plain), default=0) < 1 << 61 else None

    def run(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if small is not None and float(np.abs(y).max(initial=0.0)) * n < 2.0 ** 61:
            apart = y.astype(np.int64) * n - small
        else:
            apart = y.astype(np.int64).astype(object) * n - np.array(plain, object)
        return apart, (apart / n).astype(np.float64) @ weights

    return run


def deviations(apart: np.ndarray) -> list[int | None]:
    """Sum of squares of every row, exact; None beyond a long."""
    top = int(np.abs(apart).max(initial=0)) if len(apart) else 0
    if top * top * apart.shape[1] < 1 << 63 and apart.dtype != object:
        return (apart * apart).sum(axis=1).tolist()
    return [s if (s := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in apart]


def identity_error(vectors: DataFrame, dimension: int, k: int, project: Callable) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all
    rows (which are centred before they are multiplied)."""
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = project(whole(batch.slice(at, ROWS), dimension))[1]
                n, total, gram = n + len(w), total + w.sum(axis=0), gram + w.T @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((upper[0], np.arange(k), [-1])), pa.int32()),
             pa.array(np.concatenate((upper[1], np.full(k, -1), [-1])), pa.int32()),
             pa.array(np.concatenate((gram[upper], total, [n])))], names=["i", "j", "v"])

    got = {(r["i"], r["j"]): r["v"] for r in vectors.mapInArrow(run, "i int, j int, v double")
           .groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    n = got[-1, -1]
    mean = [got[i, -1] / n for i in range(k)]
    return max(abs(got[i, j] / n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(i, k))


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           most_components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every remaining
    row and component (from 1, by falling eigenvalue)."""
    spark = vectors.sparkSession
    ship_package(spark)
    sound = F.forall("v", lambda c: F.coalesce(F.abs(c) < LIMIT, F.lit(False)))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("i"),
                          F.col(f"`{vec_col}`").cast("array<double>").alias("v")
                          ).where(F.col("v").isNotNull() & (F.size("v") > 0) & sound)
    found = (rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), F.desc("d")).first())
    if found is None:
        return spark.createDataFrame([], RESULT)
    dimension = found["d"]
    if dimension > MAX_DIMENSION:
        raise ValueError(f"vectors of more than {MAX_DIMENSION} entries")
    rows = rows.where(F.size("v") == dimension)
    n, sums, gram = moments(rows, dimension)
    scatter = gram * n - np.outer(sums, sums)
    trace = sum(int(scatter[k, k]) for k in range(dimension))
    values, axes = components(spark, scatter, most_components) if trace else ([], None)
    if not values:
        return spark.createDataFrame([], RESULT)
    # the covariance is scatter / n**2, so its eigenvalue's root is sqrt(t / 2**shift) / n
    spread = np.array([math.sqrt(ratio(t, n * n << shift)) for t, shift in values])
    explained = [ratio(t, trace << shift) for t, shift in values]
    project = whitening_map(n, sums, (axes / spread[:, None]).T)
    k = len(values)
    error = identity_error(rows, dimension, k, project)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                apart, w = project(whole(part, dimension))
                m = len(w)
                take = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                     pa.array(np.full(m * k, n)), pa.array(deviations(apart), pa.int64()).take(take),
                     pa.array(w.reshape(-1)), pa.array(np.tile(explained, m)),
                     pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                           "identity_error"])

    return rows.mapInArrow(run, RESULT)
