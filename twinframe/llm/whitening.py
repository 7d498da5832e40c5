"""Whitening of vectors from an exact characteristic polynomial.

Entries become integers, so the scatter of the distinct vectors is an integer
matrix, summed over tasks without rounding. Its characteristic polynomial comes
from Hessenberg reductions modulo many primes, one task each, put together by
Chinese remaindering. All its roots are real, so signs of a shifted polynomial
count the roots above a point exactly; bisection isolates the largest ones to
far more than double precision. A component is the null vector of the scatter
less its root, by inverse iteration in fixed-point numbers.

Driver and tasks hold matrices of dimension x dimension, never vectors of all rows.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_batches

SCALE, SHIFT = 64, 1_000_000
# Scaled entries beyond this size are read as this size.
LIMIT = 2.0 ** 61
# Matrices of this many rows and columns at most are held.
MOST_DIMENSIONS = 1024
# Bits to which a root is known, those at which roots still together count as equal, and of fixed-point numbers.
ROOT_BITS, EQUAL_BITS, POINT_BITS = 160, 96, 288
_LIMB = 60
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: x of n distinct vectors has sums S, and y = n * x - S the scatter / n of `roots`."""

    n: int
    sums: list[int]
    components: np.ndarray  # one unit vector per row
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float


def integer_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """`(key, x)` of the rows with a vector without null or non-finite entries: x = floor(64 * entry) + 1000000."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    ok = F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(
        ~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return df.select(F.col(key).alias("key"), x.alias("x")).filter(ok).select("key", F.transform("x", lambda c: F.floor(
        F.greatest(F.least(c * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))) + F.lit(SHIFT).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _columns(entries: list[tuple[int, int, int]], names=("i", "j", "high", "low")) -> pa.RecordBatch:
    """Entries of a matrix; a value is high * 2 ** 60 + low, so that sums stay within decimals."""
    high = [Decimal(v >> _LIMB) for *_, v in entries]
    low = [Decimal(v & ((1 << _LIMB) - 1)) for *_, v in entries]
    kind = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays([
        pa.array([i for i, *_ in entries], pa.int32()), pa.array([j for _, j, _ in entries], pa.int32()),
        pa.array(high, kind), pa.array(low, kind)], list(names))


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    rows = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {(r.i, r.j): (int(r.high) << _LIMB) + int(r.low) for r in rows}


def column_sums(vectors: DataFrame, d: int) -> list[int]:
    """Exact sums per dimension of `vectors(x)`."""
    def run(batches):
        sums = [0] * d
        for batch in batches:
            x = _matrix(batch.column(0))
            # Halves of 32 bits can be added up for two thousand million rows.
            high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
            sums = [s + (h << 32) + v for s, h, v in zip(sums, high, low)]
        yield _columns([(i, 0, s) for i, s in enumerate(sums)])

    added = _added(map_batches(vectors, run, "i int, j int, high decimal(38,0), low decimal(38,0)"))
    return [added[i, 0] for i in range(d)]


def gram(z: np.ndarray) -> np.ndarray:
    """z' z exactly, as Python integers; products of floats serve as long as they are exact."""
    d = z.shape[1]
    out = np.zeros((d, d), object)
    large = np.abs(z).max(1, initial=0) >= 1 << 20
    for a in range(0, len(z), 4096):
        part = z[a:a + 4096][~large[a:a + 4096]].astype(np.float64)
        out += (part.T @ part).astype(np.int64)  # 2 ** 12 rows of products below 2 ** 40
    for row in z[large]:
        exact = row.astype(object)
        out += np.outer(exact, exact)
    return out


def scatter(vectors: DataFrame, center: list[int]) -> list[list[int]]:
    """Sum of (x - center)(x - center)' over `vectors(x)`, exactly."""
    d, middle = len(center), np.array(center, np.int64)

    def run(batches):
        out = np.zeros((d, d), object)
        for batch in batches:
            out += gram(_matrix(batch.column(0)) - middle)
        yield _columns([(i, j, int(out[i, j])) for i in range(d) for j in range(i, d)])

    added = _added(map_batches(vectors, run, "i int, j int, high decimal(38,0), low decimal(38,0)"))
    return [[added[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]


def primes_below(limit: int, count: int) -> list[int]:
    """The largest `count` primes below 2 ** 31, or another limit up to 3 * 10 ** 9."""
    found, n = [], limit - 1 | 1
    while len(found) < count:
        n -= 2
        twos = ((n - 1) & (1 - n)).bit_length() - 1
        if n % 3 and n % 5 and all(_passes(n, a, twos) for a in (2, 3, 5, 7)):
            found.append(n)
    return found


def _passes(n: int, a: int, twos: int) -> bool:
    x = pow(a, n - 1 >> twos, n)
    if x in (1, n - 1):
        return True
    for _ in range(twos - 1):
        x = x * x % n
        if x == n - 1:
            return True
    return False


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients modulo p, from the highest power, of the characteristic polynomial; entries lie in [0, p)."""
    h, d = matrix.copy(), len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        r = k + 1 + below[0]
        if r != k + 1:
            h[[r, k + 1]] = h[[k + 1, r]]
            h[:, [r, k + 1]] = h[:, [k + 1, r]]
        f = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - f[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * f % p).sum(1)) % p
    # Row k: the polynomial of the leading k x k block, from the lowest power.
    rows = np.zeros((d + 1, d + 1), np.int64)
    rows[0, 0] = 1
    for k in range(d):
        weights, t = np.zeros(k + 1, np.int64), 1
        weights[k] = h[k, k]
        for i in range(k - 1, -1, -1):
            t = t * int(h[i + 1, i]) % p
            weights[i] = int(h[i, k]) * t % p
        new = -(weights[:, None] * rows[:k + 1] % p).sum(0)
        new[1:] += rows[k, :-1]
        rows[k + 1] = new % p
    return rows[d, ::-1].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, from the highest power, for a symmetric matrix without negative eigenvalues.

    Coefficient k is at most C(d, k) * (trace / d) ** k in size, by which primes
    are counted. Each prime is a row, and the reductions are spread over tasks.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bits = max(
        math.log2(math.comb(d, k)) + k * math.log2(max(Fraction(trace, d), 1)) for k in range(d + 1))
    primes = primes_below(1 << 31, int(bits / 30) + 2)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches):
        exact = np.array(shared.value, object)
        for batch in batches:
            for p in batch.column(0).to_pylist():
                found = polynomial_mod((exact % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["p", "found"])

    asked = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 256))
    residues = map_batches(asked, run, "p long, found array<long>").collect()
    modulus = math.prod(r.p for r in residues)
    out = [0] * (d + 1)
    for r in residues:
        rest = modulus // r.p
        unit = rest * pow(rest, -1, r.p)
        out = [(c + unit * v) % modulus for c, v in zip(out, r.found)]
    # Signs alternate; the bound leaves the other half of the range empty.
    return [c - modulus if k % 2 and c else c for k, c in enumerate(out)]


def _above(coefficients: list[int], a: int, bits: int) -> int:
    """Roots over a / 2 ** bits, with multiplicity: sign changes of the polynomial shifted there, as all roots are real."""
    c = [v << bits * k for k, v in enumerate(coefficients)]
    for last in range(len(c) - 1, 0, -1):
        for j in range(1, last + 1):
            c[j] += a * c[j - 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(coefficients: list[int], a: int, bits: int) -> int:
    value = 0
    for k, v in enumerate(coefficients):
        value = value * a + (v << bits * k)
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], wanted: int) -> list[tuple[int, int, int]]:
    """`(a, bits, times)`, falling, of up to `wanted` positive roots: the root is just over a / 2 ** bits.

    Intervals are halved until each holds one root, which is then closed in on by
    the sign, or until roots that are still together are equal to EQUAL_BITS.
    """
    while len(coefficients) > 1 and not coefficients[-1]:
        coefficients = coefficients[:-1]
    degree = len(coefficients) - 1
    if not degree:
        return []
    # The sum of the roots is over every one of them.
    top = 1 << (-coefficients[1]).bit_length()
    found: list[tuple[int, int, int]] = []
    # Intervals (a, a + 1] / 2 ** bits with the roots over either end; the highest lies on top.
    stack = [(0, -top.bit_length() + 1, 0, degree)]
    total = 0
    while stack and total < wanted:
        a, bits, over, from_here = stack.pop()
        times = from_here - over
        if not times:
            continue
        known = a.bit_length()
        if times == 1 and known > 2 or known > EQUAL_BITS:
            if times == 1:
                a, bits = _closer(coefficients, a, bits)
            found.append((a, bits, times))
            total += times
            continue
        middle = _above_scaled(coefficients, 2 * a + 1, bits + 1)
        stack.append((2 * a, bits + 1, middle, from_here))
        stack.append((2 * a + 1, bits + 1, over, middle))
    return found


def _above_scaled(coefficients: list[int], a: int, bits: int) -> int:
    return _above(coefficients, a, bits) if bits >= 0 else _above(coefficients, a << -bits, 0)


def _closer(coefficients: list[int], a: int, bits: int) -> tuple[int, int]:
    """The same root to ROOT_BITS: the sign over the interval's upper end is the one to keep."""
    def sign(a: int, bits: int) -> int:
        return _sign(coefficients, a, bits) if bits >= 0 else _sign(coefficients, a << -bits, 0)

    upper = sign(a + 1, bits)
    if not upper:  # the end itself is the root
        shift = max(0, ROOT_BITS - (a + 1).bit_length())
        return (a + 1) << shift, bits + shift
    while a.bit_length() < ROOT_BITS:
        a, bits = 2 * a, bits + 1
        now = sign(a + 1, bits)
        if not now:
            shift = max(0, ROOT_BITS - (a + 1).bit_length())
            return (a + 1) << shift, bits + shift
        if now != upper:
            a += 1
    return a, bits


def null_vectors(matrix: list[list[int]], a: int, bits: int, times: int) -> list[list[int]]:
    """`times` orthogonal unit vectors, times 2 ** POINT_BITS, that the matrix multiplies by a / 2 ** bits."""
    d, one = len(matrix), 1 << POINT_BITS
    size = max(1, sum(matrix[i][i] for i in range(d))).bit_length()
    up = POINT_BITS - size
    root = a << up - bits if up >= bits else a >> bits - up
    m = [[v << up if up >= 0 else v >> -up for v in row] for row in matrix]
    for i in range(d):
        m[i][i] -= root
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda r: abs(m[r][k]))
        m[k], m[best], order[k], order[best] = m[best], m[k], order[best], order[k]
        if not m[k][k]:
            m[k][k] = 1
        pivot, row = m[k][k], m[k]
        for r in range(k + 1, d):
            f = (m[r][k] << POINT_BITS) // pivot
            if f:
                m[r][k + 1:] = [x - (f * y >> POINT_BITS) for x, y in zip(m[r][k + 1:], row[k + 1:])]
            m[r][k] = f

    def solve(b: list[int]) -> list[int]:
        x = [b[i] for i in order]
        for k in range(d):
            x[k] -= sum(map(int.__mul__, m[k][:k], x[:k])) >> POINT_BITS
        for k in range(d - 1, -1, -1):
            x[k] = ((x[k] << POINT_BITS) - sum(map(int.__mul__, m[k][k + 1:], x[k + 1:]))) // m[k][k]
        return x

    def unit(x: list[int]) -> list[int]:
        # Against the others twice, as the first time rounds.
        for _ in range(2):
            for other in found:
                along = sum(map(int.__mul__, x, other)) >> POINT_BITS
                x = [v - (along * o >> POINT_BITS) for v, o in zip(x, other)]
        width = max(map(abs, x)).bit_length()
        x = [v << POINT_BITS - width if POINT_BITS >= width else v >> width - POINT_BITS for v in x]
        length = math.isqrt(sum(v * v for v in x)) or 1
        return [v * one // length for v in x]

    draw = random.Random(d)
    found: list[list[int]] = []
    for _ in range(times):
        x = unit([draw.getrandbits(POINT_BITS) - one // 2 for _ in range(d)])
        for _ in range(4):
            x = unit(solve(x))
        found.append(x)
    return found


def components(
    spark: SparkSession, matrix: list[list[int]], keep: int,
) -> tuple[list[Fraction], np.ndarray]:
    """The largest positive eigenvalues and their unit vectors, falling; every group of equal ones is a task."""
    roots = largest_roots(characteristic_polynomial(spark, matrix), keep)
    if not roots:
        return [], np.zeros((0, len(matrix)))
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches):
        for batch in batches:
            for place, a, bits, times in zip(*(c.to_pylist() for c in batch.columns)):
                vectors = null_vectors(shared.value, int(a), bits, times)
                doubles = [[float(Fraction(v, 1 << POINT_BITS)) for v in x] for x in vectors]
                yield pa.RecordBatch.from_arrays([
                    pa.array([place] * times, pa.int32()), pa.array(doubles, pa.list_(pa.float64()))],
                    ["place", "vector"])

    asked = spark.createDataFrame(
        [(i, str(a), bits, times) for i, (a, bits, times) in enumerate(roots)],
        "place int, a string, bits int, times int").repartition(len(roots))
    rows = sorted(map_batches(asked, run, "place int, vector array<double>").collect(), key=lambda r: r.place)
    values = [Fraction(a) / Fraction(2) ** bits for a, bits, times in roots for _ in range(times)][:keep]
    vectors = np.array([r.vector for r in rows])[:keep]
    # One sign for all rows: the entry of the largest size is positive.
    largest = np.abs(vectors).argmax(1)
    return values, vectors * np.sign(vectors[np.arange(len(vectors)), largest])[:, None]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: 64-bit integers where they fit, else Python's."""
    high = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if high < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _projected(y: np.ndarray, model_n: int, components: np.ndarray, variances: np.ndarray) -> np.ndarray:
    return (y.astype(np.float64) / model_n) @ components.T / np.sqrt(variances)


def fit(rows: DataFrame, keep: int = 16) -> Whitening | None:
    """The whitening of `rows(x)`, each distinct vector counted once; None without a vector. Lengths must agree."""
    spark = rows.sparkSession
    vectors = materialize(rows.select("x").distinct(), "vectors")
    n = vectors.count()
    if not n:
        return None
    d = len(vectors.first().x)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; matrices of up to {MOST_DIMENSIONS} are held in one place")
    sums = column_sums(vectors, d) if d else []
    if not d:
        return Whitening(n, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    center = [(2 * s + n) // (2 * n) for s in sums]
    around = scatter(vectors, center)
    left = [s - n * c for s, c in zip(sums, center)]
    matrix = [[n * around[i][j] - left[i] * left[j] for j in range(d)] for i in range(d)]
    values, vectors_ = components(spark, matrix, keep)
    trace = sum(matrix[i][i] for i in range(d))
    variances = np.array([float(v / (n * n)) for v in values])
    k = len(values)

    def run(batches):
        total, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _projected(_deviations(_matrix(batch.column(0)), n, sums), n, vectors_, variances)
            total += w.sum(0)
            squares += w.T @ w
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(k), k + 1), pa.int32()), pa.array(np.tile(np.arange(k + 1), k), pa.int32()),
            pa.array(np.column_stack((squares, total)).ravel())], ["i", "j", "v"])

    error = 0.0
    if k:
        parts = map_batches(vectors, run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
        table = np.zeros((k, k + 1))
        for r in parts.collect():
            table[r.i, r.j] = r.v / n
        # The deviations add up to zero, so the means are rounding only.
        covariance = table[:, :k] - np.outer(table[:, k], table[:, k])
        error = float(np.abs(covariance - np.eye(k)).max())
    return Whitening(n, sums, vectors_, variances, np.array([float(v / trace) for v in values]), error)


def whitened(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """`(key, component, n, deviation, whitened, explained, identity_error)`: one row per row of `rows(key, x)` and component.

    deviation is the squared length of n * x - S, exact, and null where it does not fit into a long.
    """
    key_type = rows.schema["key"].dataType.simpleString()
    schema = (f"key {key_type}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    k = 0 if model is None else len(model.variances)

    def run(batches):
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                y = _deviations(_matrix(part.column(1)), model.n, model.sums)
                if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] <= _LONG:
                    squares = (y * y).sum(1).tolist()
                else:
                    squares = [v if v <= _LONG else None for v in (y.astype(object) ** 2).sum(1)]
                w = _projected(y, model.n, model.components, model.variances)
                m = len(w)
                which = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(which), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n), pa.int64()), pa.array(squares, pa.int64()).take(which),
                    pa.array(w.ravel()), pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * k, model.identity_error))],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_batches(rows.select("key", "x"), run, schema)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: int = 16) -> DataFrame:
    """Up to `keep` whitened components of every row with a usable vector; see `whitened` for the columns.

    Rows whose vector is null or holds a null or non-finite entry are left out,
    and so are vectors of another length than most (of equally frequent lengths
    the smaller counts). Entries beyond 2 ** 55 in size are read as that size.
    Components without variance are not returned, so equal vectors, empty ones
    and empty tables give no row. Keys may be null or repeated.
    """
    rows = materialize(integer_rows(df, key, vector), "integers")
    widths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.filter(F.size("x") == (widths[0].d if widths else 0))
    return whitened(rows, fit(rows, keep))
