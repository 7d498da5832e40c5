import math
import random

import numpy as np
import pytest

from twinframe.llm import whitening

FOLDER = "/root/testdata/sf0.001"


def plain(vectors, keep=16):
    """Whitening by floating point: x, n, the deviations, and the absolute whitened entries."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    y = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in fit])
    values, columns = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:keep]
    own = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    return n, deviation, np.abs(own @ columns[:, order] / np.sqrt(values[order])), values[order] / values.sum()


def test_query_against_floating_point(spark):
    from twinframe.llm.queries import QUERIES

    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, wanted, explained = plain([r.embedding for r in rows])
    got = QUERIES["op13_embedding_whitening"](spark, FOLDER).orderBy("vec_id", "component").collect()
    assert len(got) == 16 * len(rows)
    for i, r in enumerate(got):
        assert (r.vec_id, r.component, r.n) == (rows[i // 16].vec_id, i % 16 + 1, n)
        assert r.deviation == deviation[i // 16] and r.identity_error < 1e-9
        assert math.isclose(r.explained, explained[i % 16], rel_tol=1e-9)
        assert math.isclose(abs(r.whitened), wanted[i // 16][i % 16], rel_tol=1e-6, abs_tol=1e-8)


def scattered(d, rows, seed, size=50):
    rng = random.Random(seed)
    z = [[rng.randint(-size, size) for _ in range(d)] for _ in range(rows)]
    return [[sum(r[i] * r[j] for r in z) for j in range(d)] for i in range(d)]


def determinant(m):
    """Exact, by elimination without fractions."""
    m, d, sign, last = [row[:] for row in m], len(m), 1, 1
    for k in range(d - 1):
        if not m[k][k]:
            swap = next((r for r in range(k + 1, d) if m[r][k]), None)
            if swap is None:
                return 0
            m[k], m[swap], sign = m[swap], m[k], -sign
        for i in range(k + 1, d):
            for j in range(k + 1, d):
                m[i][j] = (m[i][j] * m[k][k] - m[i][k] * m[k][j]) // last
        last = m[k][k]
    return sign * m[-1][-1]


@pytest.mark.parametrize("d, rows", [(1, 3), (5, 20), (9, 4), (12, 40)])
def test_polynomial_is_exact(spark, d, rows):
    matrix = scattered(d, rows, d, 10**7)
    found = whitening.characteristic_polynomial(spark, matrix)
    assert found[0] == 1 and found[1] == -sum(matrix[i][i] for i in range(d))
    for x in (-7, 0, 3, 10**9):
        assert sum(c * x ** (d - k) for k, c in enumerate(found)) == determinant(
            [[x * (i == j) - matrix[i][j] for j in range(d)] for i in range(d)])


def test_roots_with_multiplicity():
    def times(p, root):
        return [a - root * b for a, b in zip([*p, 0], [0, *p])]

    p = [1]
    for root in (0, 0, 3, 3, 3, 1000, 1001, 10**12):
        p = times(p, root)
    got = [(a / 2.0 ** bits, n) for a, bits, n in whitening.largest_roots(p, 16)]
    assert [n for _, n in got] == [1, 1, 1, 3]
    assert all(math.isclose(v, w, rel_tol=1e-15) for (v, _), w in zip(got, (10**12, 1001, 1000, 3)))
    assert len(whitening.largest_roots(p, 2)) == 2 and whitening.largest_roots([1, 0, 0], 2) == []


def test_close_and_equal_eigenvalues(spark):
    # Two eigenvalues differ in the twelfth digit, two are equal.
    big = 10**12
    matrix = [[big + 1, 0, 0, 0, 0], [0, big, 0, 0, 0], [0, 0, 7, 2, 0], [0, 0, 2, 7, 0], [0, 0, 0, 0, 9]]
    values, vectors = whitening.components(spark, matrix, 16)
    assert [float(v) for v in values] == [big + 1, big, 9, 9, 5]
    assert np.allclose(vectors @ vectors.T, np.eye(5), atol=1e-14)
    m = np.array(matrix, float)
    assert all(np.abs(m @ v - float(e) * v).max() <= 1e-15 * float(e) * 4 for e, v in zip(values, vectors))


def test_gram_of_large_numbers():
    rng = np.random.default_rng(3)
    z = rng.integers(-(1 << 40), 1 << 40, (30, 4))
    z[:15] = rng.integers(-500, 500, (15, 4))
    exact = z.astype(object)
    assert (whitening.gram(z) == exact.T.dot(exact)).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(4)
    good = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(12)]
    rows = [(i, v, "a") for i, v in enumerate(good)]
    rows += [(0, good[0], "b"), (None, good[1], None), (20, None, "a"), (21, [1.0, None, 2.0], "a"), (22, [nan, 1.0, 1.0], "a"),
             (23, [inf, 1.0, 1.0], "a"), (24, [1.0, 2.0], "a"), (25, [], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string").withColumnRenamed("x", "key")
    got = whitening.whiten(df).collect()
    assert len(got) == 14 * 3 and {r.key for r in got} == {None, *range(12)}
    n, deviation, wanted, _ = plain(good)
    assert all(r.n == n == 12 for r in got)
    for r in got:
        i = 1 if r.key is None else r.key
        assert r.deviation == deviation[i] and math.isclose(abs(r.whitened), wanted[i][r.component - 1], rel_tol=1e-9, abs_tol=1e-10)
    # Huge finite entries: exact inside, no deviation that fits.
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whiten(huge).collect()] == [None] * 4 + [r.deviation for r in whitening.whiten(huge).filter("key = 3").collect()]
    for none in (df.limit(0), df.filter("vec_id = 3"), df.filter("vec_id = 25")):
        assert whitening.whiten(none).count() == 0
