"""Whitening against numpy's eigenvectors, and its exact parts against sums of Python integers."""

import decimal
import math
import random

import numpy as np
import pytest

from flowspark.llm.whitening import (
    characteristic_polynomial, is_prime, largest_roots, null_vectors, polynomial_modulo, primes_for, roots_above, whiten,
)

CLASHING = "vec_id long, embedding array<double>, x binary, i int, value long, n long, component int"


def table_of(spark, rows):
    return spark.createDataFrame([(v, e, None, 1, 2, 3, 4) for v, e in rows], CLASHING)


def expected(rows, k=4):
    """Whitened rows by floating point; ``rows``: (id, floats) that take part."""
    x = [[math.floor(256 * c) for c in e] for _, e in rows]
    width = max(map(len, x))
    x = [r + [0] * (width - len(r)) for r in x]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(r, sums)] for r in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    order = np.argsort(-values)[:k]
    own = np.array([[c - s / n for c, s in zip(r, sums)] for r in x])
    return n, deviation, own @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def compare(got, rows, k=4, tolerance=1e-8):
    n, deviation, white, share = expected(rows, k)
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation_text), {})[r.component] = r
    keys = [(v, str(d)) for (v, _), d in zip(rows, deviation)]
    assert set(by_row) == set(keys)
    signs = {}
    for key, d, w in zip(keys, deviation, white):
        assert sorted(by_row[key]) == list(range(1, k + 1))
        for c, r in by_row[key].items():
            assert (r.n, r.deviation) == (n, d if d < 2**63 else None)
            assert r.explained == pytest.approx(share[c - 1], rel=1e-9) and r.identity_error < 1e-10
            sign = signs.setdefault(c, np.sign(w[c - 1]) * np.sign(r.whitened))
            assert sign * r.whitened == pytest.approx(w[c - 1], rel=tolerance, abs=tolerance)


def test_equals_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=9) @ np.diag([3, 2, 1.5, 1, 0.7, 0.5, 0.3, 0.2, 0.1])).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[7][1]) for k in range(50)] + [(None, rows[8][1]), (3, rows[9][1])]
    odd = [(60, None), (61, [1.0, None] + [0.0] * 7), (62, [float("nan")] * 9), (63, [float("inf")] + [0.0] * 8)]
    got = whiten(table_of(spark, rows + odd)).collect()
    assert len(got) == 4 * len(rows)
    compare(got, rows)


def test_lengths_differ_and_entries_are_large(spark):
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) * 10 ** rng.randrange(14) for _ in range(rng.randrange(6))]) for k in range(60)]
    compare(whiten(table_of(spark, rows)).collect(), rows, tolerance=1e-6)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, [0.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whiten(table_of(spark, rows)).collect() == []


def test_fewer_components_than_asked(spark):
    rows = [(k, [float(k), 2.0 * k, -3.0]) for k in range(5)]
    compare(whiten(table_of(spark, rows)).collect(), rows, k=1)


def test_equal_eigenvalues_still_whiten(spark):
    """Vectors at plus and minus each axis: all eigenvalues are equal."""
    rows = [(2 * k + s, [(1.0 - 2 * s) * (j == k) for j in range(5)]) for k in range(5) for s in range(2)]
    got = whiten(table_of(spark, rows)).collect()
    assert len(got) == 40 and all(r.identity_error < 1e-12 and r.explained == pytest.approx(0.2, rel=1e-14) for r in got)


def test_close_eigenvalues_are_told_apart():
    """Eigenvalues 10 ** 30 and 10 ** 30 + 3 with known vectors: no double could separate them."""
    turn = np.array([[3, 4, 0], [-4, 3, 0], [0, 0, 5]], object)
    big = 25 * 10**30
    matrix = turn.T @ np.diag(np.array([big + 75, big, 7], object)) @ turn // 25
    first, second = [], []
    eigen = [big + 75, big, 7]
    polynomial = [1, -sum(eigen), eigen[0] * eigen[1] + eigen[2] * (eigen[0] + eigen[1]), -math.prod(eigen)]
    roots = largest_roots(polynomial, 2, sum(eigen))
    assert [n for _, _, n in roots] == [1, 1]
    for (a, bits, _), eigenvalue, into in zip(roots, eigen, (first, second)):
        assert a < eigenvalue << bits <= a + 1
        root = decimal.Context(prec=100).divide(decimal.Decimal(2 * a + 1), decimal.Decimal(2) ** (bits + 1))
        into += [float(x) for x in null_vectors(matrix, root, 1)[0]]
    assert np.abs(first) == pytest.approx([0.6, 0.8, 0], abs=1e-15) and np.abs(second) == pytest.approx([0.8, 0.6, 0], abs=1e-15)


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(3)
    for d in (1, 2, 6, 11):
        x = rng.integers(-5, 6, (d + 2, d)) * 10**6
        m = (x.T @ x).astype(object)
        got = characteristic_polynomial(spark, m)
        # Faddeev and LeVerrier, in whole numbers
        want, part = [1], np.zeros((d, d), object)
        for k in range(1, d + 1):
            part = m @ part + want[-1] * np.diag([1] * d).astype(object)
            want.append(-int(np.trace(m @ part)) // k)
        assert got == want


def test_polynomial_of_matrices_that_break_off():
    """Zero columns below the diagonal, and pivots that must be exchanged."""
    p = 2**31 - 1
    assert polynomial_modulo(np.zeros((4, 4), np.int64), p) == [1, 0, 0, 0, 0]
    assert polynomial_modulo(np.diag([1, 2, 3]), p) == [1, p - 6, 11, p - 6]
    swap = np.array([[0, 0, 1], [0, 2, 0], [1, 0, 0]])
    assert polynomial_modulo(swap, p) == [1, p - 2, p - 1, 2]


def test_roots_above_counts_repeats():
    polynomial = [1, -8, 21, -18, 0]  # x (x - 2) (x - 3) ** 2
    assert [roots_above(polynomial, a, 1) for a in (0, 1, 3, 4, 5, 6)] == [3, 3, 3, 2, 2, 0]
    assert [n for _, _, n in largest_roots(polynomial, 4, 8)] == [2, 2, 1]


def test_primes():
    assert [n for n in range(60) if is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert primes_for(2**40) == [2**31 - 1, 2147483629] and not is_prime(25326001)
