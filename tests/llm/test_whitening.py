"""Exact polynomials and roots, and whitening against numpy on messy tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from passagework.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, x string, size int, at long, label int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in vectors], SCHEMA).repartition(3)


def plain(vectors):
    """(n, whitened up to sign, shares) of usable (id, vector) rows, by numpy."""
    x = np.array([[math.floor(256 * c) for c in v] for _, v in vectors], float)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    order = np.argsort(-values)[:4]
    return len(fit), (x - fit.mean(axis=0)) @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_like_numpy_on_a_messy_table(spark):
    r = np.random.default_rng(1)
    good = [(i, (r.normal(size=9) * np.arange(1, 10) / 7).tolist()) for i in range(300)]
    good += [(1000 + i, good[5][1]) for i in range(150)] + [(5, good[6][1]), (None, good[7][1])]
    bad = [(1, None), (2, [1.0] * 8 + [None]), (3, [1.0] * 8 + [math.nan]), (4, [math.inf] * 9), (6, []), (7, [1.0, 2.0]), (8, [1.0] * 10)]
    rows = whitening.whitened(table(spark, good + bad)).collect()
    n, w, shares = plain(good)
    assert len(rows) == 4 * len(good)
    got = {}
    for row in rows:
        assert row.n == n and row.identity_error < 1e-12
        assert row.explained == pytest.approx(shares[row.component - 1], rel=1e-9)
        got.setdefault(row.component, []).append((row.vec_id if row.vec_id is not None else -1, row.deviation, row.whitened))
    x = [[math.floor(256 * c) for c in v] for _, v in good]
    sums = [sum(c) for c in zip(*{tuple(v) for v in x})]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    for k in range(1, 5):
        sign = np.sign(sum(a[2] * b for a, b in zip(sorted(got[k]), [e[2] for e in sorted((i if i is not None else -1, d, y) for (i, _), d, y in zip(good, deviations, w[:, k - 1]))])))
        for s in (sign,):
            wanted = sorted((i if i is not None else -1, d, s * y) for (i, _), d, y in zip(good, deviations, w[:, k - 1]))
            for a, b in zip(sorted(got[k]), wanted):
                assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9)


def test_tables_without_components(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitened(table(spark, [(1, None), (2, []), (3, [math.nan])])).count() == 0
    assert whitening.whitened(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0


def test_components_stop_at_the_rank(spark):
    vectors = [(i, [float(i), 2.0 * i, -float(i)]) for i in range(20)]
    rows = whitening.whitened(table(spark, vectors)).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 20
    assert all(r.explained == pytest.approx(1) and r.identity_error < 1e-12 for r in rows)


def test_repeated_roots(spark):
    corners = [(i, [a, b, c, 0.0]) for i, (a, b, c) in enumerate((x, y, z) for x in (-1.0, 1.0) for y in (-1.0, 1.0) for z in (-1.0, 1.0))]
    rows = whitening.whitened(table(spark, corners)).collect()
    assert {r.component for r in rows} == {1, 2, 3}
    assert all(r.identity_error < 1e-12 and r.explained == pytest.approx(1 / 3) for r in rows)


def test_entries_beyond_longs(spark):
    vectors = [(i, [c, float(i)]) for i, c in enumerate([1e300, -1e300, 3e16, 0.5, -0.0])]
    rows = whitening.whitened(table(spark, vectors)).collect()
    assert len(rows) == 10 and all(r.identity_error < 1e-6 for r in rows)
    assert {r.deviation for r in rows} == {None}
    assert all(math.isfinite(r.whitened) for r in rows)


def test_products_are_exact():
    r = random.Random(2)
    x = np.array([[r.randint(-(1 << 63), (1 << 63) - 1), r.randint(-300, 300), -(1 << 63)] for _ in range(50)], np.int64)
    wanted = [[sum(int(a[i]) * int(a[j]) for a in x) for j in range(3)] for i in range(3)]
    assert whitening.products(x).tolist() == wanted


def test_polynomial_and_roots(spark):
    matrix = np.array([[2, 0, 0, 0], [0, 2, 0, 0], [0, 0, 7, 3], [0, 0, 3, 7]], object)
    found = whitening.characteristic_polynomial(spark, matrix)
    assert found == np.poly([2, 2, 4, 10])[::-1].round().astype(int).tolist()
    roots = whitening.largest_roots(found, 4)
    for root, true in zip(roots, (10, 4, 2, 2)):
        assert abs(root - true) < Fraction(1, 1 << 100)
    assert whitening.largest_roots([0, 0, -3, 1], 4) == pytest.approx([3])
    prime = whitening.primes_below(1 << 31, 1)[0]
    assert prime == (1 << 31) - 1
    r = np.random.default_rng(3)
    for size in (1, 2, 5, 12):
        m = r.integers(-5, 6, (size, size)).astype(object)
        m = m @ m.T
        wanted = [int(c) for c in np.rint(np.poly(m.astype(float)))[::-1]] if size < 6 else None
        exact = whitening.characteristic_polynomial(spark, m)
        if wanted:
            assert exact == wanted
        # the matrix fulfils its own polynomial
        power, total = np.eye(size, dtype=object), np.zeros((size, size), object)
        for c in exact:
            total, power = total + c * power, power @ m
        assert not total.any()


def test_null_vector_of_close_roots():
    matrix = np.array([[10**12, 1, 0], [1, 10**12, 0], [0, 0, 5]], object)
    roots = [Fraction(10**12 + 1), Fraction(10**12 - 1), Fraction(5)]
    for root, wanted in zip(roots, ([1, 1, 0], [1, -1, 0], [0, 0, 1])):
        v = np.array([float(Fraction(int(x), 1 << 320)) for x in whitening.null_vector(matrix, root, [], 320)])
        w = np.array(wanted) / np.linalg.norm(wanted)
        assert abs(abs(v @ w) - 1) < 1e-15
