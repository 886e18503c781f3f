from fractions import Fraction
import math

import numpy as np
import pytest

from concordat.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string, size int, component string"


def naive(vectors):
    """n, exact deviations, covariance (floats of exact fractions) and centred vectors."""
    x = [[math.floor(Fraction(c) * 1024) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    z = [[n * r[k] - s[k] for k in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(d)] for i in range(d)])
    return n, [sum(v * v for v in r) for r in z], cov, np.array([[float(Fraction(v, n)) for v in r] for r in z])


def check(spark, vectors, tolerance=1e-9):
    rows = whitening.whiten(spark.createDataFrame([(i, v, "x", 1, "y") for i, v in enumerate(vectors)], SCHEMA)).collect()
    n, deviation, cov, centred = naive(vectors)
    k = min(8, len(vectors[0]))
    assert len(rows) == n * k and {r["n"] for r in rows} == {n}
    long = [v if v < 1 << 63 else None for v in deviation]
    assert all(r["deviation"] == long[r["vec_id"]] for r in rows)
    e = np.linalg.eigvalsh(cov)[::-1]
    w = np.full((n, k), np.nan)
    for r in rows:
        w[r["vec_id"], r["component"] - 1] = math.nan if r["whitened"] is None else r["whitened"]
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-4, abs=1e-13)
    alive = ~np.isnan(w).any(axis=0)
    error = np.abs(w[:, alive].T @ w[:, alive] / n - np.eye(alive.sum())).max()
    assert error < 1e-4 and abs(rows[0]["identity_error"] - error) < tolerance
    # w = centred @ v / sqrt(e): the direction is an eigenvector of the covariance
    for c in np.flatnonzero(alive):
        v = np.linalg.lstsq(centred, w[:, c], rcond=None)[0]
        v /= np.linalg.norm(v)
        assert np.abs(cov @ v - (v @ cov @ v) * v).max() < 1e-6 * e[0]
    return rows, alive


def test_whitening_matches_fractions(spark):
    rnd = np.random.default_rng(3)
    check(spark, (rnd.normal(size=(300, 12)) * np.linspace(0.1, 1, 12)).tolist())


def test_few_dimensions_and_large_and_negative_entries(spark):
    rnd = np.random.default_rng(4)
    vectors = (rnd.normal(size=(60, 3)) * [1, 300, 9e4] - [0, 5000, 8e5]).tolist()
    check(spark, vectors)


def test_small_components_beside_large_ones(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(400, 4)) * [1e6, 1e3, 1, 0.5]
    x[:, 1] += x[:, 0] / 3  # correlated, so that no axis is a component
    rows, alive = check(spark, x.tolist())
    assert alive.all()


def test_components_without_variance(spark):
    rows, alive = check(spark, [[float(i), 2.0 * i, 7.0] for i in range(20)])
    assert alive.tolist() == [True, False, False]
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    assert len(whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0, 1.0])], "vec_id long, embedding array<float>")).collect()) == 3


def test_which_rows_remain(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.0, 0.0]), (None, [3.0, 1.0]), (1, [1.0, 2.0]), (7, []), (8, [5.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    ids = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["component"], r["n"]) for r in found)
    assert ids == sorted([(i, c, 4) for i in (1, 1, 6, -1) for c in (1, 2)] + [(8, 1, 1)])


def test_empty_table_and_lengths_beyond_the_bound(spark, monkeypatch):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    monkeypatch.setattr(whitening, "MAX_CELLS", 5)
    with pytest.raises(ValueError):
        whitening._refuse(6)


def test_huge_entries_are_held(spark):
    found = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert len(found) == 6 and {r["deviation"] for r in found if r["vec_id"] != 3} == {None}
    assert all(r["whitened"] is not None for r in found if r["component"] == 1)


def test_limbs_and_digits_are_exact():
    rnd = np.random.default_rng(6)
    for top in (1, 1 << 15, 1 << 16, 1 << 40, 1 << 62):
        x = rnd.integers(-top, top + 1, size=(50, 5))
        parts = whitening.limbs(x)
        assert sum(p.astype(np.int64).astype(object) << (whitening.LIMB * k) for k, p in enumerate(parts)).tolist() == x.tolist()
        gram = whitening.Gram(5)
        gram.add(x)
        gram.add(x)
        got = gram.cells().to_pylist()
        exact = x.astype(object).T @ x.astype(object) * 2
        for r in got:
            value = sum(r[f"digit_{k}"] << (32 * k) for k in range(whitening.DIGITS))
            want = 100 if r["i"] < 0 else 2 * int(x[:, r["i"]].astype(object).sum()) if r["j"] < 0 else exact[r["i"], r["j"]]
            assert value == want


def test_products_folded_between_blocks(monkeypatch):
    monkeypatch.setattr(whitening, "FOLD", 2)
    x = np.arange(-10, 10).reshape(10, 2) * 70_001
    gram = whitening.Gram(2)
    for _ in range(5):
        gram.add(x)
    gram.fold()
    assert gram.products.tolist() == (5 * (x.astype(object).T @ x.astype(object))).tolist()
