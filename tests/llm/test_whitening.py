"""Whitening against plain numpy, exact whole numbers, and matrices with known eigenvectors."""

import math
import random

import numpy as np
import pytest
from leadloom.llm import whitening

VECTORS = "vec_id long, embedding array<float>, x string, at int, component string"


def known(values, seed=0):
    """A symmetric matrix with the given eigenvalues, and its eigenvectors in extended precision."""
    rng = np.random.default_rng(seed)
    d = len(values)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q + q @ (np.eye(d) - q.T @ q) / 2
    return ((q * np.array(values, np.longdouble)) @ q.T).astype(np.float64), q


@pytest.mark.parametrize(
    "values",
    [
        list(np.linspace(2, 1, 40)),
        [3, 2, 1 + 1e-9, 1] + [0.5] * 20 + list(np.linspace(0.2, 0.1, 20)),
        [1 + 1e-7 * (30 - i) for i in range(30)],
        [1 + 1e-12 * (8 - i) for i in range(8)],
        [1e200, 1e190, 1.0],
        [7.0],
    ],
)
def test_eigenvectors_to_double_precision(values):
    matrix, q = known(values)
    found, x = whitening.eigen(matrix)
    wide = x.astype(np.longdouble)
    scale = np.abs(matrix).max()
    assert np.abs(wide.T @ wide - np.eye(len(values))).max() < 1e-15
    assert np.abs((matrix / scale).astype(np.longdouble) @ wide - wide * (found / scale)).max() < 2e-15
    assert np.all(np.diff(found) <= 0)
    gaps = [min((abs(v - w) for j, w in enumerate(values) if j != k), default=1.0) for k, v in enumerate(values)]
    for k in np.flatnonzero(np.array(gaps) / max(values) > 1e-3):
        assert abs(abs(float(q[:, k] @ wide[:, k])) - 1) < 1e-13


def test_eigen_of_nothing_and_of_zeros():
    assert whitening.eigen(np.zeros((0, 0)))[0].size == 0
    values, x = whitening.eigen(np.zeros((3, 3)))
    assert not values.any() and np.array_equal(x, np.eye(3))


def expected(rows, components=4):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    x = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v)) for _, v in good]
    x = [[max(-(2**63), min(2**63 - 1, c)) for c in v] for v in x]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[float(c * n - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = np.array([[float(c * n - s) / n for c, s in zip(v, sums, strict=True)] for v in x]) @ vectors[:, :components]
    return good, n, deviation, values, white / np.sqrt(np.maximum(values[:components], 1e-300))


def odd_rows(n=400):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, s, 12)]) for i, s in zip(range(n), rng.uniform(0.1, 3, n), strict=True)]
    rows += [(1000 + i, rows[7][1]) for i in range(50)]
    rows += [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 10), (2003, [math.nan] * 12), (2004, [math.inf] + [0.0] * 11), (2005, [0.5] * 3)]
    rows += [(2006, [-0.0] * 12), (None, rows[9][1]), (5, rows[5][1]), (5, rows[6][1]), (2007, [math.nan] * 20), (2008, [None] * 20)]
    random.Random(1).shuffle(rows)
    return rows


def test_whitening_equals_plain_numpy(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], VECTORS).repartition(5)
    found = whitening.digest(df).collect()
    good, n, deviation, values, white = expected(rows)
    assert len(found) == 4 * len(good)
    assert {r["n"] for r in found} == {n}
    key = {}
    for (i, _), d, w in zip(good, deviation, white, strict=True):
        key.setdefault(i, []).append((d, w))
    signs = {}
    for r in found:
        k = r["component"] - 1
        assert any(r["deviation"] == d for d, _ in key[r["vec_id"]])
        near = [w[k] for d, w in key[r["vec_id"]] if d == r["deviation"]]
        if abs(near[0]) > 1e-3:
            signs.setdefault(k, set()).add(np.sign(near[0]) * np.sign(r["whitened"]))
        assert min(abs(abs(r["whitened"]) - abs(w)) for w in near) < 1e-9
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-12
        assert r["identity_error"] < 1e-12
    assert all(len(s) == 1 for s in signs.values())


def test_numbers_beyond_doubles_stay_exact(spark):
    rows = [(1, [1e30, -1e30]), (2, [3.0, 1e15]), (3, [-2.5, 0.25]), (4, [1e17, 7.0])]
    df = spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], VECTORS)
    x, width = whitening.whole(df)
    model = whitening.fit_whole(x.select("x").distinct(), width)
    made = {r["vec_id"]: int(r["deviation"]) if r["deviation"] is not None else None for r in whitening.whiten(x, model, 2).collect()}
    good, n, deviation, _, _ = expected(rows, 2)
    assert made == {i: d if d < 10**38 else None for (i, _), d in zip(good, deviation, strict=True)}
    assert model.n == n


def test_vectors_without_variance(spark):
    def digest(rows):
        return [tuple(r) for r in whitening.digest(spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], VECTORS)).orderBy("vec_id", "component").collect()]

    assert digest([]) == [] and digest([(1, None), (2, [math.nan])]) == []
    assert digest([(1, [])]) == []
    assert digest([(1, [0.5, 0.5]), (2, [0.5, 0.5])]) == [(i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    line = digest([(1, [0.0, 0.0]), (2, [1.0, 1.0])])
    assert [round(abs(r[4]), 12) for r in line] == [1.0, 0.0, 1.0, 0.0]
    assert [round(r[5], 12) for r in line] == [1.0, 0.0, 1.0, 0.0] and max(r[6] for r in line) < 1e-12
