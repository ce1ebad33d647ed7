"""Whitening against exact integers and an eigen-decomposition in one place."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from modiste.llm import whitening

FOLDER = "/root/testdata/sf0.001"


def plain(rows, components=32):
    """(vec_id, x, deviation) of the rows that take part, and eigenvalues, vectors and whitened values."""
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in fine)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in fine]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in x])
    values, axes = np.linalg.eigh(y.T @ y / n)
    return [i for i, _ in fine], n, dev, y, values[::-1], axes[:, ::-1]


def check(spark, rows, n_components, parts=4, tight=1e-7):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, x string").repartition(parts)
    got = whitening.whitened(df).collect()
    ids, n, dev, y, values, axes = plain(rows)
    assert len(got) == len(ids) * n_components and {r.n for r in got} == {n}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-4
    by: dict = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    want: dict = {}
    for i, d, v in zip(ids, dev, y):
        want.setdefault(i, []).append((d, v))
    assert set(by) == set(want)
    for k in range(1, n_components + 1):
        assert all(abs(r.explained / (values[k - 1] / values.sum()) - 1) < 1e-4 for i in by for r in by[i][k])
    for i in by:
        assert all(sorted((r.deviation for r in by[i][k]), key=str) == sorted((d if d < 1 << 63 else None for d, _ in want[i]), key=str) for k in by[i])
    first = {k: np.array([by[i][k][0].whitened for i in by]) for k in range(1, n_components + 1)}
    flat = np.array([want[i][0][1] for i in by])
    for k in first:  # components whose eigenvalues stand apart
        gaps = np.abs(np.delete(values, k - 1) / values[k - 1] - 1).min() if len(values) > 1 else 1
        if gaps > 1e-3:
            w = flat @ axes[:, k - 1] / math.sqrt(values[k - 1])
            assert min(np.abs(w - first[k]).max(), np.abs(w + first[k]).max()) < tight * np.abs(w).max()
    return got


def test_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = check(spark, rows, 32)
    assert got[0].identity_error < 1e-10


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=5) * [9, 3, 1, 0.5, 0.2]).tolist()) for i in range(200)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0]), (3, rows[3][1]), (400, None), (401, [1.0, None, 0.0, 0.0, 0.0]), (402, [math.nan, 0.0, 0.0, 0.0, 0.0]), (403, [math.inf] * 5), (404, [1.0, 2.0]), (405, [])]
    check(spark, rows, 5)


def test_wide_range_of_variances(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3000, 6)) * [1e6, 1e4, 1e3, 100, 10, 1]
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    check(spark, [(i, v.tolist()) for i, v in enumerate(base @ turn)], 6, tight=1e-3)


def test_directions_without_variance_have_no_component(spark):
    rng = np.random.default_rng(3)
    a = np.floor(rng.normal(size=(50, 3)) * 640) / 64
    rows = [(i, [*v, v[0], v[1] + v[2], 7.0]) for i, v in enumerate(a.tolist())]
    check(spark, rows, 3)
    check(spark, [(i, rng.normal(size=10).tolist()) for i in range(5)], 4)


def test_very_long_vectors_and_deviations_beyond_64_bits(spark):
    rng = np.random.default_rng(4)
    got = check(spark, [(i, rng.normal(size=2000).tolist()) for i in range(60)], 32)
    assert all(r.deviation for r in got)
    rows = [(i, [1e9 * i, 1e9 * (i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, _, dev, *_ = plain(rows)
    assert {r.vec_id: r.deviation for r in whitening.whitened(df).collect()} == {i: d if d < 1 << 63 else None for i, d in enumerate(dev)}
    assert any(d >= 1 << 63 for d in dev)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, [1e300]), (2, [-1e300])]])
def test_without_variance(spark, rows):
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_factors_compose(spark):
    """Badly conditioned rows are orthonormal after the last pass."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 4)) * [1e7, 1e3, 1, 0.05]
    rows = whitening.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base @ np.linalg.qr(rng.normal(size=(4, 4)))[0])], "vec_id long, embedding array<double>"))
    model = whitening.fitted(rows)
    assert len(model.spread) == 4 and whitening.identity_error(rows, model) < 1e-4
