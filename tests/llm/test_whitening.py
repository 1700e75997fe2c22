"""Whitening against plain eigenvalue routines and exact integers."""

import math
import os

import numpy as np
import pytest

from rubrica.llm import whitening
from tests.conftest import SMALL

SPECTRA = {
    "random": lambda rng, d: rng.random(d), "many equal": lambda rng, d: np.r_[np.ones(min(d, 7)), rng.random(max(0, d - 7)) / 2], "steep": lambda rng, d: 10.0 ** -np.arange(d),
    "one": lambda rng, d: np.r_[1.0, np.zeros(d - 1)], "ties": lambda rng, d: np.round(rng.random(d), 1), "close": lambda rng, d: 1 + 1e-9 * rng.random(d), "signs": lambda rng, d: rng.standard_normal(d),
}


@pytest.mark.parametrize("kind", SPECTRA)
def test_feast_equals_plain_routine(kind):
    rng = np.random.default_rng(1)
    for d in [1, 2, 3, 5, 9, 16, 33, 64]:
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        a = q @ np.diag(SPECTRA[kind](rng, d)) @ q.T
        want = np.linalg.eigvalsh((a + a.T) / 2)[::-1]
        want = want[want > whitening.LEAST * np.abs(a).sum(0).max()][:4]
        values, vectors = whitening.feast(a, 4)
        assert len(values) == len(want) and np.allclose(values, want, rtol=1e-11, atol=1e-13)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-12
        assert np.linalg.norm(a @ vectors - vectors * values) < 1e-12 * d


def test_inertia_counts():
    rng = np.random.default_rng(2)
    for d in range(1, 12):
        a = rng.standard_normal((d, d))
        reduced, values = whitening.tridiagonal(a + a.T), np.linalg.eigvalsh(a + a.T)
        assert all(whitening.above(reduced, s) == (values > s).sum() for s in rng.standard_normal(30) * 3)
    assert whitening.above(whitening.tridiagonal(np.diag([1.0, 1.0, 2.0])), 1.0) == 1  # a shift that is an eigenvalue


def test_intervals_hold_what_is_wanted():
    values = np.r_[np.full(6, 3.0), np.linspace(0.1, 2, 30)]
    found = whitening.intervals(whitening.tridiagonal(np.diag(values)), 1e-9, 4.0, 8)
    assert sum(n for _, _, n in found) >= 8
    assert all(((values > low) & (values <= high)).sum() == n for low, high, n in found)


def test_missed_eigenvalues_raise():
    with pytest.raises(ArithmeticError):
        whitening.inside(np.diag([1.0, 2.0, 3.0]), 1.5, 3.5, 3, 3.0, rounds=5)


def plain(rows, most=4):
    """(vec_id, component) → (n, deviation, |whitened|, explained) of whole rows, by exact integers and numpy."""
    whole = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in whole), default=0)
    whole = [(i, tuple(x + [0] * (width - len(x)))) for i, x in whole]
    fit = sorted({x for _, x in whole})
    if not fit or not width:
        return []
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array(sums) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    take = [c for c in range(width - 1, -1, -1) if values[c] > 1e-10 * np.abs(v).sum(0).max()][:most]
    return [
        (i, k, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), abs((np.array(x) - np.array(sums) / n) @ vectors[:, c]) / math.sqrt(values[c]), values[c] / np.trace(v))
        for i, x in whole for k, c in enumerate(take, 1)
    ]


def check(spark, rows, schema="vec_id long, embedding array<float>"):
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    want = plain([(r[0], r[1]) for r in rows])
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], round(r[4], 6))
    got = sorted([(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained, r.identity_error) for r in got], key=order)
    assert [r[:4] for r in got] == [r[:4] for r in sorted(want, key=order)]
    for a, b in zip(got, sorted(want, key=order), strict=True):
        assert abs(a[4] - b[4]) < 1e-8 and abs(a[5] - b[5]) < 1e-10 and a[6] < 1e-9


def test_whiten_equals_plain(spark):
    rng = np.random.default_rng(3)
    mixing = rng.standard_normal((6, 6))
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(6) @ mixing)]) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # copies count once in the fit
    check(spark, rows)


def test_whiten_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.25, 1.0], "x"), (2, None, "x"), (3, [0.1, None, 1.0], "x"), (4, [nan, 0.0, 1.0], "x"), (5, [0.0, -inf, 1.0], "x"), (None, [-0.0, 0.0, 0.0], "x"),
        (6, [2.0, 1.0], "x"), (7, [], "x"), (1, [0.5, -0.25, 1.0], "x"), (8, [-0.001, 0.001, 0.5], "x"),
    ]
    check(spark, rows, "vec_id long, embedding array<float>, x string")
    schema = "vec_id long, embedding array<float>"
    for few in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(few, schema)).count() == 0
    check(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])
    held = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0])], schema)).collect()
    assert [r.deviation for r in held] == [None, None]  # beyond a long


def test_deviations_are_exact_where_longs_are_short():
    found = whitening.Whitening(10**9, [3 * 10**9, -(10**9)], np.ones(1), np.ones((1, 2)), 1.0)
    assert found.deviations(np.array([[3, -1], [4, -1], [7, 0]])) == [0, 10**18, None]


def test_query(spark):
    got = whitening.op11_embedding_whitening(spark, SMALL)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(os.path.join(SMALL, "embeddings.parquet")).collect()]
    want = {(i, k): (n, d, w, e) for i, k, n, d, w, e in plain(rows)}
    found = got.collect()
    assert len(found) == len(want)
    for r in found:
        n, d, w, e = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, d) and abs(abs(r.whitened) - w) < 1e-8 and abs(r.explained / e - 1) < 1e-10 and r.identity_error < 1e-9
