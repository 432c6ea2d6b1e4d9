"""Whitening against a dense solver."""

import math

import numpy as np
import pytest
from geomill.llm import whitening
from geomill.llm.queries import table


def _dense(vectors):
    x = np.array([[math.floor(1024 * float(c)) for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    scaled = n * x - sums
    c = (scaled / n).astype(float)
    cov = c.T @ c / n
    values, axes = np.linalg.eigh(cov)
    return [int((row**2).sum()) for row in scaled], c, values[::-1], axes[:, ::-1], np.trace(cov)


def _check(rows, kept, components=8, rank=None):
    """`rows`: results; `kept`: {id: vector} of the remaining rows, one each."""
    ids = sorted(kept)
    deviations, c, values, axes, trace = _dense([kept[i] for i in ids])
    k = min(components, len(values)) if rank is None else rank
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(by) == len(rows) == len(ids) * k
    for j in range(k):
        got = np.array([by[i, j + 1].whitened for i in ids])
        want = c @ axes[:, j] / math.sqrt(values[j])
        assert min(abs(got - want).max(), abs(got + want).max()) < 1e-6
        assert all(abs(by[i, j + 1].explained / (values[j] / trace) - 1) < 1e-9 for i in ids)
    for i, d in zip(ids, deviations, strict=True):
        assert all(by[i, j + 1].deviation == d and by[i, j + 1].n == len(ids) for j in range(k))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_given_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    kept = {r.vec_id: r.embedding for r in df.collect()}
    _check(whitening.whiten(df).collect(), kept)


def test_bad_vectors_and_own_columns(spark):
    draw = np.random.default_rng(3)
    good = {i: draw.standard_normal(12).tolist() for i in range(150)}
    bad = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [-float("inf")] + [0.0] * 11)]
    rows = [(i, v, "own", 1.5) for i, v in [*good.items(), *bad]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, whitened double").repartition(5)
    _check(whitening.whiten(df).collect(), good)


def test_low_rank_and_repeated_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [2.0, 4.0, 6.0]), (2, [4.0, 8.0, 12.0])], "vec_id long, embedding array<float>")
    _check(whitening.whiten(df).collect(), {0: [1, 2, 3], 1: [2, 4, 6], 2: [4, 8, 12]}, rank=1)
    twice = whitening.whiten(df.union(df).union(df.selectExpr("null", "embedding"))).collect()
    assert len(twice) == 9 and all(r.n == 9 for r in twice) and sum(r.vec_id is None for r in twice) == 3


def test_equal_values_of_components(spark):
    rows = [(2 * k + s, [0.0] * k + [1.0 - 2 * s] + [0.0] * (9 - k)) for k in range(10) for s in (0, 1)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 20 * 8 and all(abs(r.explained - 0.1) < 1e-12 and r.identity_error < 1e-12 for r in out)


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[3.0], [3.0], [3.0]], [[], []]])
def test_no_variance(spark, vectors):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    assert whitening.whiten(df).collect() == []


def test_uneven_lengths_and_great_entries(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0, 5.0]), (2, [4.0, -2.0]), (3, [])], "vec_id long, embedding array<double>")
    _check(whitening.whiten(df).collect(), {0: [1, 0], 1: [1, 5], 2: [4, -2], 3: [0, 0]})
    great = whitening.whiten(spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e12, 1.0]), (2, [5.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert great and all(r.deviation is None and r.identity_error < 1e-6 for r in great)


def test_exact_beyond_64_bits_between():
    centre = whitening.Centre(3, 1 << 61, [0, 0])
    x = np.array([[5, 7], [1 << 29, 0], [1 << 61, 1]], np.int64)
    assert centre.deviations(x) == [9 * 74, 9 << 58, None] and not centre.fits


def test_solver_without_data():
    draw = np.random.default_rng(8)
    for width, decay in ((3, 1.0), (60, 1.0), (200, 0.97)):
        q = np.linalg.qr(draw.standard_normal((width, width)))[0]
        wanted = 1000 * decay ** np.arange(width) + draw.random(width)
        a = (q * wanted) @ q.T
        values, vectors = whitening.jacobi_davidson(lambda z, a=a: a @ z, width, 8)
        top = np.sort(wanted)[::-1][: min(8, width)]
        assert abs(values - top).max() < 1e-11 * top[0] and np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-12 * top[0]


def test_inner_solver():
    draw = np.random.default_rng(9)
    a = draw.standard_normal((30, 30))
    a, rhs = a + a.T, draw.standard_normal((30, 4))
    assert abs(a @ whitening.minres(lambda z: a @ z, rhs, 60, 1e-13) - rhs).max() < 1e-8
