"""Whitening against exact fractions."""

from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from fathomline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def exact(rows):
    """Distinct x vectors, their sums and their covariance as fractions."""
    x = {tuple(int(np.floor(64 * float(np.float32(v)))) + 1_000_000 for v in e) for _, e in rows}
    fit = np.array(sorted(x), object)
    n, s = len(fit), fit.sum(0)
    z = n * fit - s
    return fit, n, s, [[Fraction(int(v), n**3) for v in r] for r in z.T @ z]


def rows_of(n, size=6, seed=0):
    r = np.random.default_rng(seed)
    mix = r.normal(0, 1, (size, size))
    return [(i, (r.normal(0, 2, size) @ mix).tolist()) for i in range(n)]


def test_covariance_keeps_what_doubles_lose(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 16)
    rows = rows_of(300)
    fit, n, s, v = exact(rows)
    x, size = whitening.integers(spark.createDataFrame(rows, SCHEMA).repartition(9))
    distinct = x.select("x").distinct().repartition(9)
    model = whitening.Whitening(*whitening.sums(distinct, size))
    assert (model.n, model.total) == (n, [int(t) for t in s])
    got = whitening.covariance(distinct, size, model.mean)
    worst = max(abs(Fraction(h) + Fraction(low) - w) / abs(w) for hs, ls, ws in zip(got.high.tolist(), got.low.tolist(), v, strict=True) for h, low, w in zip(hs, ls, ws, strict=True))
    assert worst < Fraction(1, 10**19)


def test_error_free_parts():
    r = np.random.default_rng(2)
    a, b = r.normal(0, 1, 50), r.normal(0, 1e-9, 50)
    s, e = whitening.two_sum(a, b)
    assert all(Fraction(x) + Fraction(y) == Fraction(t) + Fraction(u) for x, y, t, u in zip(a, b, s, e, strict=True))
    high = r.normal(0, 1, (64, 3)) * [1.0, 1e6, 1e-8]
    cuts = whitening.slices_of(high, np.zeros_like(high))
    assert (np.abs(sum(cuts) - high) <= np.abs(high).max(0) * 2.0**-53).all()
    product = cuts[0].T @ cuts[1]
    want = [[sum(Fraction(cuts[0][k, i]) * Fraction(cuts[1][k, j]) for k in range(64)) for j in range(3)] for i in range(3)]
    assert all(Fraction(product[i, j]) == want[i][j] for i in range(3) for j in range(3))


def test_rows_are_white_and_exact(spark):
    rows = rows_of(200, 20)
    rows += rows[:30] + [(500, rows[3][1])]
    odd = [(600, None), (601, [1.0] * 19 + [None]), (602, [float("nan")] * 20), (603, [float("-inf")] + [0.0] * 19), (None, [0.0] * 20), (604, [1.0, 2.0]), (605, [])]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumns({c: F.lit("clash") for c in ("x", "n", "component", "high", "task", "size", "count")})
    out = whitening.digest(df).toPandas().sort_values(["vec_id", "component"], kind="stable")
    fit, n, s, v = exact(rows)
    assert len(out) == len(rows) * 16 and (out.n == n).all() and out.identity_error.max() < 1e-10
    vf = np.array([[float(a) for a in r] for r in v])
    values, vectors = np.linalg.eigh(vf)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    one = out[~out.duplicated(["vec_id", "component"])]
    assert np.allclose(one.explained.to_numpy().reshape(-1, 16), values / vf.trace(), rtol=1e-10)
    ids = one.vec_id.to_numpy().reshape(-1, 16)[:, 0]
    by = dict(rows)
    y = np.array([[float(Fraction(int(np.floor(64 * float(np.float32(c)))) + 1_000_000) - Fraction(int(t), n)) for c, t in zip(by[i], s, strict=True)] for i in ids])
    want = y @ vectors / np.sqrt(values)
    got = one.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-8
    for i, d in zip(one.vec_id, one.deviation, strict=True):
        assert d == sum((n * (int(np.floor(64 * float(np.float32(c)))) + 1_000_000) - int(t)) ** 2 for c, t in zip(by[i], s, strict=True))


def test_deviation_ends_at_a_long():
    x = np.array([[1 << 40, 0], [0, 0]])
    got = whitening.deviations(x, 1 << 30, [0, 0])
    assert got.tolist() == [(1 << 63) - 1, 0]


def test_little_to_whiten(spark):
    make = lambda rows: whitening.digest(spark.createDataFrame(rows, SCHEMA))
    assert make([]).count() == 0
    assert make([(1, None)]).count() == 0
    assert make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0  # nothing spreads
    line = make([(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]).toPandas()
    assert set(line.component) == {1} and np.allclose(line.explained, 1.0)  # one direction is all there is
    assert make([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [-1e30, 3.0])]).count() > 0
