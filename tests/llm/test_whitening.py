import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from trafficlens.llm import whitening as w

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int"


def _kept(rows, dim):
    return [(r[0], tuple(math.floor(256 * c) for c in r[1])) for r in rows
            if r[1] is not None and len(r[1]) == dim and all(c is not None and math.isfinite(c) for c in r[1])]


def _brute(kept, k=4):
    """n, deviation by vector, centred rows as exact fractions turned to doubles, and their SVD."""
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = [Fraction(s, n) for s in sums]
    rows = np.array([[float(c - m) for c, m in zip(x, mean)] for x in fit])
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    values = s ** 2 / n
    return n, sums, mean, values, vt[:min(k, int((s > s.max() * 1e-11).sum()))]


def _check(got, kept, tight=1e-9):
    n, sums, mean, values, vt = _brute(kept)
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-4
    assert sorted(by) == list(range(1, len(vt) + 1))
    for c, rows in by.items():
        axis, e = vt[c - 1], values[c - 1]
        assert rows[0]["explained"] == pytest.approx(e / values.sum(), rel=1e-8)
        want = sorted((repr(i), sum((n * v - s) ** 2 for v, s in zip(x, sums)),
                       sum(float(v - m) * a for v, m, a in zip(x, mean, axis)) / math.sqrt(e)) for i, x in kept)
        have = sorted((repr(r["vec_id"]), r["deviation"], r["whitened"]) for r in rows)
        if sum(a[2] * b[2] for a, b in zip(have, want)) < 0:
            have = sorted((i, d, -x) for i, d, x in have)
        assert [(i, d if d < 1 << 63 else None) for i, d, _ in want] == [(i, d) for i, d, _ in have]
        assert np.allclose([x for *_, x in have], [x for *_, x in want], rtol=tight, atol=tight)


def test_query_against_svd(spark):
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{SF01}/embeddings.parquet").select("vec_id", "embedding").collect()]
    _check(w.op13_whitening(spark, SF01).collect(), _kept(rows, 64))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, 3, 6)], 1) for i in range(200)]
    rows += [rows[0], rows[0], (None, rows[1][1], None), (7, None, 1), (8, [], 1), (9, [1.0] * 5 + [None], 1),
             (10, [1.0] * 5 + [NAN], 1), (11, [INF] * 6, 1), (12, [1.0] * 5, 1), (13, [-0.0] * 6, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("component", "n", "whitened", "x", "cell"):
        df = df.withColumn(c, F.lit("mine"))
    _check(w.whiten(df).collect(), _kept(rows, 6))


@pytest.mark.parametrize("kind", ["spread", "offset", "deficient", "narrow", "pair"])
def test_hard_matrices(spark, kind):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (300, 5))
    x = {"spread": base * [1e9, 1e6, 1e4, 300, 1], "offset": base * [4, 3, 2, 1, 1] + 1e9,
         "deficient": np.repeat((base[:, :2] * 400).round(), 3, axis=1), "narrow": base[:, :2] * [5, 1],
         "pair": base[:2]}[kind]
    rows = [(i, [float(c) for c in r], 0) for i, r in enumerate(x)]
    got = w.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    _check(got, _kept(rows, x.shape[1]), 1e-6)


def test_passes_make_the_rows_orthogonal(spark):
    """A condition number of 1e10: its Gram matrix has no Cholesky factor, the shifted passes have."""
    rng = np.random.default_rng(6)
    u, _ = np.linalg.qr(rng.normal(0, 1, (400, 6)))
    v, _ = np.linalg.qr(rng.normal(0, 1, (6, 6)))
    x = (u * np.logspace(12, 2, 6)) @ v.T
    fitted = w.FitList(spark.createDataFrame([(i, [float(c) for c in r], 0) for i, r in enumerate(x)], SCHEMA), 6)
    scale, factors = 2.0 ** 40, []
    for turn in range(3):
        factors.append(w._factor(fitted.gram(factors, scale), 400, turn == 0))
    assert np.abs(fitted.gram(factors, scale) - np.eye(6)).max() < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 2)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]])
def test_nothing_to_whiten(spark, rows):
    got = w.whiten(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 0
