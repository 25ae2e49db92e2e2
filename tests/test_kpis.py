"""Exact percentiles without a buffer of the group's values."""
import random

import numpy as np

from trafficlens.operators import kpis
from trafficlens.operators.kpis import exact_percentiles


def test_exact_percentiles(spark):
    rnd = random.Random(4)
    rows = [("big", round(rnd.lognormvariate(3, 2), 3)) for _ in range(60_000)]
    rows += [("ties", float(rnd.randint(0, 3))) for _ in range(2000)] + [("one", 5.0), ("two", 1.0), ("two", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: (r["p0"], r["p1"], r["p2"]) for r in exact_percentiles(df, ["k"], "v", [0.5, 0.95, 1.0]).collect()}
    for k in ("big", "ties", "one", "two"):
        want = np.quantile([v for g, v in rows if g == k], [0.5, 0.95, 1.0])
        assert np.allclose(got[k], want, rtol=1e-12), k
    assert "none" not in got


def test_small_and_large_groups_agree(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(k, h, round(rnd.expovariate(0.1), 2)) for k in ("a", "b", None) for h in (True, False, None)
            for _ in range(rnd.randint(50, 900))]
    df = spark.createDataFrame(rows, "k string, h boolean, v double").repartition(5).checkpoint()

    def run(small):
        monkeypatch.setattr(kpis, "SMALL", small)
        monkeypatch.setattr(kpis, "MARGIN", 0.1)  # some ranks of these groups, as the usual one is of large ones
        out = exact_percentiles(df, ["k", "h"], "v", [0.0, 0.5, 0.95])
        assert out.columns == ["k", "h", "p0", "p1", "p2"]
        return {(r["k"], r["h"]): tuple(r)[2:] for r in out.collect()}

    want = {(k, h): np.quantile([v for a, b, v in rows if (a, b) == (k, h)], [0.0, 0.5, 0.95])
            for k in ("a", "b", None) for h in (True, False, None)}
    for small in (100_000, 400, 0):  # all small, some of each, all large
        got = run(small)
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], rtol=1e-12) for k in want), small


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert exact_percentiles(df, ["k"], "v", [0.5]).collect() == []
