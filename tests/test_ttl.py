"""TTL dedup: fixture case, hot key against brute force, both forms, sf0.01 count."""
import datetime as dt
import random

import pytest

from trafficlens.operators.ttl import ttl_dedup

T0 = dt.datetime(2024, 1, 1)


def _brute(rows, ttl):
    out, start = {}, {}
    for rid, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        s = start.get(k)
        if s is None or (ttl and (t - s).total_seconds() > ttl):
            start[k] = t
            out[rid] = (False, t)
        else:
            out[rid] = (True, s)
    return out


@pytest.mark.parametrize("strategy", ["fold", "jump"])
def test_fixture_case(spark, strategy):
    rows = [(i, "k", T0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 5, 10, 11, 25])]
    df = spark.createDataFrame(rows, "request_id long, key string, ts timestamp")
    got = [r["hit"] for r in ttl_dedup(df, "key", ttl_seconds=10, strategy=strategy).orderBy("request_id").collect()]
    assert got == [False, True, True, False, False]


@pytest.mark.parametrize("strategy", ["fold", "jump"])
def test_hot_key_against_brute_force(spark, strategy):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        k = "hot" if i % 3 else f"k{rnd.randint(0, 20)}"
        rows.append((i, k, T0 + dt.timedelta(seconds=rnd.randint(0, 20000), microseconds=rnd.randint(0, 3) * 1000)))
    df = spark.createDataFrame(rows, "request_id long, key string, ts timestamp")
    want = _brute(rows, 37)
    got = {r["request_id"]: (r["hit"], r["entry_created_at"]) for r in
           ttl_dedup(df, "key", ttl_seconds=37, strategy=strategy).collect()}
    assert got == want


def test_never_expires(spark):
    rows = [(i, "k", T0 + dt.timedelta(days=i)) for i in range(4)]
    df = spark.createDataFrame(rows, "request_id long, key string, ts timestamp")
    for strategy in ("fold", "jump"):
        hits = [r["hit"] for r in ttl_dedup(df, "key", ttl_seconds=None, strategy=strategy)
                .orderBy("request_id").collect()]
        assert hits == [False, True, True, True]


def test_sf001_user_hits(spark):
    from conftest import SF01
    from trafficlens.sources import derived as D
    r = ttl_dedup(D.requests(spark, SF01), "user_id", ttl_seconds=6 * 3600)
    assert r.where("hit").count() == 3556
