"""Keys, query parsing, expiry and the response store."""
import datetime as dt

from pyspark.sql import functions as F

from trafficlens.functions import keys as K
from trafficlens.functions.paths import params_to_string
from trafficlens.operators import store as S


def test_query_to_map(spark):
    df = spark.createDataFrame([("a=1&b=2&b=3",), ("tag=a%20b&tag=c&x=1+2",), ("",), ("bad=%zz&ok=1",)], "q string")
    got = [r[0] for r in df.select(params_to_string(K.query_to_map("q"))).collect()]
    assert got == ["a=1&b=2,3", "tag=a b,c&x=1 2", "", "ok=1"]


def test_key_and_body_hash(spark):
    df = spark.createDataFrame([("GET", "/a", "", ""), ("POST", "/a", "", ""), ("GET", "/a", "x=1", "")],
                               "m string, p string, q string, b string")
    rows = df.select(K.hash_body("b").alias("bh"), K.request_key("m", "p", "q", K.hash_body("b")).alias("k")).collect()
    assert rows[0]["bh"] == ""
    assert all(len(r["k"]) == 64 for r in rows)
    assert len({r["k"] for r in rows}) == 3


def test_is_live_and_stamp(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, None), (t, t), (t, t - dt.timedelta(seconds=1))], "now timestamp, exp timestamp")
    assert [r[0] for r in df.select(K.is_live("exp", "now")).collect()] == [True, True, False]
    st = spark.createDataFrame([(t,)], "c timestamp").select(
        K.stamp_expiry(F.col("c"), F.lit(None).cast("timestamp"), 10).alias("e"),
        K.stamp_expiry(F.col("c"), F.lit(None).cast("timestamp"), 0).alias("never")).first()
    assert st["e"] == t + dt.timedelta(seconds=10) and st["never"] is None


def _rows(spark, rows):
    return spark.createDataFrame(rows, "key_hash string, method string, path string, query string, "
                                       "request_body_hash string, response_status int, response_headers string, "
                                       "response_body string, dependency string, created_at timestamp")


def test_store_upsert_stats_purge(spark):
    t = dt.datetime(2024, 1, 1)
    a = _rows(spark, [("k1", "GET", "/a", "", "", 200, "{}", "hello", "dep-a", t),
                      ("k2", "GET", "/b", "", "", 200, "{}", "x", "dep-a", t),
                      ("k3", "GET", "/c", "", "", 200, "{}", "y", "dep-a", t),
                      ("k4", "GET", "/d", "", "", 200, "{}", "z", "dep-b", t)])
    s1 = S.upsert_responses(None, a, ttl_seconds=60, batch_id=1)
    later = _rows(spark, [("k1", "GET", "/a", "", "", 201, "{}", "second", "dep-a", t + dt.timedelta(seconds=1))])
    s2 = S.upsert_responses(s1, later, ttl_seconds=60, batch_id=2)
    assert s2.where("key_hash = 'k1'").select("response_body").first()[0] == "second"
    assert s2.count() == 4
    one = S.store_stats(S.upsert_responses(None, a.limit(1), ttl_seconds=0)).first()
    assert (one["total_entries"], one["total_size"]) == (1, 5)
    remaining, deleted = S.purge(s2, dependency="dep-a")
    assert deleted.first()[0] == 3 and remaining.count() == 1
    req = spark.createDataFrame([("k1", t + dt.timedelta(seconds=30)), ("k1", t + dt.timedelta(seconds=120)),
                                 ("zz", t)], "request_key string, ts timestamp")
    hits = [r["hit"] for r in S.lookup_responses(req, s2).orderBy("ts", "request_key").collect()]
    assert sorted(hits) == [False, False, True]
