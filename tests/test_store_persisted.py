"""The stored response table: upsert, purge and reread; lookups never answer from the future."""
import datetime as dt

from pyspark.sql import functions as F

from trafficlens.operators import store as S
from trafficlens.session import list_names, shared_path

T0 = dt.datetime(2024, 1, 1)


def _rows(spark, rows):
    df = spark.createDataFrame(rows, "key_hash string, dependency string, response_body string, created_at timestamp")
    return df.select("key_hash", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("method", "string"), ("path", "string"), ("query", "string"), ("request_body_hash", "string"),
        ("response_status", "int"), ("response_headers", "string"))], "response_body", "dependency", "created_at")


def _state(spark, path):
    return {r["key_hash"]: (r["dependency"], r["response_body"]) for r in S.read_store(spark, path).collect()}


def _files(spark, path):
    return {n: list_names(spark, f"{path}/{n}") for n in list_names(spark, path)}


def test_upsert_and_purge_on_disk(spark):
    path = shared_path(spark, "store-test")
    hour = dt.timedelta(hours=1)
    S.upsert_persisted(spark, path, _rows(spark, [("k1", "a b/c=1%", "x", T0), ("k2", "d2", "y", T0), ("k3", "d3", "z", T0)]), 3600)
    before = _files(spark, path)
    S.upsert_persisted(spark, path, _rows(spark, [("k2", "d2", "y2", T0 + hour), ("k4", "d4", "w", T0 + hour),
                                                  ("k1", "d2", "moved", T0 + hour)]), 3600)
    assert _state(spark, path) == {"k1": ("d2", "moved"), "k2": ("d2", "y2"), "k3": ("d3", "z"), "k4": ("d4", "w")}
    assert _files(spark, path)["dependency=d3"] == before["dependency=d3"]  # untouched
    assert S.purge_persisted(spark, path, dependency="d2") == 2
    assert _state(spark, path) == {"k3": ("d3", "z"), "k4": ("d4", "w")}
    assert not any("d2" in n or n.startswith("_") for n in list_names(spark, path))
    assert S.purge_persisted(spark, path, expired_before="2024-01-01 01:30:00") == 1
    assert _state(spark, path) == {"k4": ("d4", "w")}
    assert S.purge_persisted(spark, path, dependency="nothing") == 0
    assert S.purge_persisted(spark, path) == 1 and _state(spark, path) == {}


def test_lookup_never_answers_from_the_future(spark):
    s = S.upsert_responses(None, _rows(spark, [("k", "d", "x", T0 + dt.timedelta(hours=1))]), 86400)
    req = spark.createDataFrame([(1, "k", T0), (2, "k", T0 + dt.timedelta(hours=1)), (3, "k", T0 + dt.timedelta(days=3))],
                                "request_id long, request_key string, ts timestamp")
    assert {r["request_id"]: r["hit"] for r in S.lookup_responses(req, s).collect()} == {1: False, 2: True, 3: False}


def test_one_key_rewrites_one_bucket(spark):
    """The plan reads one bucket of all, and only its files change."""
    path = shared_path(spark, "store-test")
    S.upsert_persisted(spark, path, _rows(spark, [(f"k{i}", f"d{i % 2}", "x", T0) for i in range(300)]), 3600, buckets=8)
    assert S.stored_buckets(spark, path) == 8

    def files():
        return {(d, b): tuple(list_names(spark, f"{path}/{d}/{b}")) for d in list_names(spark, path) if d.startswith("dep")
                for b in list_names(spark, f"{path}/{d}")}

    before = files()
    one = _rows(spark, [("k7", "d1", "new", T0 + dt.timedelta(hours=1))])
    read = S.touched_rows(spark, path, one, 8)
    filters = read._jdf.queryExecution().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "bucket" in filters and "dependency" in filters
    assert read.select("dependency", "bucket").distinct().count() == 1
    S.upsert_persisted(spark, path, one, 3600, buckets=99)
    after = files()
    assert set(after) == set(before) and sum(after[k] != before[k] for k in before) == 1
    assert _state(spark, path)["k7"] == ("d1", "new") and len(_state(spark, path)) == 300
    # a key that moves to another dependency changes two partitions of its bucket
    S.upsert_persisted(spark, path, _rows(spark, [("k7", "d0", "moved", T0 + dt.timedelta(hours=2))]), 3600)
    assert sum(files()[k] != after[k] for k in after) == 2 and len(_state(spark, path)) == 300


def test_many_dependencies_share_folders(spark, monkeypatch):
    monkeypatch.setattr(S, "FOLDERS", 10)
    monkeypatch.setattr(S, "PARTITION_ROWS", 40)
    path, hour = shared_path(spark, "store-test"), dt.timedelta(hours=1)
    S.upsert_persisted(spark, path, _rows(spark, [(f"k{i}", f"d{i % 50}" if i else None, "x", T0) for i in range(100)]), 3600)
    folders = [n for n in list_names(spark, path) if "=" in n]
    assert S.stored_groups(spark, path) == 3 and len(folders) <= 3  # one for each dependency before
    want = {f"k{i}": (f"d{i % 50}" if i else None, "x") for i in range(100)}
    assert _state(spark, path) == want
    one = _rows(spark, [("k7", "d7", "new", T0 + hour), ("k8", "d9", "moved", T0 + hour), ("k0", "d1", "named", T0 + hour)])
    read = S.touched_rows(spark, path, one.where("key_hash = 'k7'"), S.stored_buckets(spark, path))
    assert read.select("group", "bucket").distinct().count() == 1
    S.upsert_persisted(spark, path, one, 3600)
    want |= {"k7": ("d7", "new"), "k8": ("d9", "moved"), "k0": ("d1", "named")}
    assert _state(spark, path) == want
    assert S.purge_persisted(spark, path, dependency="d9") == 3
    want = {k: v for k, v in want.items() if v[0] != "d9"}
    assert _state(spark, path) == want
    assert S.purge_persisted(spark, path, expired_before="2024-01-01 01:30:00") == len(want) - 2
    assert set(_state(spark, path)) == {"k7", "k0"}
    assert S.purge_persisted(spark, path) == 2 and _state(spark, path) == {}
