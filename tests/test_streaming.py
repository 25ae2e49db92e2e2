"""Streams: micro-batches against the batch operators, restart, late rows, failing state reads."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trafficlens import schemas
from trafficlens.operators.ttl import ttl_dedup
from trafficlens.session import delete, list_names, shared_path
from trafficlens.streaming import flows as S

T0 = dt.datetime(2024, 1, 1)


def _requests(spark, rows):
    df = spark.createDataFrame(rows, "request_id long, user_id long, ts timestamp")
    have = {"request_id", "user_id", "ts"}
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in schemas.REQUESTS])


def _rows(n, seed=1):
    rnd = random.Random(seed)
    return [(i, 1 if i % 5 else rnd.randint(2, 50), T0 + dt.timedelta(seconds=rnd.randint(0, 40_000))) for i in range(n)]


def _staged(spark, df, files):
    path = shared_path(spark, "stream-test")
    n = S.stage_in_time_order(df, path, least_files=files)
    assert n == files
    return path


def _tuples(df):
    return {r["request_id"]: (r["hit"], r["entry_created_at"]) for r in df.collect()}


def test_dedup_equals_batch_with_large_groups(spark):
    """Over 10,000 rows of one key in a micro-batch, and small Arrow batches."""
    df = _requests(spark, _rows(30_000))
    stream = S.read_requests_stream(spark, _staged(spark, df, 8), max_files_per_trigger=4)
    out, state, ck = (shared_path(spark, x) for x in ("out", "state", "ck"))
    S.ttl_dedup_stream(stream, "user_id", 600, out, state, ck).awaitTermination()
    assert _tuples(spark.read.parquet(out)) == _tuples(ttl_dedup(df, "user_id", ttl_seconds=600))


def test_dedup_restarts_from_its_checkpoint(spark):
    rows = sorted(_rows(400, seed=3), key=lambda r: r[2])
    path = shared_path(spark, "restart")
    out, state, ck = (shared_path(spark, x) for x in ("out", "state", "ck"))
    for part in (rows[:150], rows[150:300], rows[300:]):
        _requests(spark, part).coalesce(1).write.mode("append").parquet(path)
        S.ttl_dedup_stream(S.read_requests_stream(spark, path), "user_id", 600, out, state, ck).awaitTermination()
    assert _tuples(spark.read.parquet(out)) == _tuples(ttl_dedup(_requests(spark, rows), "user_id", ttl_seconds=600))


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def _micros(seconds):
    return int((_at(seconds) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def test_late_rows_are_never_answered_from_the_future(spark):
    """A request older than its key's entry opens one of its own, which ends where the known one begins."""
    entries = spark.createDataFrame([(1, _micros(100), _micros(160))], "user_id long, start long, stop long")
    batch = spark.createDataFrame([(1, 1, _at(0)), (2, 1, _at(150)), (3, 1, _at(100)), (4, 1, _at(161)), (5, 1, _at(50)),
                                   (6, 1, _at(70)), (7, 1, _at(99)), (8, 2, _at(5))], "request_id long, user_id long, ts timestamp")
    got = S.dedup_batch(batch, entries, "user_id", 60)
    assert _tuples(got) == {1: (False, _at(0)), 5: (True, _at(0)), 6: (False, _at(70)), 7: (True, _at(70)), 3: (True, _at(100)),
                            2: (True, _at(100)), 4: (False, _at(161)), 8: (False, _at(5))}
    live = S.live_entries(entries, got, "user_id", 60, _micros(100))
    assert {(r["user_id"], r["start"], r["stop"]) for r in live.collect()} == {
        (1, _micros(70), _micros(100) - 1), (1, _micros(100), _micros(160)), (1, _micros(161), _micros(221))}
    again = S.dedup_batch(spark.createDataFrame([(9, 1, _at(99)), (10, 1, _at(120)), (11, 1, _at(69))],
                                                "request_id long, user_id long, ts timestamp"), live, "user_id", 60)
    assert _tuples(again) == {9: (True, _at(70)), 10: (True, _at(100)), 11: (False, _at(69))}


def test_state_holds_live_entries_only(spark):
    """Keys that were seen long ago leave the state; rows behind the watermark are set aside; a restart goes on."""
    path = shared_path(spark, "evict")
    out, state, ck = (shared_path(spark, x) for x in ("out", "state", "ck"))
    parts = [[(i, i, _at(i)) for i in range(200)], [(1000 + i, 5000 + i, _at(10_000 + i)) for i in range(30)],
             [(2000, 3, _at(4)), (2001, 9000, _at(10_050)), (2002, 5000, _at(9_900)), (2003, None, _at(10_060))]]
    sizes = []
    for k, part in enumerate(parts):
        _requests(spark, part).coalesce(1).write.mode("append").parquet(path)
        S.ttl_dedup_stream(S.read_requests_stream(spark, path), "user_id", 600, out, state, ck,
                           lateness_seconds=300).awaitTermination()
        version = max(int(n[2:]) for n in list_names(spark, state) if n.startswith("v="))
        sizes.append(spark.read.parquet(f"{state}/v={version}/entries").count())
    assert sizes == [200, 30, 32]
    got = _tuples(spark.read.parquet(out))
    assert 2000 not in got and got[2002] == (False, _at(9_900)) and got[2001] == (False, _at(10_050)) and 2003 not in got
    late = [r["request_id"] for n in list_names(spark, f"{out}/_late") for r in spark.read.parquet(f"{out}/_late/{n}").collect()]
    assert late == [2000]


def test_scratch_tables_are_removed(spark):
    base = shared_path(spark, "x").rsplit("/", 1)[0]
    left = lambda: {n for n in list_names(spark, base) if n.startswith(("tl-jump", "tl-reached"))}
    before = left()
    ttl_dedup(_requests(spark, _rows(500)), "user_id", ttl_seconds=60).count()
    assert left() == before


def test_missing_state_is_an_error(spark):
    root = shared_path(spark, "state")
    assert S._previous(spark, root, 0) is None
    with pytest.raises(FileNotFoundError):
        S._previous(spark, root, 1)
    spark.range(1).write.parquet(f"{root}/v=0")
    assert S._previous(spark, root, 1) == f"{root}/v=0"
    delete(spark, f"{root}/v=0")
    with pytest.raises(FileNotFoundError):
        S._previous(spark, root, 1)


def test_window_drops_rows_behind_the_watermark(spark):
    path = shared_path(spark, "late")
    out, ck = shared_path(spark, "out"), shared_path(spark, "ck")
    day = dt.timedelta(days=1)
    for part in ([(1, 1, T0), (2, 1, T0 + 5 * day)], [(3, 1, T0 + 6 * day)], [(4, 1, T0 + dt.timedelta(hours=1))]):
        _requests(spark, part).coalesce(1).write.mode("append").parquet(path)
        stream = S.read_requests_stream(spark, path).select(
            "ts", "latency_ms", F.lit("d").alias("dependency"), F.lit("/x").alias("endpoint_path"))
        S.write_updates(S.traffic_kpis_stream(stream), out, ck).awaitTermination()
    got = {r["window_start"]: r["requests"] for r in S.latest_updates(spark, out, ["window_start", "dependency"]).collect()}
    assert got == {T0: 1, T0 + 5 * day: 1, T0 + 6 * day: 1}
