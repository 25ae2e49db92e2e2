"""Registered queries: streaming runs (availableNow) read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.functions.paths import params_to_string
from trafficlens.operators import match as M
from trafficlens.operators.serve import with_keys
from trafficlens.plans import oracle_sql as O
from trafficlens.plans.catalog import ORACLE, register
from trafficlens.plans.q_store import DEDUP_TTL, STORE_TTL, _store_rows, body_hash_sql, key_sql
from trafficlens.session import shared_path
from trafficlens.sources import derived as D
from trafficlens.streaming import flows as S


def _staged(spark, sf_dir):
    """The requests as a file stream, in micro-batches of a quarter of the files."""
    path = shared_path(spark, "requests-stream")
    files = S.stage_in_time_order(D.requests(spark, sf_dir), path)
    return S.read_requests_stream(spark, path, max_files_per_trigger=-(-files // 4))


def _routes(spark):
    ep, deps = D.fixture_registry(spark)
    return M.prepare_routes(ep, deps)


@register("match_stream", ORACLE["match_requests"])
def q_match_stream(spark, sf_dir):
    """Matching as a stream (four time-ordered micro-batches)."""
    out, ck = shared_path(spark, "t1-out"), shared_path(spark, "t1-ck")
    q = S.match_stream(_staged(spark, sf_dir), _routes(spark), out, ck)
    q.awaitTermination()
    m = spark.read.parquet(out)
    return m.select("request_id", "method", "path", "dependency", "endpoint_method", "endpoint_path",
                    "status_code", params_to_string("path_params").alias("path_params"))


@register("ttl_dedup_stream", ORACLE["ttl_dedup_users"])
def q_ttl_dedup_stream(spark, sf_dir):
    """Keyed TTL state (key = user_id, ttl = 6 h); equals the batch W1."""
    out, state, ck = (shared_path(spark, f"t2-{x}") for x in ("out", "state", "ck"))
    S.ttl_dedup_stream(_staged(spark, sf_dir), "user_id", DEDUP_TTL, out, state, ck).awaitTermination()
    r = spark.read.parquet(out)
    return r.select("request_id", "user_id", "hit",
                    F.col("entry_created_at").cast("timestamp_ntz").alias("entry_created_at"))


@register("traffic_kpis_stream", f"""
WITH {O.match_cte()}
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, dependency,
  CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (WHERE endpoint_path IS NULL) AS BIGINT) AS unmatched,
  max(latency_ms) AS max_latency_ms, round(sum(latency_ms), 6) AS sum_latency_ms
FROM matched GROUP BY ALL""")
def q_traffic_kpis_stream(spark, sf_dir):
    """Daily windows x dependency with a watermark (update mode, final value per window)."""
    out, ck = shared_path(spark, "t3-out"), shared_path(spark, "t3-ck")
    matched = M.match_requests(_staged(spark, sf_dir), _routes(spark), strategy="auto")
    q = S.write_updates(S.traffic_kpis_stream(matched), out, ck)
    q.awaitTermination()
    r = S.latest_updates(spark, out, ["window_start", "dependency"])
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "dependency", "requests",
                    "unmatched", "max_latency_ms", F.round("sum_latency_ms", 6).alias("sum_latency_ms"))


@register("traffic_windows_final", f"""
WITH {O.match_cte()},
last AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM matched),
d AS (SELECT date_trunc('day', ts) AS window_start, dependency, * EXCLUDE (dependency) FROM matched, last
      WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark),
k AS (SELECT CAST(window_start AS TIMESTAMP) AS window_start, dependency, count(*) AS requests,
  count(*) FILTER (endpoint_path IS NULL) AS unmatched, max(latency_ms) AS max_latency_ms,
  round(sum(latency_ms), 6) AS sum_latency_ms FROM d GROUP BY ALL)
SELECT *, true AS p50_holds, true AS p95_holds FROM k""")
def q_traffic_windows_final(spark, sf_dir):
    """T3 in append mode: hourly windows written once, when final, then added up to days by merging their sketches;
    p50 and p95 hold if the day's own ranks lie within 1 % of them."""
    out, ck = shared_path(spark, "t3-final"), shared_path(spark, "t3-final-ck")
    matched = M.match_requests(_staged(spark, sf_dir), _routes(spark), strategy="array")
    S.write_final(S.final_windows(matched), out, ck).awaitTermination()
    days = S.merge_windows(spark.read.parquet(out))
    # each day's share of requests below and up to the two values, from the requests themselves
    own = M.match_requests(D.requests(spark, sf_dir), _routes(spark)).withColumn("window_start", F.date_trunc("day", "ts"))
    final = spark.read.parquet(out).select(F.col("window_start").alias("_hour"), F.col("dependency").alias("_dep")).distinct()
    own = own.join(final, (F.date_trunc("hour", own["ts"]) == F.col("_hour")) & own["dependency"].eqNullSafe(F.col("_dep")), "left_semi")
    d = days.alias("d")
    j = own.alias("o").join(d, (F.col("o.window_start") == F.col("d.window_start"))
                            & F.col("o.dependency").eqNullSafe(F.col("d.dependency")))

    def holds(q, col):
        below = F.avg((F.col("latency_ms") < F.col(f"d.{col}")).cast("double"))
        upto = F.avg((F.col("latency_ms") <= F.col(f"d.{col}")).cast("double"))
        slack = F.greatest(F.lit(0.01), 1 / F.count(F.lit(1)))
        return (below <= q + slack) & (upto >= q - slack)

    return (j.groupBy("d.window_start", "d.dependency", "d.requests", "d.unmatched", "d.max_latency_ms", "d.sum_latency_ms")
            .agg(holds(0.5, "p50_latency_ms").alias("p50_holds"), holds(0.95, "p95_latency_ms").alias("p95_holds"))
            .withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
            .withColumn("sum_latency_ms", F.round("sum_latency_ms", 6)))


@register("upsert_stream", f"""
WITH {O.match_cte()},
mk AS (SELECT *, {body_hash_sql('body')} AS body_hash,
  {key_sql('method', 'path', 'query', body_hash_sql('body'))} AS request_key
  FROM matched WHERE endpoint_path IS NOT NULL),
last AS (SELECT request_key, arg_max({{'dependency': dependency, 'created_at': ts}}, (ts, request_id)) AS r
         FROM mk GROUP BY request_key)
SELECT r.dependency AS dependency, CAST(count(*) AS BIGINT) AS entries, max(r.created_at) AS latest
FROM last GROUP BY r.dependency""")
def q_upsert_stream(spark, sf_dir):
    """T4: the response store kept current batch by batch (one version per batch)."""
    root, ck = shared_path(spark, "t4-store"), shared_path(spark, "t4-ck")
    keyed = with_keys(M.match_requests(_staged(spark, sf_dir), _routes(spark), strategy="auto")
                      .where(F.col("endpoint_path").isNotNull()))
    rows = _store_rows(keyed.withColumn("hit", F.lit(False)), F.lit(True))
    S.upsert_stream(rows, root, ck, ttl_seconds=STORE_TTL).awaitTermination()
    return S.current_store(spark, root).groupBy("dependency").agg(
        F.count(F.lit(1)).alias("entries"), F.max("created_at").cast("timestamp_ntz").alias("latest"))
