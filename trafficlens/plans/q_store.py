"""Registered queries: keys, TTL dedup, response store, KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.functions import keys as K
from trafficlens.functions.paths import params_to_string
from trafficlens.operators import kpis, serve, store
from trafficlens.operators import match as M
from trafficlens.operators.ttl import ttl_dedup
from trafficlens.plans import oracle_sql as O
from trafficlens.plans.catalog import register
from trafficlens.session import shared_path
from trafficlens.sources import derived as D

HOUR = 3600
DEDUP_TTL = 6 * HOUR
STORE_TTL = 7 * 24 * HOUR
CUTOFF = "2024-01-16 00:00:00"
EXPIRED = "2024-01-15 00:00:00"


# ---------------------------------------------------------------- oracle text
def body_hash_sql(b: str) -> str:
    return f"(CASE WHEN {b} IS NULL OR {b} = '' THEN '' ELSE sha256({b}) END)"


def key_sql(m: str, p: str, q: str, bh: str) -> str:
    return f"sha256(concat_ws('|', coalesce({m}, ''), coalesce({p}, ''), coalesce({q}, ''), coalesce({bh}, '')))"


def ttl_cte(src: str, key: str, ttl_us: int, p: str = "") -> str:
    """CTEs ``{p}nodes``, ``{p}chain``, ``{p}starts``, ``{p}dedup`` (request_id, hit, entry_created_at).
    Needs WITH RECURSIVE."""
    return f"""
{p}ev AS (SELECT request_id, {key} AS k, epoch_us(ts) AS t FROM {src}),
{p}nodes AS (SELECT k, t, min(request_id) AS tid FROM {p}ev GROUP BY k, t),
{p}chain(k, s) AS (
  SELECT k, min(t) FROM {p}nodes GROUP BY k
  UNION ALL
  SELECT c.k, (SELECT min(n.t) FROM {p}nodes n WHERE n.k = c.k AND n.t > c.s + {ttl_us})
  FROM {p}chain c WHERE c.s IS NOT NULL),
{p}starts AS (SELECT c.k, c.s, n.tid FROM {p}chain c JOIN {p}nodes n ON n.k = c.k AND n.t = c.s),
{p}cov AS (SELECT e.request_id, e.k, e.t,
  (SELECT max(st.s) FROM {p}starts st WHERE st.k = e.k AND st.s <= e.t) AS s FROM {p}ev e),
{p}dedup AS (
  SELECT cv.request_id, NOT (cv.t = cv.s AND cv.request_id = st.tid) AS hit,
         make_timestamp(cv.s) AS entry_created_at
  FROM {p}cov cv JOIN {p}starts st ON st.k = cv.k AND st.s = cv.s)"""


def flags_cte(ttl_us: int = DEDUP_TTL * 1_000_000) -> str:
    """CTEs ending in ``flags``: matched + keyed + hit flags (needs WITH RECURSIVE)."""
    return f"""{O.match_cte()},
mk AS (SELECT *, {body_hash_sql('body')} AS body_hash,
  {key_sql('method', 'path', 'query', body_hash_sql('body'))} AS request_key
  FROM matched WHERE endpoint_path IS NOT NULL),
{ttl_cte('mk', 'request_key', ttl_us)},
flags AS (
  SELECT mk.*, d.hit, d.entry_created_at, mk.status_code AS status FROM mk JOIN dedup d USING (request_id)
  UNION ALL BY NAME
  SELECT matched.*, CAST(NULL AS VARCHAR) AS body_hash, CAST(NULL AS VARCHAR) AS request_key,
         CAST(NULL AS BOOLEAN) AS hit, CAST(NULL AS TIMESTAMP) AS entry_created_at, 501 AS status
  FROM matched WHERE endpoint_path IS NULL)"""


def echo_body_sql() -> str:
    return ("'{\"endpoint\":\"' || endpoint_path || '\",\"params\":\"' || coalesce(path_params, '') || '\"}'")


def store_rows_sql(where: str) -> str:
    return f"""SELECT request_key AS key_hash, method, path, query, body_hash AS request_body_hash,
  status_code AS response_status, '{store.JSON_HEADERS}' AS response_headers, {echo_body_sql()} AS response_body,
  dependency, ts AS created_at FROM flags WHERE hit = false AND ({where})"""


def store_cte(where: str, ttl_s: int) -> str:
    return f"""s_in AS ({store_rows_sql(where)}),
s_latest AS (SELECT key_hash, arg_max(s_in, created_at) AS r FROM s_in GROUP BY key_hash),
store AS (SELECT key_hash, r.method, r.path, r.query, r.request_body_hash, r.response_status,
  r.response_headers, r.response_body, r.dependency, r.created_at,
  r.created_at + INTERVAL ({ttl_s}) SECOND AS expires_at FROM s_latest)"""


# ---------------------------------------------------------------- spark side
def _routes(spark):
    ep, deps = D.fixture_registry(spark)
    return M.prepare_routes(ep, deps)


def _flags(spark, sf_dir, ttl=DEDUP_TTL, dedup_strategy="auto"):
    return serve.serve_flags(D.requests(spark, sf_dir), _routes(spark), ttl_seconds=ttl,
                             dedup_strategy=dedup_strategy)


def _store_rows(flags, cond):
    return flags.where((F.col("hit") == False) & cond).select(  # noqa: E712
        F.col("request_key").alias("key_hash"), "method", "path", "query",
        F.col("body_hash").alias("request_body_hash"), F.col("status_code").alias("response_status"),
        F.lit(store.JSON_HEADERS).alias("response_headers"),
        F.concat(F.lit('{"endpoint":"'), F.col("endpoint_path"), F.lit('","params":"'),
                 F.coalesce(params_to_string("path_params"), F.lit("")), F.lit('"}')).alias("response_body"),
        "dependency", F.col("ts").alias("created_at"), F.col("request_id").alias("_seq"))


def _store(spark, sf_dir):
    """Store after two upsert batches: misses before CUTOFF, then misses after."""
    flags = _flags(spark, sf_dir)
    cut = F.col("ts") < F.lit(CUTOFF).cast("timestamp")
    s1 = store.upsert_responses(None, _store_rows(flags, cut), ttl_seconds=STORE_TTL, batch_id=1)
    return store.upsert_responses(s1, _store_rows(flags, ~cut), ttl_seconds=STORE_TTL, batch_id=2)


def _ntz(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


@register("request_keys", f"""
SELECT request_id, {body_hash_sql('body')} AS body_hash,
  {key_sql('method', 'path', 'query', body_hash_sql('body'))} AS request_key,
  {key_sql('method', 'path',
           "array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '')), '&')",
           body_hash_sql("CASE WHEN json_valid(body) THEN CAST(json(body) AS VARCHAR) ELSE body END"))}
    AS canonical_key,
  array_to_string(list_transform(list_sort(list_distinct(list_transform(pairs, lambda e: e.key))),
    lambda k: k || '=' || array_to_string(list_transform(list_filter(pairs, lambda e: e.key = k),
                                                         lambda e: e.value), ',')), '&') AS query_params
FROM (SELECT *, list_transform(
    list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT contains(p, ';')),
    lambda p: {{'key': url_decode(replace(split_part(p, '=', 1), '+', ' ')),
              'value': url_decode(replace(CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1)
                                               ELSE '' END, '+', ' '))}}) AS pairs
  FROM ({O.REQUESTS}))""")
def q_request_keys(spark, sf_dir):
    """F6, F7, F8, F8b over every request."""
    r = D.requests(spark, sf_dir)
    return r.select(
        "request_id", K.hash_body("body").alias("body_hash"),
        K.request_key("method", "path", "query", K.hash_body("body")).alias("request_key"),
        K.canonical_request_key("method", "path", "query", "body").alias("canonical_key"),
        params_to_string(K.query_to_map("query")).alias("query_params"))


@register("ttl_dedup_users", f"""
WITH RECURSIVE req AS ({O.REQUESTS}), {ttl_cte('req', 'user_id', DEDUP_TTL * 1_000_000)}
SELECT req.request_id, req.user_id, d.hit, d.entry_created_at FROM req JOIN dedup d USING (request_id)""")
def q_ttl_users(spark, sf_dir):
    """W1 with key = user_id, ttl = 6 h (3,556 hits of 10,000 at sf0.01)."""
    r = ttl_dedup(D.requests(spark, sf_dir), "user_id", ttl_seconds=DEDUP_TTL)
    return r.select("request_id", "user_id", "hit", _ntz("entry_created_at"))


_TTL_FLOW_SQL = f"""
WITH RECURSIVE {flags_cte()}
SELECT request_id, request_key, hit, entry_created_at FROM flags WHERE endpoint_path IS NOT NULL"""


@register("ttl_dedup", _TTL_FLOW_SQL)
def q_ttl(spark, sf_dir):
    """W1 in the serving flow: matched requests keyed by request_key."""
    f = _flags(spark, sf_dir).where(F.col("endpoint_path").isNotNull())
    return f.select("request_id", "request_key", "hit", _ntz("entry_created_at"))


@register("ttl_dedup_jump", _TTL_FLOW_SQL)
def q_ttl_jump(spark, sf_dir):
    """W1 forced onto the skew-safe pointer-doubling path."""
    f = _flags(spark, sf_dir, dedup_strategy="jump").where(F.col("endpoint_path").isNotNull())
    return f.select("request_id", "request_key", "hit", _ntz("entry_created_at"))


_STORE_SQL_CTE = f"""{flags_cte()},
{store_cte('true', STORE_TTL)}"""


@register("response_store", f"""
WITH RECURSIVE {_STORE_SQL_CTE}
SELECT key_hash, method, path, query, request_body_hash, response_status, response_headers,
  response_body, dependency, created_at, expires_at FROM store""")
def q_response_store(spark, sf_dir):
    """Store after two upsert batches (later write wins per key)."""
    s = _store(spark, sf_dir)
    return s.select(*[c for c in store.STORE_COLS if c not in ("created_at", "expires_at")],
                    _ntz("created_at"), _ntz("expires_at"))


@register("lookup_responses", f"""
WITH RECURSIVE {flags_cte()},
{store_cte(f"ts < TIMESTAMP '{CUTOFF}'", STORE_TTL)},
late AS (SELECT * FROM flags WHERE endpoint_path IS NOT NULL AND ts >= TIMESTAMP '{CUTOFF}')
SELECT late.request_id, late.request_key,
  (store.key_hash IS NOT NULL AND (store.expires_at IS NULL OR NOT (late.ts > store.expires_at))) AS hit,
  CASE WHEN store.key_hash IS NOT NULL AND (store.expires_at IS NULL OR NOT (late.ts > store.expires_at))
       THEN store.created_at END AS store_created_at
FROM late LEFT JOIN store ON late.request_key = store.key_hash""")
def q_lookup(spark, sf_dir):
    """Requests after the cutoff looked up in the store written before it."""
    flags = _flags(spark, sf_dir)
    cut = F.col("ts") < F.lit(CUTOFF).cast("timestamp")
    s1 = store.upsert_responses(None, _store_rows(flags, cut), ttl_seconds=STORE_TTL, batch_id=1)
    late = flags.where(F.col("endpoint_path").isNotNull() & ~cut).select("request_id", "request_key", "ts")
    out = store.lookup_responses(late, s1)
    return out.select("request_id", "request_key", "hit", _ntz("store_created_at"))


@register("store_stats", f"""
WITH RECURSIVE {_STORE_SQL_CTE}
SELECT dependency, CAST(count(*) AS BIGINT) AS total_entries,
  CAST(coalesce(sum(length(response_body)), 0) AS BIGINT) AS total_size,
  CAST(grouping(dependency) AS INTEGER) AS is_total
FROM store GROUP BY ROLLUP (dependency)""")
def q_store_stats(spark, sf_dir):
    """A5: entries and body characters per dependency plus the total."""
    s = store.store_stats(_store(spark, sf_dir), by_dependency=True)
    return s.select("dependency", "total_entries", "total_size", F.col("is_total").cast("int").alias("is_total"))


@register("purge_store", f"""
WITH RECURSIVE {_STORE_SQL_CTE},
del AS (SELECT CAST(count(*) AS BIGINT) AS n FROM store WHERE dependency = 'user-service')
SELECT dependency, CAST(count(*) AS BIGINT) AS remaining, (SELECT n FROM del) AS deleted
FROM store WHERE NOT (dependency = 'user-service') GROUP BY dependency""")
def q_purge(spark, sf_dir):
    """Purge one dependency; remaining entries per dependency and the deleted count."""
    remaining, deleted = store.purge(_store(spark, sf_dir), dependency="user-service")
    n = deleted.select(F.col("deleted").cast("long")).scalar()
    return remaining.groupBy("dependency").agg(F.count(F.lit(1)).alias("remaining")).select(
        "dependency", "remaining", n.alias("deleted"))


@register("store_persisted", f"""
WITH RECURSIVE {_STORE_SQL_CTE}
SELECT key_hash, dependency, response_status, response_body, created_at, expires_at
FROM store WHERE dependency <> 'user-service' AND NOT (expires_at < TIMESTAMP '{EXPIRED}')""")
def q_store_persisted(spark, sf_dir):
    """S4 + A6 on disk: two upserts, a purge of one dependency and of expired rows, then reread."""
    flags = _flags(spark, sf_dir)
    cut = F.col("ts") < F.lit(CUTOFF).cast("timestamp")
    path = shared_path(spark, "store")
    store.upsert_persisted(spark, path, _store_rows(flags, cut), STORE_TTL, batch_id=1)
    store.upsert_persisted(spark, path, _store_rows(flags, ~cut), STORE_TTL, batch_id=2)
    store.purge_persisted(spark, path, dependency="user-service")
    store.purge_persisted(spark, path, expired_before=EXPIRED)
    s = store.read_store(spark, path)
    return s.select("key_hash", "dependency", "response_status", "response_body", _ntz("created_at"), _ntz("expires_at"))


_KPI_SQL = """
SELECT {keys}, CAST(count(*) AS BIGINT) AS requests,
  CAST(coalesce(count_if(endpoint_path IS NULL), 0) AS BIGINT) AS unmatched,
  CAST(coalesce(count_if(hit = true), 0) AS BIGINT) AS hits,
  CAST(coalesce(count_if(hit = false), 0) AS BIGINT) AS misses,
  round(CASE WHEN count_if(hit IS NOT NULL) > 0
        THEN count_if(hit = true) / count_if(hit IS NOT NULL) END, 6) AS hit_rate,
  round(quantile_cont(latency_ms, 0.5) FILTER (WHERE hit = true), 6) AS p50_hit_ms,
  round(quantile_cont(latency_ms, 0.95) FILTER (WHERE hit = true), 6) AS p95_hit_ms,
  round(quantile_cont(latency_ms, 0.5) FILTER (WHERE hit = false), 6) AS p50_miss_ms,
  round(quantile_cont(latency_ms, 0.95) FILTER (WHERE hit = false), 6) AS p95_miss_ms,
  (SELECT string_agg(s.status || ':' || s.n, ',' ORDER BY s.status) FROM
     (SELECT status, count(*) AS n FROM flags f2 WHERE {match} GROUP BY status) s) AS status_mix
FROM flags f GROUP BY {keys}"""


@register("traffic_kpis", "WITH RECURSIVE " + flags_cte() + _KPI_SQL.format(
    keys="dependency", match="f2.dependency IS NOT DISTINCT FROM f.dependency"))
def q_kpis(spark, sf_dir):
    """Traffic KPIs per dependency (flagship)."""
    return kpis.traffic_kpis(_flags(spark, sf_dir))


@register("traffic_kpis_endpoint", "WITH RECURSIVE " + flags_cte() + _KPI_SQL.format(
    keys="dependency, endpoint_method, endpoint_path",
    match=("f2.dependency IS NOT DISTINCT FROM f.dependency AND f2.endpoint_method IS NOT DISTINCT FROM "
           "f.endpoint_method AND f2.endpoint_path IS NOT DISTINCT FROM f.endpoint_path")))
def q_kpis_endpoint(spark, sf_dir):
    """A7 per endpoint."""
    return kpis.traffic_kpis(_flags(spark, sf_dir), by_endpoint=True)
