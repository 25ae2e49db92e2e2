"""Registered queries: request log, path functions and request matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.functions import paths as P
from trafficlens.operators import match as M
from trafficlens.plans import oracle_sql as O
from trafficlens.plans.catalog import register
from trafficlens.sources import derived as D

MATCH_OUT = ["request_id", "method", "path", "dependency", "endpoint_method", "endpoint_path",
             "status_code", "path_params"]


def _render(m):
    return m.select(*[F.col(c) for c in MATCH_OUT if c != "path_params"],
                    P.params_to_string("path_params").alias("path_params"))


def _fixture_match(spark, sf_dir, strategy):
    ep, deps = D.fixture_registry(spark)
    return M.match_requests(D.requests(spark, sf_dir), M.prepare_routes(ep, deps), strategy=strategy)


_MATCH_SQL = f"WITH {O.match_cte()} SELECT {', '.join(MATCH_OUT)} FROM matched"


@register("read_requests", f"""
SELECT request_id, CAST(ts AS TIMESTAMP) AS ts, user_id, method, path, query, body, latency_ms
FROM ({O.REQUESTS})""")
def q_read_requests(spark, sf_dir):
    """S5 (batch): the request log derived from events."""
    return D.requests(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("path_functions", f"""
SELECT request_id,
  {O.norm('path')} AS norm_path,
  array_to_string({O.segs(O.norm('path'))}, '|') AS segments,
  CAST(len({O.segs(O.norm('path'))}) AS INTEGER) AS n_segments,
  CASE WHEN starts_with({O.norm('path')}, '/api/user')
    THEN (CASE WHEN substr({O.norm('path')}, 10) = '' THEN '/'
               WHEN starts_with(substr({O.norm('path')}, 10), '/') THEN substr({O.norm('path')}, 10)
               ELSE '/' || substr({O.norm('path')}, 10) END) END AS stripped,
  array_to_string(list_transform({O.pattern('path')},
      lambda x: CASE WHEN {O.is_param('x')} THEN 'param:' || substr(x, 2, length(x) - 2) ELSE x END), '|')
    AS pattern
FROM ({O.REQUESTS})""")
def q_path_functions(spark, sf_dir):
    """F1-F4 over every request path."""
    r = D.requests(spark, sf_dir)
    np = P.normalize_path("path")
    pat = P.pattern_segments("path")
    return r.select(
        "request_id",
        np.alias("norm_path"),
        F.array_join(P.path_segments(np), "|").alias("segments"),
        F.size(P.path_segments(np)).alias("n_segments"),
        F.when(np.startswith("/api/user"), P.strip_prefix(np, F.lit("/api/user"))).alias("stripped"),
        F.array_join(F.transform(pat, lambda s: F.when(s["is_param"], F.concat(F.lit("param:"), s["value"]))
                                 .otherwise(s["value"])), "|").alias("pattern"))


@register("match_requests", _MATCH_SQL)
def q_match_requests(spark, sf_dir):
    """J1 (auto form: array for this small registry)."""
    return _render(_fixture_match(spark, sf_dir, "auto"))


@register("match_requests_hash", _MATCH_SQL)
def q_match_requests_hash(spark, sf_dir):
    """J1 hash-join form on the same inputs (must equal the array form)."""
    return _render(_fixture_match(spark, sf_dir, "hash"))


_PAGE_ENDPOINTS = """
SELECT * FROM (VALUES ('page-service', '/', 0, 'GET', '/{lang}/{id}', 200))
  AS t(dependency, prefix, ord, method, path, status_code)"""


@register("match_pages", f"WITH {O.match_cte(O.PAGE_REQUESTS, _PAGE_ENDPOINTS)} "
                         f"SELECT {', '.join(MATCH_OUT)} FROM matched")
def q_match_pages(spark, sf_dir):
    """J1 over real-looking page URLs against GET /{lang}/{id} at '/'."""
    ep = spark.createDataFrame([("page-service", 0, "GET", "/{lang}/{id}", 200)],
                               "dependency string, ord int, method string, path string, status_code int")
    deps = spark.createDataFrame([("page-service", "/")], "name string, prefix string")
    m = M.match_requests(D.page_requests(spark, sf_dir), M.prepare_routes(ep, deps))
    return _render(m)


@register("unmatched_requests", f"""
WITH {O.match_cte()}
SELECT request_id, method, path, 501 AS status,
  to_json({{'error': 'no matching endpoint', 'method': method, 'path': path}}) AS error_body
FROM matched WHERE endpoint_path IS NULL""")
def q_unmatched(spark, sf_dir):
    """The 501 rows."""
    u = M.unmatched_requests(_fixture_match(spark, sf_dir, "auto"))
    return u.select("request_id", "method", "path", "status", "error_body")


@register("diagnose_unmatched", f"""
WITH {O.match_cte()},
um AS (SELECT request_id, method, path, {O.norm('path')} AS np FROM matched WHERE endpoint_path IS NULL),
pm AS (
  SELECT um.request_id, e.dependency, length(e.pfx) AS plen, e.ord,
         row_number() OVER (PARTITION BY um.request_id ORDER BY length(e.pfx) DESC, e.ord) AS rn
  FROM um JOIN e ON starts_with(um.np, e.pfx)),
ops AS (SELECT dependency, string_agg(ep_method || ' ' || ep_path, ',' ORDER BY ord) AS ops FROM e GROUP BY 1),
pfxs AS (SELECT string_agg(DISTINCT pfx, ',' ORDER BY pfx) AS p FROM e)
SELECT um.request_id, um.method, um.path,
  CASE WHEN pm.dependency IS NULL THEN 'no_dependency_match' ELSE 'no_operation_match' END AS error,
  CASE WHEN pm.dependency IS NULL THEN 404 ELSE 501 END AS status,
  pm.dependency,
  CASE WHEN pm.dependency IS NULL THEN (SELECT p FROM pfxs) ELSE ops.ops END AS available
FROM um LEFT JOIN pm ON um.request_id = pm.request_id AND pm.rn = 1
LEFT JOIN ops ON ops.dependency = pm.dependency""")
def q_diagnose(spark, sf_dir):
    """404 no_dependency_match vs 501 no_operation_match."""
    ep, deps = D.fixture_registry(spark)
    routes = M.prepare_routes(ep, deps)
    m = M.match_requests(D.requests(spark, sf_dir), routes)
    return M.diagnose_unmatched(m, routes)
