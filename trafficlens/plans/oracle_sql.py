"""DuckDB SQL text for the independent oracle of every registered query.

The driver runs these on its own views of the parquet tables.  The fragments
below derive the same inputs as ``trafficlens.sources.derived`` and restate
each operator's semantics in plain SQL, written independently of the Spark
plans they check.
"""

from __future__ import annotations

REQUESTS = """
SELECT event_id AS request_id, ts, user_id,
  CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'GET'
       WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'POST' ELSE 'PATCH' END AS method,
  CASE event_type
    WHEN 'view'     THEN concat('/api/users/users/', CAST(user_id AS VARCHAR))
    WHEN 'click'    THEN concat('/api//orders/', CAST(user_id AS VARCHAR), '/items/')
    WHEN 'signup'   THEN '/api/users/users'
    WHEN 'purchase' THEN concat('api/orders/', CAST(user_id AS VARCHAR))
    ELSE concat('/nope/', CAST(user_id AS VARCHAR)) END AS path,
  CASE event_type WHEN 'view'
    THEN concat('page=', CAST(event_id % 3 AS VARCHAR), '&tag=a%20b&tag=c') ELSE '' END AS query,
  CASE WHEN event_type IN ('signup','purchase') THEN props ELSE '' END AS body,
  value AS latency_ms
FROM events
"""

ENDPOINTS = """
SELECT * FROM (VALUES
 ('user-service','/api/users',0,'GET','/users',200),
 ('user-service','/api/users',1,'GET','/users/:id',200),
 ('user-service','/api/users',2,'GET','/users/me',200),
 ('user-service','/api/users',3,'POST','/users',201),
 ('edge-service','/api',4,'ANY','/orders/{orderId}',200),
 ('edge-service','/api',5,'GET','/orders/{orderId}/items',200),
 ('edge-service','/api',6,'GET','/users/users/{uid}',200),
 ('root-service','/',7,'GET','/health',200)
) AS t(dependency, prefix, ord, method, path, status_code)
"""

PAGE_REQUESTS = """
SELECT page_id AS request_id, 'GET' AS method,
  regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path,
  regexp_extract(url, '[?]([^#]*)', 1) AS query, '' AS body
FROM pages
"""

RAW_OUTPUTS = """
SELECT event_id AS output_id,
  CASE event_id % 5
    WHEN 0 THEN concat('[', replace(props, '}', ',}'), ']')
    WHEN 1 THEN concat('Here it is:', chr(10), '```json', chr(10), '[', props, ',]', chr(10), '```')
    WHEN 2 THEN concat('```', chr(10), '[', props, ']', chr(10), '```')
    WHEN 3 THEN '[]'
    ELSE concat('not json ', CAST(event_id AS VARCHAR)) END AS raw
FROM events
"""

SOURCE_FILES = """
SELECT concat('svc-', CAST(p_partkey AS VARCHAR)) AS repo,
  CASE p_size % 7 WHEN 0 THEN 'vendor/lib/api.go' WHEN 1 THEN 'api/api_test.go' ELSE 'api/api.go' END AS path,
  concat_ws(chr(10),
    'package api', '',
    'import (', concat(chr(9), '"net/http"'),
    concat(chr(9), '"', CASE p_size % 5 WHEN 0 THEN 'github.com/go-chi/chi/v5' WHEN 1 THEN 'github.com/gin-gonic/gin'
      WHEN 2 THEN 'github.com/labstack/echo/v4' WHEN 3 THEN 'github.com/gorilla/mux' ELSE 'encoding/json' END, '"'),
    ')', '',
    '// Part is one catalogue entry.',
    'type Part struct {',
    concat(chr(9), 'ID string `json:"id"`'),
    concat(chr(9), 'Size int `json:"size_', CAST(p_size AS VARCHAR), ',omitempty"`'),
    concat(chr(9), 'Made *Maker `json:"made"`'),
    concat(chr(9), 'Seen time.Time'),
    concat(chr(9), 'hidden bool'),
    '}', '',
    'type Maker struct {', concat(chr(9), 'Name string `json:"name"`'),
    concat(chr(9), 'Tags []string `json:"tags,omitempty"`'), '}', '',
    'func (h *API) GetPart(w http.ResponseWriter, r *http.Request) {',
    concat(chr(9), 'part := Part{}'),
    concat(chr(9), 'w.WriteHeader(http.StatusOK)'),
    concat(chr(9), 'json.NewEncoder(w).Encode(part)'),
    '}', '',
    'func (h *API) AddPart(w http.ResponseWriter, r *http.Request) {',
    concat(chr(9), 'var in Part'),
    concat(chr(9), 'json.NewDecoder(r.Body).Decode(&in)'),
    concat(chr(9), 'w.WriteHeader(201)'),
    concat(chr(9), 'json.NewEncoder(w).Encode(in)'),
    '}', '',
    'func Routes(r Router) {',
    concat(chr(9), 'r.Get("/parts/{id}", h.GetPart)'),
    concat(chr(9), 'r.HandleFunc("POST /parts", h.AddPart)'),
    concat(chr(9), 'r.HandleFunc("/legacy/', CAST(p_size AS VARCHAR), '", h.GetPart)'),
    '}') AS content
FROM part
"""


def norm(expr: str) -> str:
    """SQL for path normalisation ('' and '/' -> '/', leading '/', no trailing '/')."""
    e = f"coalesce({expr}, '')"
    return (f"(CASE WHEN {e} IN ('', '/') THEN '/' ELSE regexp_replace("
            f"CASE WHEN starts_with({e}, '/') THEN {e} ELSE '/' || {e} END, '/+$', '') END)")


def segs(expr: str) -> str:
    return f"list_filter(string_split({expr}, '/'), lambda x: x <> '')"


def pattern(expr: str) -> str:
    """Pattern segments after ':x' -> '{x}' (list of strings, params keep braces)."""
    return (f"list_transform({segs(norm(expr))}, "
            f"lambda x: CASE WHEN starts_with(x, ':') THEN '{{' || substr(x, 2) || '}}' ELSE x END)")


def is_param(x: str) -> str:
    return f"(starts_with({x}, '{{') AND ends_with({x}, '}}') AND length({x}) >= 2)"


def match_cte(requests_sql: str = REQUESTS, endpoints_sql: str = ENDPOINTS) -> str:
    """CTE list ending in ``matched``: every request with its winning endpoint."""
    return f"""
req AS ({requests_sql}),
ep AS ({endpoints_sql}),
e AS (
  SELECT dependency, ord, method AS ep_method, path AS ep_path, status_code,
         {norm('prefix')} AS pfx, {pattern('path')} AS psegs
  FROM ep),
r AS (SELECT request_id, method, {norm('path')} AS np FROM req),
c AS (
  SELECT r.request_id, e.*, {segs("substr(r.np, length(e.pfx) + 1)")} AS rsegs
  FROM r JOIN e ON starts_with(r.np, e.pfx) AND (e.ep_method = r.method OR e.ep_method = 'ANY')),
ok AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY length(pfx) DESC, ord) AS rn
  FROM c
  WHERE len(rsegs) = len(psegs)
    AND coalesce(list_bool_and(list_transform(list_zip(psegs, rsegs),
          lambda z: {is_param('z[1]')} OR z[1] = z[2])), true)),
best AS (
  SELECT request_id, dependency, ep_method, ep_path, status_code,
    list_transform(list_filter(list_zip(psegs, rsegs), lambda z: {is_param('z[1]')}),
                   lambda z: {{'key': substr(z[1], 2, length(z[1]) - 2), 'value': z[2]}}) AS kv
  FROM ok WHERE rn = 1),
bestp AS (
  SELECT request_id, dependency, ep_method, ep_path, status_code,
    array_to_string(list_transform(list_sort(list_filter(kv, lambda e, i:
        NOT list_contains(list_transform(kv[i + 1:], lambda o: o.key), e.key))),
      lambda e: e.key || '=' || e.value), '&') AS params
  FROM best),
matched AS (
  SELECT req.*, bestp.dependency, bestp.ep_method AS endpoint_method, bestp.ep_path AS endpoint_path,
         bestp.status_code, bestp.params AS path_params
  FROM req LEFT JOIN bestp USING (request_id))
"""
