"""Registered queries: prompts, model calls (stand-in client), generation, conformance, serving."""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import functions as F

from trafficlens.functions import keys as K
from trafficlens.functions.jsonfix import repair_json
from trafficlens.operators import generate as GEN
from trafficlens.operators import match as M
from trafficlens.operators import registry as R
from trafficlens.operators import store as S
from trafficlens.operators.analysis import parse_endpoints
from trafficlens.plans import oracle_sql as O
from trafficlens.plans.catalog import register
from trafficlens.plans.q_extract import _SCAN_CTES, _keep, _lineitem_requests, _scan, lineitem_request_id
from trafficlens.plans.q_store import ttl_cte
from trafficlens.session import shared_path
from trafficlens.sources import derived as D


#: CTEs ``r`` (lineitem requests) and ``ok`` (their endpoint's status) over the scan's CTEs.
_LINEITEM_MATCH = f"""
e AS (SELECT dependency, ord, method AS ep_method, status_code, '/' || repo AS pfx,
  list_filter(string_split(endpoint_path, '/'), lambda x: x <> '') AS psegs FROM eps),
r AS (SELECT ((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 101 + l_suppkey AS request_id,
  CASE WHEN l_linenumber % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
  '/svc-' || CAST(l_partkey AS VARCHAR) || CASE WHEN l_linenumber % 3 = 0 THEN '/parts'
    WHEN l_linenumber % 3 = 1 THEN '/parts/' || CAST(l_orderkey AS VARCHAR)
    ELSE '/legacy/' || CAST(l_suppkey AS VARCHAR) END AS path, CAST(l_shipdate AS TIMESTAMP) AS ts FROM lineitem),
c AS (SELECT r.*, e.ord, e.status_code, e.psegs,
  list_filter(string_split(substr(r.path, length(e.pfx) + 1), '/'), lambda x: x <> '') AS rsegs
  FROM r JOIN e ON e.pfx = '/' || split_part(r.path, '/', 2) AND (e.ep_method = r.method OR e.ep_method = 'ANY')),
ok AS (SELECT request_id, arg_min(status_code, ord) AS status_code FROM c
  WHERE len(rsegs) = len(psegs) AND coalesce(list_bool_and(list_transform(list_zip(psegs, rsegs),
        lambda z: {O.is_param('z[1]')} OR z[1] = z[2])), true) GROUP BY request_id)"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _field(path: str, key: str, kind: str, required: str, fmt: str = "") -> str:
    """A field of a prompt's schema, as JSON in SQL text; ``%s`` stands for the part's size."""
    return (f'{{"field_path":"{path}","json_key":"{key}","json_type":"{kind}",' + (f'"format":"{fmt}",' if fmt else "")
            + f'"required":{required}}}')


#: The schema of the corpus's one top struct, in order.
_PART_SCHEMA = "[" + ",".join([
    _field("id", "id", "string", "true"), _field("size_%s", "size_%s", "integer", "false"),
    _field("made", "made", "object", "true"), _field("made.name", "name", "string", "true"),
    _field("made.tags", "tags", "array", "false"), _field("seen", "seen", "string", "true", "date-time")]) + "]"

#: CTEs over the scan's: ``mr``, the matched lineitem requests with endpoint, part size and request key.
_MATCHED = f"""
best AS (SELECT request_id, arg_min({{'ord': ord, 'status_code': status_code}}, ord) AS b FROM c
  WHERE len(rsegs) = len(psegs) AND coalesce(list_bool_and(list_transform(list_zip(psegs, rsegs),
        lambda z: {O.is_param('z[1]')} OR z[1] = z[2])), true) GROUP BY request_id),
rr AS (SELECT r.repo, CAST(row_number() OVER (PARTITION BY r.repo ORDER BY r.path, r.line) - 1 AS INTEGER) AS ord,
         r.method || ' ' || r.route || ' handled by ' || r.handler AS description FROM routes r),
mr AS (SELECT r.request_id, r.method, r.path, best.b.ord AS ord, best.b.status_code AS status_code, eps.method AS ep_method,
         eps.endpoint_path, eps.request_type, eps.response_type, eps.repo, rr.description,
         CAST(p.p_size AS VARCHAR) AS n, sha256(r.method || '|' || r.path || '||') AS request_key,
         CASE WHEN r.path LIKE '%/parts/%' THEN split_part(r.path, '/', 4) END AS id
       FROM best JOIN r USING (request_id) JOIN eps ON eps.repo = split_part(r.path, '/', 2) AND eps.ord = best.b.ord
       JOIN rr ON rr.repo = eps.repo AND rr.ord = eps.ord
       JOIN part p ON 'svc-' || p.p_partkey = eps.repo)"""


def make_registry_client():
    """Stand-in model for tests and queries: answers an analysis prompt with the
    routes it lists, as a fenced JSON array with a trailing comma.  What fails
    depends on the prompt and its attempt alone, not on how prompts are
    partitioned: one whose legacy route's number is a multiple of 5 fails the
    first time."""
    tried = set()

    def client(system: str, prompt: str) -> str:
        legacy = re.search(r"/legacy/(\d+)", prompt)
        if legacy and int(legacy.group(1)) % 5 == 0 and prompt not in tried:
            tried.add(prompt)
            raise RuntimeError("transient upstream error")
        tried.discard(prompt)
        m = re.search(r"### Routes \(JSON\)\n(.*?)\n\n### ", prompt, re.S)
        routes = json.loads(m.group(1)) if m else []
        eps = [{"method": r["method"], "path": r["path"], "description": r["handler"], "request_body": None,
                "response_body": {"type": "object", "fields": []}, "status_code": 200} for r in routes]
        return "```json\n" + json.dumps(eps)[:-1] + ",]\n```"

    return client


BODY = ["repo", "response_dir", "response_package", "response_type"]


def _no_sleep(_seconds):
    return None


def _corpus_flow(spark, sf_dir, matched=False):
    """matched: the registry is stored, as the matching and what follows it read it several times."""
    _, sf, rt, hd, fw = _scan(spark, sf_dir)
    eps = R.build_registry(rt, hd, sf)
    if matched:
        eps = _keep(eps, "registry")
    deps = eps.select(F.col("dependency").alias("name"), F.concat(F.lit("/"), F.col("dependency")).alias("prefix")) \
        .distinct()
    routes = M.prepare_routes(eps.select("dependency", "ord", "method", F.col("endpoint_path").alias("path"),
                                         "status_code"), deps)
    return sf, rt, hd, fw, eps, routes


@register("response_prompts", f"""
WITH {_SCAN_CTES},
{_LINEITEM_MATCH},
{_MATCHED}
SELECT request_id, request_key,
  {_sql(GEN.PROMPT_HEAD)} || ep_method || ' ' || endpoint_path || chr(10) || 'Purpose: ' || description || chr(10) || 'Status: '
  || status_code || chr(10)
  || CASE WHEN id IS NULL THEN '' ELSE concat(chr(10), 'Values in the path:', chr(10), '  id = ', id, chr(10)) END
  || CASE WHEN response_type = 'Part' THEN concat(chr(10), 'Schema of the body:', chr(10), replace({_sql(_PART_SCHEMA)}, '%s', n), chr(10)) ELSE '' END
  || CASE WHEN request_type = 'Part' THEN concat(chr(10), 'Schema of the body sent:', chr(10), replace({_sql(_PART_SCHEMA)}, '%s', n), chr(10)) ELSE '' END
  || chr(10) || 'Rules:' || chr(10) || {_sql(chr(10).join(GEN.RESPONSE_RULES))} || chr(10) AS prompt
FROM mr""")
def q_response_prompts(spark, sf_dir):
    """One generation prompt per matched request (lineitem traffic on the scanned registry)."""
    sf, _, _, _, eps, routes = _corpus_flow(spark, sf_dir, matched=True)
    req = _lineitem_requests(spark, sf_dir).withColumn("query", F.lit("")).withColumn("body", F.lit(""))
    m = M.match_requests(req, routes).where(F.col("endpoint_path").isNotNull())
    m = m.withColumn("request_key", K.request_key("method", "path", "query", K.hash_body("body")))
    return GEN.build_response_prompts(m, eps, R.expand_fields(sf))


def _analysis_sql(over: int | None) -> str:
    """G3 in SQL: the facts as JSON items, sorted within their kind."""
    size = "false" if over is None else f"sum(length(item)) OVER (PARTITION BY repo) > {over}"
    part = lambda k: f"'[' || coalesce(string_agg(item, ',' ORDER BY item) FILTER (kind = '{k}'), '') || ']'"
    return f"""
WITH {_SCAN_CTES},
framework AS (SELECT 'svc-' || p_partkey AS repo, CASE p_size % 5 WHEN 0 THEN 'chi' WHEN 1 THEN 'gin' WHEN 2 THEN 'echo'
  WHEN 3 THEN 'gorilla' ELSE 'stdlib' END AS framework FROM part),
items AS (
  SELECT repo, regexp_replace(path, '/?[^/]*$', '') AS dir, 's' AS kind, to_json({{'name': struct, 'package': package, 'file': path,
    'fields': list({{'name': field, 'type': type, 'json_tag': json_tag, 'omitempty': omitempty}} ORDER BY pos)}})::VARCHAR AS item
  FROM struct_fields GROUP BY repo, path, package, struct
  UNION ALL
  SELECT repo, regexp_replace(path, '/?[^/]*$', ''), 'r', to_json({{'method': method, 'path': route, 'handler': handler,
    'file': path, 'line': line}})::VARCHAR FROM routes
  UNION ALL
  SELECT repo, regexp_replace(path, '/?[^/]*$', ''), 'h', to_json({{'name': name, 'receiver': receiver, 'file': path,
    'decodes': decodes, 'encodes': encodes,
    'status_codes': list_transform(list_filter(string_split(status_codes, ','), lambda x: x <> ''), lambda x: x::INTEGER)}})::VARCHAR
  FROM handlers),
sized AS (SELECT *, {size} AS big FROM items),
per AS (SELECT repo, CASE WHEN big THEN dir END AS package, {part('s')} AS s, {part('r')} AS r, {part('h')} AS h
        FROM sized GROUP BY ALL)
SELECT repo, package, 'Facts about a Go service that uses: ' || coalesce(framework, 'unknown') || chr(10) || chr(10)
  || '### Structs (JSON)' || chr(10) || s || chr(10) || chr(10) || '### Routes (JSON)' || chr(10) || r || chr(10) || chr(10)
  || '### Handlers (JSON)' || chr(10) || h || chr(10) || chr(10) || {_sql(GEN.ANALYSIS_TASK)} AS prompt
FROM per LEFT JOIN framework USING (repo)"""


@register("analysis_prompts", _analysis_sql(None))
def q_analysis_prompts(spark, sf_dir):
    """One analysis prompt per repo."""
    sf, rt, hd, fw, _, _ = _corpus_flow(spark, sf_dir)
    return GEN.build_analysis_prompts(sf, rt, hd, fw)


@register("analysis_prompts_chunked", _analysis_sql(1200))
def q_analysis_prompts_chunked(spark, sf_dir):
    """Prompts longer than 1,200 characters are split per package."""
    sf, rt, hd, fw, _, _ = _corpus_flow(spark, sf_dir)
    return GEN.build_analysis_prompts(sf, rt, hd, fw, by_package_over=1200)


@register("batch_infer", f"""
WITH {_SCAN_CTES}
SELECT repo, CASE WHEN max(TRY_CAST(split_part(route, '/legacy/', 2) AS INTEGER)) % 5 = 0 THEN 2 ELSE 1 END AS attempts,
  CAST(NULL AS VARCHAR) AS error, CAST(count(*) AS BIGINT) AS n_endpoints FROM routes GROUP BY repo""")
def q_batch_infer(spark, sf_dir):
    """G4 + G1: analysis prompts through the (stand-in) model with retries, parsed into endpoints."""
    sf, rt, hd, fw, _, _ = _corpus_flow(spark, sf_dir)
    prompts = GEN.build_analysis_prompts(sf, rt, hd, fw)
    out = GEN.batch_infer(prompts, make_registry_client, system=GEN.ANALYSIS_SYSTEM, max_retries=2,
                          validate="endpoints", sleep=_no_sleep, answers_path=shared_path(spark, "answers"))
    parsed, _ = parse_endpoints(out.select(F.col("repo").alias("output_id"), F.col("response").alias("raw")))
    n = parsed.groupBy("output_id").agg(F.count(F.lit(1)).alias("n_endpoints"))
    return out.join(n, out["repo"] == n["output_id"], "left").select(
        "repo", "attempts", "error", F.coalesce("n_endpoints", F.lit(0)).alias("n_endpoints"))


def _bodies(spark, sf_dir):
    sf, _, _, _, eps, routes = _corpus_flow(spark, sf_dir, matched=True)
    req = _lineitem_requests(spark, sf_dir)
    m = (M.match_requests(req, routes).where(F.col("endpoint_path").isNotNull() & F.col("dependency").isNotNull())
         .withColumn("request_key", K.request_key("method", "path", F.lit(""), F.lit(""))))
    fields = _keep(R.expand_fields(sf), "expanded")
    return GEN.generate_responses(m.select("request_id", "request_key", "dependency", "endpoint_ord", "path_params"), fields, eps), fields


def _body_sql() -> str:
    """G5 in SQL for the corpus's top struct: each value from the digest of request key and field path."""
    digest = lambda path: f"sha256(request_key || '|' || {path})"
    number = lambda path: f"('0x' || substr({digest(path)}, 1, 7))::BIGINT"
    text = lambda key, path: f"'\"{key}-' || substr({digest(path)}, 1, 8) || '\"'"
    tags = ",' || ".join(text("tags", f"'made.tags#{i}'") + " || '" for i in range(2 + zlib.crc32(b"made.tags") % 2))
    when = (f"strftime(to_timestamp(1700000000 + {number(_sql('seen'))} % 31536000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')")
    return f"""CASE WHEN response_type = 'Part' THEN
  '{{"id":' || coalesce('"' || id || '"', {text('id', _sql('id'))}) || ',"size_' || n || '":' || {number("'size_' || n")} % 1000
  || ',"made":{{"name":' || {text('name', _sql('made.name'))} || ',"tags":[' || {tags}]}},"seen":"' || {when} || '"}}'
  ELSE '{{}}' END"""


@register("generate_responses", f"""
WITH {_SCAN_CTES},
{_LINEITEM_MATCH},
{_MATCHED}
SELECT request_id, request_key, repo, response_type, {_body_sql()} AS body FROM mr""")
def q_generate_responses(spark, sf_dir):
    """Schema-conforming bodies, deterministic per request key, params echoed."""
    b, _ = _bodies(spark, sf_dir)
    return b.select("request_id", "request_key", "repo", "response_type", "body")


def _model_bodies(spark, sf_dir):
    """Every model output, to be held against the schema of the Part that its id names."""
    parts = D.table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return D.raw_outputs(spark, sf_dir).select(
        F.col("output_id").alias("request_id"),
        F.concat(F.lit("svc-"), (F.col("output_id") % parts + 1).cast("string")).alias("repo"),
        F.lit("api").alias("response_dir"), F.lit("api").alias("response_package"),
        F.lit("Part").alias("response_type"), F.lit("array").alias("body_type"), repair_json("raw").alias("body"))


#: CTE ``model``: the events' model outputs: how many objects in the list (null: no list), and their own keys.
_MODEL_SQL = """
model AS (SELECT event_id AS request_id, 'svc-' || (event_id % (SELECT count(*) FROM part) + 1) AS repo,
  CASE event_id % 5 WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE 1 END AS objects, json_keys(props) AS keys FROM events),
known AS (SELECT 'svc-' || p_partkey AS repo, p_size FROM part WHERE p_size % 7 > 1)"""


@register("check_conformance", f"""
WITH {_SCAN_CTES},
{_LINEITEM_MATCH},
{_MODEL_SQL}
SELECT 'generated' AS source, count(*) AS bodies, count(*) AS valid_bodies, 1.0::DOUBLE AS field_accuracy FROM ok
UNION ALL
SELECT 'model', count(*), count(objects), 0.0::DOUBLE FROM model""")
def q_check_conformance(spark, sf_dir):
    """Field accuracy of generated bodies and of repaired model outputs."""
    b, fields = _bodies(spark, sf_dir)
    gen = GEN.check_conformance(b.select("request_id", *BODY, "body_type", "body"), fields)
    model = _model_bodies(spark, sf_dir)
    mod = GEN.check_conformance(model, fields)
    return GEN.field_accuracy(gen.withColumn("source", F.lit("generated")), ["source"]).unionByName(
        GEN.field_accuracy(mod.withColumn("source", F.lit("model")), ["source"]))


@register("conformance_rows", f"""
WITH {_MODEL_SQL}
SELECT request_id, objects IS NOT NULL AS valid_json,
  CASE WHEN objects > 0 AND p_size IS NOT NULL THEN 'id,made,seen' ELSE '' END AS missing,
  CASE WHEN objects > 0 AND p_size IS NOT NULL THEN array_to_string(list_sort(keys), ',') ELSE '' END AS unexpected,
  '' AS mismatched, CASE WHEN p_size IS NULL OR objects = 0 THEN 0 ELSE 4 END::BIGINT AS n_fields, 0::BIGINT AS n_ok
FROM model LEFT JOIN known USING (repo)""")
def q_conformance_rows(spark, sf_dir):
    """G6 per model output: what is missing and what is unexpected against the schema that its id names."""
    _, sf, _, _, _ = _scan(spark, sf_dir)
    return GEN.check_conformance(_model_bodies(spark, sf_dir), R.expand_fields(sf).checkpoint()).select(
        "request_id", "valid_json", "missing", "unexpected", "mismatched", "n_fields", "n_ok")


def make_body_client():
    """Stand-in model that writes bodies: it never answers where a path value ends in 7, and its answers are
    fenced and have a trailing comma."""
    def client(system: str, prompt: str) -> str:
        if re.search(r"^  \w+ = .*7$", prompt, re.M):
            raise RuntimeError("no answer")
        return "```json\n{\"about\": " + json.dumps(prompt.split("\n")[2]) + ",}\n```"

    return client


@register("model_responses", f"""
WITH {_SCAN_CTES},
{_LINEITEM_MATCH},
s AS (SELECT r.*, CASE WHEN ok.request_id IS NULL THEN 501 WHEN r.path LIKE '%/parts/%7' THEN 502
                       ELSE ok.status_code END AS status FROM r LEFT JOIN ok USING (request_id))
SELECT status, CAST(count(*) AS BIGINT) AS responses,
  CAST(CASE WHEN status > 500 THEN 0 ELSE count(DISTINCT method || ' ' || path) END AS BIGINT) AS stored
FROM s GROUP BY status""")
def q_model_responses(spark, sf_dir):
    """G2, G4, F16, S4 and G7 in one flow: a prompt per request key, the model's cleaned answers kept in a store,
    every request answered from it, 502 rows where the model failed and 501 rows where nothing matched."""
    sf, _, _, _, eps, routes = _corpus_flow(spark, sf_dir, matched=True)
    req = _lineitem_requests(spark, sf_dir).withColumn("query", F.lit("")).withColumn("body", F.lit(""))
    m = M.match_requests(req, routes)
    m = m.withColumn("request_key", K.request_key("method", "path", "query", K.hash_body("body"))).checkpoint()
    matched = m.where(F.col("endpoint_path").isNotNull())
    once = matched.dropDuplicates(["request_key"])
    prompts = GEN.build_response_prompts(once, eps, R.expand_fields(sf)).select("request_key", "prompt")
    answers = GEN.batch_infer(prompts, make_body_client, max_retries=1, sleep=_no_sleep).select(
        "request_key", repair_json("response").alias("answer"), "error").checkpoint()
    path = shared_path(spark, "model-store")
    rows = once.join(answers.where(F.col("error").isNull()), "request_key").select(
        F.col("request_key").alias("key_hash"), "method", "path", "query", F.lit("").alias("request_body_hash"),
        F.col("status_code").alias("response_status"), F.lit(S.JSON_HEADERS).alias("response_headers"),
        F.col("answer").alias("response_body"), "dependency", F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    S.upsert_persisted(spark, path, rows)
    store = S.read_store(spark, path)
    answered = matched.join(store.select(F.col("key_hash").alias("request_key"), "response_status"), "request_key", "left")
    failed = answered.where(F.col("response_status").isNull())
    errors = GEN.error_responses(m.where(F.col("endpoint_path").isNull()), failed)
    out = answered.where(F.col("response_status").isNotNull()).select(
        "request_id", F.col("response_status").alias("status"), F.col("request_key").alias("key")).unionByName(
        errors.select("request_id", "status", F.lit(None).cast("string").alias("key")))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("responses"), F.countDistinct("key").alias("stored"))


@register("error_responses", f"""
WITH {O.match_cte()}
SELECT request_id, 501 AS status, '{{"Content-Type":"application/json"}}' AS headers,
  to_json({{'error': 'no matching endpoint', 'method': method, 'path': path}}) AS body
FROM matched WHERE endpoint_path IS NULL""")
def q_error_responses(spark, sf_dir):
    """Unmatched requests as 501 response rows."""
    ep, deps = D.fixture_registry(spark)
    m = M.match_requests(D.requests(spark, sf_dir), M.prepare_routes(ep, deps))
    return GEN.error_responses(m.where(F.col("endpoint_path").isNull()))


def _dated_requests(spark, sf_dir):
    li = D.table(spark, sf_dir, "lineitem")
    return (_lineitem_requests(spark, sf_dir)
            .join(li.select(lineitem_request_id().alias("request_id"),
                            F.col("l_shipdate").cast("timestamp").alias("ts"),
                            F.col("l_quantity").cast("double").alias("latency_ms")), "request_id")
            .withColumn("query", F.lit("")).withColumn("body", F.lit("")))


CUT, KEEP_DAYS = "1995-06-17 00:00:00", 400


@register("serve_batch_stored", f"""
WITH RECURSIVE {_SCAN_CTES}, {_LINEITEM_MATCH}, {_MATCHED},
mk AS (SELECT mr.*, r.ts FROM mr JOIN r USING (request_id)),
early AS (SELECT * FROM mk WHERE ts < TIMESTAMP '{CUT}'),
{ttl_cte('early', 'request_key', KEEP_DAYS * 86400 * 1_000_000, 'a')},
held AS (SELECT k, max(s) AS s FROM astarts GROUP BY k),
looked AS (SELECT mk.*, coalesce(epoch_us(ts) <= held.s + {KEEP_DAYS * 86400 * 1_000_000}, false) AS stored
           FROM mk LEFT JOIN held ON held.k = mk.request_key WHERE ts >= TIMESTAMP '{CUT}'),
rest AS (SELECT * FROM looked WHERE NOT stored),
{ttl_cte('rest', 'request_key', KEEP_DAYS * 86400 * 1_000_000, 'b')}
SELECT l.request_id, l.request_key, l.status_code AS status, l.stored OR d.hit AS hit,
  CASE WHEN stored THEN '{{"kept":' || {_body_sql()} || '}}' ELSE {_body_sql()} END AS body
FROM looked l LEFT JOIN bdedup d USING (request_id)
UNION ALL
SELECT request_id, NULL, 501, NULL, to_json({{'error': 'no matching endpoint', 'method': method, 'path': path}})
FROM r WHERE ts >= TIMESTAMP '{CUT}' AND request_id NOT IN (SELECT request_id FROM mk)""")
def q_serve_batch_stored(spark, sf_dir):
    """G8 against a filled store: earlier traffic fills it (bodies marked), later traffic is answered from its live
    entries, from new ones where it has none or an expired one, and with 501 rows."""
    sf, _, _, _, eps, routes = _corpus_flow(spark, sf_dir, matched=True)
    fields = _keep(R.expand_fields(sf), "expanded")
    req = _keep(_dated_requests(spark, sf_dir), "requests")
    early = F.col("ts") < F.lit(CUT).cast("timestamp")
    _, store = GEN.serve_batch(req.where(early), routes, eps, fields, ttl_seconds=KEEP_DAYS * 86400)
    path = shared_path(spark, "served-store")
    S.write_store(store.withColumn("response_body", F.concat(F.lit('{"kept":'), "response_body", F.lit("}"))), path)
    got, _ = GEN.serve_batch(req.where(~early), routes, eps, fields, S.read_store(spark, path), ttl_seconds=KEEP_DAYS * 86400)
    return got.select("request_id", "request_key", "status", "hit", "body")


@register("serve_batch", f"""
WITH RECURSIVE {_SCAN_CTES}, {_LINEITEM_MATCH},
mk AS (SELECT r.request_id, r.ts, r.method || '|' || r.path AS request_key, ok.status_code FROM r JOIN ok USING (request_id)),
{ttl_cte('mk', 'request_key', 30 * 86400 * 1_000_000)},
answered AS (SELECT mk.status_code AS status, d.hit FROM dedup d JOIN mk USING (request_id)
  UNION ALL SELECT 501, NULL FROM r WHERE request_id NOT IN (SELECT request_id FROM ok))
SELECT status, hit, CAST(count(*) AS BIGINT) AS responses, CAST(count(*) AS BIGINT) AS with_body,
  (SELECT CAST(count(DISTINCT request_key) AS BIGINT) FROM mk) AS store_entries FROM answered GROUP BY ALL""")
def q_serve_batch(spark, sf_dir):
    """The whole flow on lineitem traffic: responses by status and hit, plus store size."""
    sf, _, _, _, eps, routes = _corpus_flow(spark, sf_dir, matched=True)
    req = _keep(_dated_requests(spark, sf_dir), "requests")
    responses, store = GEN.serve_batch(req, routes, eps, R.expand_fields(sf), ttl_seconds=30 * 86400)
    summary = responses.groupBy("status", "hit").agg(F.count(F.lit(1)).alias("responses"),
                                                     F.count("body").alias("with_body"))
    n_store = store.agg(F.count(F.lit(1)).alias("n")).select(F.col("n").cast("long")).scalar()
    return summary.select("status", "hit", "responses", "with_body", n_store.alias("store_entries"))

