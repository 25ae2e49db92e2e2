"""Registered queries: JSON repair and endpoint parsing of model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.functions.jsonfix import repair_json, strip_fences
from trafficlens.operators.analysis import parse_endpoints
from trafficlens.plans import oracle_sql as O
from trafficlens.plans.catalog import register
from trafficlens.sources import derived as D

_TRIM = "[ \\t\\n\\x0B\\f\\r]"


def trim_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_TRIM}+', ''), '{_TRIM}+$', '')"


def _cut(t: str, fence: str) -> str:
    rest = f"substr({t}, strpos({t}, '{fence}') + {len(fence)})"
    return f"(CASE WHEN contains({rest}, '```') THEN regexp_extract({rest}, '(?s)^(.*)```', 1) ELSE {rest} END)"


def strip_sql(x: str) -> str:
    t = trim_sql(x)
    return trim_sql(f"(CASE WHEN contains({t}, '```json') THEN {_cut(t, '```json')} "
                    f"WHEN contains({t}, '```') THEN {_cut(t, '```')} ELSE {t} END)")


def repair_sql(x: str) -> str:
    return f"regexp_replace({strip_sql(x)}, ',[ \\t\\n\\f\\r]*([}}\\]])', '\\1', 'g')"


_CLEAN = f"SELECT output_id, {repair_sql('raw')} AS c FROM ({O.RAW_OUTPUTS})"


@register("repair_json", f"""
SELECT output_id, {strip_sql('raw')} AS stripped, {repair_sql('raw')} AS repaired FROM ({O.RAW_OUTPUTS})""")
def q_repair(spark, sf_dir):
    """F16 + F17 over every model output."""
    r = D.raw_outputs(spark, sf_dir)
    return r.select("output_id", strip_fences("raw").alias("stripped"), repair_json("raw").alias("repaired"))


@register("parse_endpoints", f"""
WITH cl AS ({_CLEAN}),
ok AS (SELECT output_id, from_json(c, '[{{"method":"VARCHAR","path":"VARCHAR","description":"VARCHAR",
  "request_body":"JSON","response_body":"JSON","status_code":"INTEGER"}}]') AS arr
  FROM cl WHERE coalesce(CASE WHEN json_valid(c) AND json_type(c) = 'ARRAY' THEN json_array_length(c) > 0 END, false)),
ex AS (SELECT output_id, unnest(list_transform(arr, lambda e, i: {{'pos': i - 1, 'e': e}})) AS x FROM ok)
SELECT output_id, CAST(x.pos AS INTEGER) AS pos, coalesce(x.e.method, '') AS method, coalesce(x.e.path, '') AS path,
  coalesce(x.e.description, '') AS description, coalesce(x.e.status_code, 0) AS status_code,
  coalesce(x.e.request_body IS NOT NULL AND CAST(x.e.request_body AS VARCHAR) <> 'null', false) AS has_request_body,
  coalesce(x.e.response_body IS NOT NULL AND CAST(x.e.response_body AS VARCHAR) <> 'null', false)
    AS has_response_body
FROM ex""")
def q_parse_endpoints(spark, sf_dir):
    """G1: endpoint rows from the valid, non-empty outputs."""
    good, _ = parse_endpoints(D.raw_outputs(spark, sf_dir))
    return good


@register("parse_endpoints_quarantine", f"""
WITH cl AS ({_CLEAN})
SELECT output_id, CASE WHEN (CASE WHEN json_valid(c) THEN json_type(c) END) = 'ARRAY' THEN 'empty_array' ELSE 'invalid_json' END
  AS error
FROM cl WHERE NOT (coalesce(CASE WHEN json_valid(c) AND json_type(c) = 'ARRAY' THEN json_array_length(c) > 0 END, false))""")
def q_parse_quarantine(spark, sf_dir):
    """G1 failures: invalid JSON and empty arrays."""
    _, bad = parse_endpoints(D.raw_outputs(spark, sf_dir))
    return bad.select("output_id", F.col("error"))
