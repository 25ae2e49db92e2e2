"""Explicit schemas for every table the engine reads or writes (never inferred)."""

from pyspark.sql import types as T

S, I, L, B, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


DEPENDENCIES = _st(("name", S), ("prefix", S), ("repo", S), ("scan_paths", T.ArrayType(S)))

ENDPOINTS = _st(("dependency", S), ("ord", I), ("method", S), ("path", S), ("description", S),
                ("request_type", S), ("response_type", S), ("body_type", S), ("status_code", I))

SCHEMA_FIELDS = _st(("dependency", S), ("root", S), ("field_path", S), ("depth", I), ("pos", I),
                    ("name", S), ("json_key", S), ("json_type", S), ("format", S), ("item_type", S),
                    ("required", B), ("nullable", B), ("enum", T.ArrayType(S)))

SOURCE_FILES = _st(("repo", S), ("path", S), ("content", S))

REQUESTS = _st(("request_id", L), ("ts", TS), ("user_id", L), ("method", S), ("path", S),
               ("query", S), ("body", S), ("latency_ms", D))

RESPONSE_STORE = _st(("key_hash", S), ("method", S), ("path", S), ("query", S),
                     ("request_body_hash", S), ("response_status", I), ("response_headers", S),
                     ("response_body", S), ("dependency", S), ("created_at", TS), ("expires_at", TS))

RAW_OUTPUTS = _st(("output_id", L), ("raw", S))

# Registry document as persisted (JSON array of registries).  Bodies are kept
# as flat field lists (one element per field path) because Spark has no
# recursive struct type.
FIELD_DOC = _st(("field_path", S), ("depth", I), ("name", S), ("json_key", S), ("type", S),
                ("format", S), ("required", B), ("item_type", S), ("nullable", B))
BODY_DOC = _st(("type", S), ("struct", S), ("dir", S), ("package", S), ("fields", T.ArrayType(FIELD_DOC)))
ENDPOINT_DOC = _st(("method", S), ("path", S), ("description", S), ("request_body", BODY_DOC),
                   ("response_body", BODY_DOC), ("status_code", I))
REGISTRY_DOC = _st(("scanned_at", TS), ("dependency", S), ("repo_path", S),
                   ("framework_detected", S), ("endpoints", T.ArrayType(ENDPOINT_DOC)))
