"""Request flow pieces shared by the store, KPI and generation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.keys import hash_body, request_key
from trafficlens.operators.match import match_requests
from trafficlens.operators.ttl import ttl_dedup
from trafficlens.session import stored


def with_keys(df: DataFrame) -> DataFrame:
    """F7 + F8: body hash and request key from the raw method, path, query, body."""
    bh = hash_body(F.col("body"))
    return df.withColumn("body_hash", bh).withColumn(
        "request_key", request_key(F.col("method"), F.col("path"), F.col("query"), F.col("body_hash")))


def match_keyed(requests: DataFrame, routes: DataFrame, match_strategy: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(matched requests with their keys, unmatched requests), from one stored matching."""
    # matched requests feed the dedup, the attach join and the unmatched rows
    m = stored(match_requests(requests, routes, strategy=match_strategy), "matched")[0]
    return with_keys(m.where(F.col("endpoint_path").isNotNull())), m.where(F.col("endpoint_path").isNull())


def serve_flags(requests: DataFrame, routes: DataFrame, ttl_seconds: float | None = 86400,
                match_strategy: str = "auto", dedup_strategy: str = "auto") -> DataFrame:
    """Match every request, then decide hit/miss per key for the matched ones.

    Unmatched requests never reach the store (match precedes lookup): their
    ``hit`` and ``request_key`` are NULL and their status is 501.
    """
    matched, missed = match_keyed(requests, routes, match_strategy)
    flagged = ttl_dedup(matched, "request_key", ts="ts", id_col="request_id",
                        ttl_seconds=ttl_seconds, strategy=dedup_strategy)
    unmatched = (missed.withColumn("body_hash", F.lit(None).cast("string"))
                 .withColumn("request_key", F.lit(None).cast("string"))
                 .withColumn("hit", F.lit(None).cast("boolean"))
                 .withColumn("entry_created_at", F.lit(None).cast("timestamp")))
    out = flagged.unionByName(unmatched)
    return out.withColumn("status", F.coalesce(F.col("status_code"), F.lit(501)))
