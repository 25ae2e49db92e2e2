"""Request keys, query parsing and expiry (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_REST = 1 << 30


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def query_pairs(query) -> Column:
    """Decoded (key, value) pairs of a raw query string, in order.

    Splits on '&'; empty parts and parts with ';' are dropped; a pair splits on
    its first '='; '+' and %XX are decoded; a pair that fails to decode is
    dropped.
    """
    q = F.coalesce(_col(query), F.lit(""))
    parts = F.filter(F.split(q, "&"), lambda p: (p != "") & ~p.contains(";"))
    kv = F.transform(parts, lambda p: F.struct(
        F.try_url_decode(F.substring_index(p, "=", 1)).alias("key"),
        F.try_url_decode(F.when(p.contains("="), p.substr(F.instr(p, "=") + 1, F.lit(_REST)))
                         .otherwise(F.lit(""))).alias("value")))
    return F.filter(kv, lambda e: e["key"].isNotNull() & e["value"].isNotNull())


def query_to_map(query) -> Column:
    """key-sorted entries; a repeated key's values are joined by ',' in order."""
    kv = query_pairs(query)
    keys = F.array_sort(F.array_distinct(F.transform(kv, lambda e: e["key"])))
    return F.transform(keys, lambda k: F.struct(
        k.alias("key"),
        F.array_join(F.transform(F.filter(kv, lambda e: e["key"] == k), lambda e: e["value"]), ",")
        .alias("value")))


def hash_body(body) -> Column:
    """'' for an empty or NULL body, else lower-hex SHA-256."""
    b = _col(body)
    return F.when(b.isNull() | (b == ""), F.lit("")).otherwise(F.sha2(b, 256))


def request_key(method, path, query, body_hash) -> Column:
    """F8: SHA-256 of method|path|query|body_hash over the raw (not normalised) values."""
    parts = [F.coalesce(_col(c), F.lit("")) for c in (method, path, query, body_hash)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def canonical_query(query) -> Column:
    """F8b option: query pairs sorted as raw text."""
    q = F.coalesce(_col(query), F.lit(""))
    return F.array_join(F.array_sort(F.filter(F.split(q, "&"), lambda p: p != "")), "&")


def canonical_body(body) -> Column:
    """F8b option: JSON bodies re-serialised (sorted keys, no spaces); others unchanged."""
    b = _col(body)
    return F.coalesce(F.to_json(F.try_parse_json(b)), b)


def canonical_request_key(method, path, query, body) -> Column:
    return request_key(method, path, canonical_query(query), hash_body(canonical_body(body)))


def is_live(expires_at, now) -> Column:
    """no expiry, or now not after expiry (live at the expiry instant)."""
    e, n = _col(expires_at), _col(now)
    return e.isNull() | ~(n > e)


def stamp_expiry(created_at, expires_at, ttl_seconds) -> Column:
    """explicit expiry kept; else created_at + ttl when ttl > 0; else NULL (never)."""
    c, e = _col(created_at), _col(expires_at)
    ttl = ttl_seconds if isinstance(ttl_seconds, Column) else F.lit(ttl_seconds)
    later = F.timestamp_micros(F.unix_micros(c) + ttl.cast("long") * F.lit(1_000_000))
    return F.coalesce(e, F.when(ttl > 0, later))
