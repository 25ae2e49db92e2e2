"""Path functions (Column -> Column): normalisation, segments, prefixes, params.

All are built-in expressions (JVM side, no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_REST = 1 << 30  # "to the end of the string" for substr


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_path(p) -> Column:
    """'' and '/' -> '/'; add a leading '/'; strip every trailing '/'.

    Kept quirk: '//' becomes '' (all slashes are trailing).
    """
    p = F.coalesce(_col(p), F.lit(""))
    lead = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    return F.when((p == "") | (p == "/"), F.lit("/")).otherwise(
        F.regexp_replace(lead, "/+$", ""))


def normalize_param(seg) -> Column:
    """':id' -> '{id}'; anything else unchanged."""
    seg = _col(seg)
    return F.when(seg.startswith(":"),
                  F.concat(F.lit("{"), seg.substr(F.lit(2), F.lit(_REST)), F.lit("}"))
                  ).otherwise(seg)


def path_segments(p) -> Column:
    """Non-empty '/'-separated parts, so '/a//b' and '/a/b' are the same."""
    return F.filter(F.split(_col(p), "/"), lambda x: x != "")


def is_param_segment(x) -> Column:
    x = _col(x)
    return x.startswith("{") & x.endswith("}") & (F.length(x) >= 2)


def pattern_segments(p) -> Column:
    """Route pattern -> array<struct<value, is_param>> after ':x' -> '{x}'.

    A segment is a parameter iff it starts with '{' and ends with '}';
    '{id}.json' and '*rest' stay literals, '{id:[0-9]+}' is a parameter named
    'id:[0-9]+'.
    """
    def seg(x):
        n = normalize_param(x)
        par = is_param_segment(n)
        return F.struct(
            F.when(par, n.substr(F.lit(2), F.length(n) - 2)).otherwise(n).alias("value"),
            par.alias("is_param"))
    return F.transform(path_segments(normalize_path(p)), seg)


def strip_prefix(np, prefix) -> Column:
    """Raw character prefix strip of a normalised path; '' -> '/', re-add '/'."""
    np, prefix = _col(np), _col(prefix)
    rest = np.substr(F.length(prefix) + 1, F.lit(_REST))
    return (F.when(rest == "", F.lit("/"))
            .when(rest.startswith("/"), rest)
            .otherwise(F.concat(F.lit("/"), rest)))


def params_from_segments(pattern_segs, segs) -> Column:
    """Key-sorted array<struct<key, value>> of parameter positions.

    A repeated parameter name keeps its last value.  Kept as entries rather
    than a MAP so that it never raises on duplicate keys; ``map_from_entries``
    turns it into a MAP where one is wanted.
    """
    pattern_segs, segs = _col(pattern_segs), _col(segs)
    pairs = F.filter(
        F.zip_with(pattern_segs, segs, lambda p, s: F.struct(
            p["value"].alias("key"), s.alias("value"), p["is_param"].alias("is_param"))),
        lambda e: e["is_param"])
    kv = F.transform(pairs, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    last_wins = F.filter(kv, lambda e, i: ~F.exists(
        F.slice(kv, i + 2, F.greatest(F.size(kv), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.array_sort(last_wins)


def params_to_string(entries) -> Column:
    """Canonical text of key-sorted entries: 'k1=v1&k2=v2' ('' when none)."""
    return F.array_join(
        F.transform(_col(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
