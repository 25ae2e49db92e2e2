"""Column functions over Go source text (types, tags, route patterns, status codes).

They work on the texts of types, tags and call arguments that one pass over a
file finds (``goscan``), whatever lines those span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The HTTP verbs accepted in route registrations.
HTTP_VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]

# Named status constants understood in handler bodies.
STATUS_CONSTANTS = {
    "StatusOK": 200,
    "StatusCreated": 201,
    "StatusAccepted": 202,
    "StatusNoContent": 204,
    "StatusBadRequest": 400,
    "StatusUnauthorized": 401,
    "StatusForbidden": 403,
    "StatusNotFound": 404,
    "StatusConflict": 409,
    "StatusInternalServerError": 500,
    "StatusServiceUnavailable": 503,
}

# Call names that read a request body / write a response body.
DECODE_CALLS = ["Decode", "Unmarshal", "Bind", "ShouldBindJSON", "BindJSON", "ShouldBind"]
ENCODE_CALLS = ["Encode", "Marshal", "JSON", "Render", "JSONP"]

IDENT = "[A-Za-z_][A-Za-z0-9_]*"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim spaces and tabs (``trim`` alone removes spaces only)."""
    return F.regexp_replace(_col(c), "^[ \\t]+|[ \\t]+$", "")


def let(value, body) -> Column:
    """``body(value)`` with the value made once: inside a lambda, Spark makes an expression as often as it is written."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# A type that is rendered as it stands.
_PLAIN = rf"^(?:[*]|\[\]|\.\.\.)*(?!(?:chan|func|struct)\z){IDENT}(?:\.{IDENT})*\z"


def type_text(t) -> Column:
    """Render a source type the way the extractor reports it.

    Identifiers, qualified names, pointers, slices, maps, variadics and
    interface types are kept (fixed-size arrays render as ``[]T``); a function,
    channel, inline struct or generic type becomes ``unknown``, also behind
    pointers, slices and maps (``[]unknown``).
    """
    before = r"^((?:[*] *|\[\] *|\.\.\. *|map\[[^\[\]]*\])*)"

    def rendered(c):
        named = lambda core: core.rlike(rf"^{IDENT}(\.{IDENT})*$") & ~core.isin("chan", "func", "struct")
        return F.concat(F.regexp_replace(F.regexp_extract(c, before, 1), " ", ""),
                        let(F.regexp_replace(c, before, ""), lambda core: F.when(
                            named(core) | (core == "interface{}"), core).otherwise(F.lit("unknown"))))

    def full(t):
        t = F.regexp_replace(strip(t), "\\s+", " ")
        arrays = F.regexp_replace(t, "(^|[*\\]])\\[[^\\]]+\\]", "$1[]")
        iface = F.regexp_replace(arrays, "interface ?\\{[^}]*\\}", "interface{}")
        return let(F.regexp_replace(iface, "map\\[ *([^\\]]*?) *\\] *", "map[$1]"), rendered)

    return let(_col(t), lambda t: F.when(t.rlike(_PLAIN), t).otherwise(full(t)))


def parse_json_tag(tag) -> Column:
    """struct<key, omitempty> from a raw struct tag (with or without back-quotes)."""
    tag = _col(tag)
    has = F.coalesce(tag, F.lit("")).rlike('json:"[^"]*"')
    val = F.regexp_extract(F.coalesce(tag, F.lit("")), 'json:"([^"]*)"', 1)
    parts = F.split(val, ",")
    key = F.get(parts, 0)
    omit = F.exists(F.slice(parts, 2, 1 << 20), lambda p: strip(p) == "omitempty")
    return F.struct(
        F.when(has, key).otherwise(F.lit("")).alias("key"),
        F.when(has & (key != "-"), omit).otherwise(F.lit(False)).alias("omitempty"))


def parse_route_pattern(s) -> Column:
    """'GET /x' -> struct(method 'GET', path '/x'); NULL method when not of that form."""
    t = F.trim(_col(s))
    has_space = F.instr(t, " ") > 0
    head = F.upper(F.trim(F.substring_index(t, " ", 1)))
    rest = F.trim(t.substr(F.instr(t, " ") + 1, F.lit(1 << 30)))
    ok = has_space & head.isin(*HTTP_VERBS)
    return F.struct(F.when(ok, head).alias("method"), F.when(ok, rest).alias("path"))


def status_code(expr) -> Column:
    """integer literal, or a named http status constant; 0 otherwise."""
    e = strip(expr)
    name = F.regexp_extract(e, f"^[\\w.]+\\.({IDENT})$", 1)
    consts = F.create_map(*[x for k, v in STATUS_CONSTANTS.items() for x in (F.lit(k), F.lit(v))])
    lit = F.when(e.rlike("^[0-9]+$"), F.coalesce(e.try_cast("int"), F.lit(0)))
    return F.coalesce(lit, F.when(name != "", consts[name]), F.lit(0))


def type_ref(t) -> Column:
    """struct<pkg, name, is_array> used to look a type up among structs."""
    t = _col(t)
    is_array = t.rlike("^[*]*(\\[\\]|\\.\\.\\.)")
    base = F.regexp_replace(t, "^([*]|\\[\\]|\\.\\.\\.)+", "")
    qualified = base.contains(".")
    return F.struct(
        F.when(qualified, F.substring_index(base, ".", 1)).otherwise(F.lit("")).alias("pkg"),
        F.when(qualified, F.substring_index(base, ".", -1)).otherwise(base).alias("name"),
        is_array.alias("is_array"))


def map_source_type(t) -> Column:
    """struct<json_type, format, item_type, nullable> for a rendered source type."""
    t = _col(t)
    nullable = t.startswith("*")
    base = F.regexp_replace(t, "^[*]+", "")
    is_arr = base.startswith("[]") | base.startswith("...")
    elem = F.regexp_replace(base, "^(\\[\\]|\\.\\.\\.)[*]*", "")

    def scalar(x):
        return (F.when(x == "string", "string")
                .when(x.rlike("^u?int(8|16|32|64)?$") | (x == "byte") | (x == "rune") | (x == "uintptr"), "integer")
                .when(x.rlike("^float(32|64)$"), "number")
                .when(x == "bool", "boolean")
                .when(x.isin("time.Time", "uuid.UUID"), "string")
                .when(x.isin("json.RawMessage", "interface{}", "any"), "any")
                .when(x.startswith("map["), "object")
                .when(x == "unknown", "any")
                .otherwise("ref"))

    fmt = lambda x: F.when(x == "time.Time", "date-time").when(x == "uuid.UUID", "uuid")
    return F.struct(
        F.when(is_arr & (elem == "byte"), F.lit("string")).when(is_arr, F.lit("array"))
        .otherwise(scalar(base)).alias("json_type"),
        F.when(is_arr, F.lit(None).cast("string")).otherwise(fmt(base)).alias("format"),
        F.when(is_arr & (elem != "byte"), scalar(elem)).alias("item_type"),
        nullable.alias("nullable"))


def handler_name(arg) -> Column:
    """Route handler argument: dotted name as written, '<anonymous>' for a func literal, '<unknown>' for anything
    else; a field of anything else keeps the field's name ('<unknown>.Name')."""
    a = strip(arg)
    field = F.regexp_extract(a, rf"(?s)^[^\s+\-/<>=|&]*[)\]}}]((?:\.{IDENT})+)$", 1)
    return (F.when(a.rlike(f"^{IDENT}(\\.{IDENT})*$"), a)
            .when(a.rlike(r"(?s)^func\s*\(.*\}$"), F.lit("<anonymous>"))
            .otherwise(F.concat(F.lit("<unknown>"), field)))


# A composite literal, as a whole: its type, braces to the end.
_LITERAL = r"(?s)^((?:interface ?\{\}|struct ?\{\}|[A-Za-z0-9_.*\[\] ])+?)\s*\{.*\}$"


def literal_type(value) -> Column:
    """The rendered type of ``T{...}`` or of a sign before it (``&T{...}``); NULL for anything else."""
    v = F.regexp_replace(strip(value), r"^[&!+\-^]\s*", "")
    return F.when(v.rlike(_LITERAL) & ~v.rlike(r"^func\s*\("), type_text(F.regexp_extract(v, _LITERAL, 1)))
