"""Registered queries: source corpus extraction and the endpoint registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.functions import gosrc as G
from trafficlens.functions.paths import params_to_string
from trafficlens.operators import extract as X
from trafficlens.operators import match as M
from trafficlens.operators import registry as R
from trafficlens.plans import oracle_sql as O
from trafficlens.plans.catalog import register
from trafficlens.session import shared_path, stored
from trafficlens.sources import derived as D

DECL = "^(func|type|var|const|import|package)([^A-Za-z0-9_]|$)"
IDENT = "[A-Za-z_][A-Za-z0-9_]*"

# ---------------------------------------------------------------- oracle text
_KEEP = ("ends_with(path, '.go') AND NOT ends_with(path, '_test.go') AND len(list_filter("
         "string_split(path, '/')[1:-2], lambda d: d = 'vendor' OR starts_with(d, '.'))) = 0")


def lines_cte(keep: str = _KEEP) -> str:
    return f"""
files AS ({O.SOURCE_FILES}),
kept AS (SELECT * FROM files WHERE {keep}),
lines0 AS (SELECT repo, path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line,
  unnest(string_split(content, chr(10))) AS raw FROM kept),
cl AS (SELECT repo, path, CAST(line AS INTEGER) AS line,
  rtrim(regexp_replace(CASE WHEN starts_with(regexp_replace(raw, '^[ \\t]+', ''), '//') THEN '' ELSE raw END,
                       '\\s+//[^"`]*$', '')) AS text FROM lines0),
blk AS (SELECT *,
  CAST(sum(CASE WHEN regexp_matches(text, '{DECL}') THEN 1 ELSE 0 END) OVER w AS BIGINT) AS block,
  last_value(CASE WHEN regexp_matches(text, '{DECL}') THEN text END IGNORE NULLS) OVER w AS header,
  max(CASE WHEN regexp_matches(text, '^package\\s+') THEN regexp_extract(text, '^package\\s+({IDENT})', 1) END)
    OVER (PARTITION BY repo, path) AS package
  FROM cl WINDOW w AS (PARTITION BY repo, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


_IMPORTS = f"""
imp AS (SELECT repo, path, line, regexp_extract(text, '"([^"]+)"', 1) AS import FROM blk
  WHERE starts_with(header, 'import')
    AND (regexp_matches(text, '^import\\s+({IDENT}\\s+|[._]\\s+)?"') OR regexp_matches(text, '^\\s+({IDENT}\\s+|[._]\\s+)?"'))
    AND regexp_extract(text, '"([^"]+)"', 1) <> ''),
imports AS (SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo, path ORDER BY line) - 1 AS INTEGER) AS pos,
  import FROM imp),
fwmap AS (SELECT * FROM (VALUES ('github.com/go-chi/chi', 'chi'), ('github.com/go-chi/chi/v5', 'chi'),
  ('github.com/gin-gonic/gin', 'gin'), ('github.com/labstack/echo', 'echo'),
  ('github.com/labstack/echo/v4', 'echo'), ('github.com/gorilla/mux', 'gorilla')) t(import, fw))"""

_FIELDS = f"""
fl AS (SELECT repo, path, package, regexp_extract(header, '^type\\s+({IDENT})\\s+struct\\s*\\{{\\s*$', 1) AS struct,
  line, regexp_replace(text, '^[ \\t]+|[ \\t]+$', '', 'g') AS content FROM blk
  WHERE regexp_extract(header, '^type\\s+({IDENT})\\s+struct\\s*\\{{\\s*$', 1) <> ''
    AND regexp_matches(text, '^\\t[^\\t}}]') AND NOT starts_with(text, 'type ')),
fp AS (SELECT *, regexp_extract(content, '(`[^`]*`)$', 1) AS tag,
  regexp_replace(regexp_replace(content, '`[^`]*`$', ''), '^[ \\t]+|[ \\t]+$', '', 'g') AS decl FROM fl),
fn AS (SELECT *, regexp_extract(decl, '^({IDENT}(\\s*,\\s*{IDENT})*)\\s+(\\S.*)$', 1) AS names,
  regexp_extract(decl, '^({IDENT}(\\s*,\\s*{IDENT})*)\\s+(\\S.*)$', 3) AS ntype,
  regexp_extract(tag, 'json:"([^"]*)"', 1) AS jt, regexp_matches(tag, 'json:"[^"]*"') AS has_jt FROM fp),
fx AS (
  SELECT repo, path, package, struct, line, CAST(i - 1 AS INTEGER) AS i, nm AS field, ntype AS type, jt, has_jt
  FROM (SELECT *, unnest(string_split_regex(names, '\\s*,\\s*')) AS nm,
               unnest(range(1, len(string_split_regex(names, '\\s*,\\s*')) + 1)) AS i FROM fn WHERE names <> '')
  WHERE regexp_matches(nm, '^[A-Z]')
  UNION ALL
  SELECT repo, path, package, struct, line, 0, decl, decl, jt, has_jt FROM fn WHERE names = ''),
struct_fields AS (SELECT repo, path, package, struct,
  CAST(row_number() OVER (PARTITION BY repo, path, struct ORDER BY line, i) - 1 AS INTEGER) AS pos, field, type,
  CASE WHEN NOT has_jt THEN (CASE WHEN field <> type OR i > 0 OR regexp_matches(type, '^[a-z]') THEN lower(field) ELSE '' END)
       WHEN split_part(jt, ',', 1) = '' AND NOT (field = type AND i = 0) THEN lower(field)
       ELSE split_part(jt, ',', 1) END AS json_tag,
  coalesce(has_jt AND split_part(jt, ',', 1) <> '-' AND
           list_contains(list_transform(string_split(jt, ',')[2:], lambda p: trim(p)), 'omitempty'), false) AS omitempty
  FROM fx)"""

_ROUTES = f"""
calls AS (SELECT repo, path, line, regexp_extract(text, '\\.({IDENT})\\((.*)\\)', 1) AS name,
  regexp_extract(text, '\\.({IDENT})\\((.*)\\)', 2) AS args FROM blk WHERE regexp_matches(text, '\\.({IDENT})\\((.*)\\)')),
ca AS (SELECT *, trim(split_part(args, ',', 1)) AS a1, trim(split_part(args, ',', 2)) AS a2 FROM calls
  WHERE len(string_split(args, ',')) >= 2
    AND (upper(name) IN ('GET','POST','PUT','DELETE','PATCH','HEAD','OPTIONS') OR name IN ('HandleFunc', 'Handle'))),
cr AS (SELECT *, CASE WHEN regexp_matches(a1, '^"[^"]*"$') THEN trim(a1, '"') ELSE '' END AS lit,
  CASE WHEN regexp_matches(a2, '^{IDENT}(\\.{IDENT})*$') THEN a2 WHEN regexp_matches(a2, '^func\\s*\\(') THEN '<anonymous>'
       ELSE '<unknown>' END AS handler FROM ca),
routes AS (SELECT repo, path, line,
  CASE WHEN upper(name) IN ('GET','POST','PUT','DELETE','PATCH','HEAD','OPTIONS') THEN upper(name)
       WHEN position(' ' IN trim(lit)) > 0
            AND upper(split_part(trim(lit), ' ', 1)) IN ('GET','POST','PUT','DELETE','PATCH','HEAD','OPTIONS')
       THEN upper(split_part(trim(lit), ' ', 1)) ELSE 'ANY' END AS method,
  CASE WHEN upper(name) IN ('GET','POST','PUT','DELETE','PATCH','HEAD','OPTIONS') THEN lit
       WHEN position(' ' IN trim(lit)) > 0
            AND upper(split_part(trim(lit), ' ', 1)) IN ('GET','POST','PUT','DELETE','PATCH','HEAD','OPTIONS')
       THEN trim(substr(trim(lit), position(' ' IN trim(lit)) + 1)) ELSE lit END AS route, handler
  FROM cr WHERE lit <> '')"""


_HANDLERS = f"""
hd AS (SELECT repo, path, block, package, regexp_extract(text, '^func\\s*(\\(\\s*({IDENT}\\s+)?([^)]*)\\))?\\s*({IDENT})\\s*\\(([^)]*)\\)', 4) AS name,
  regexp_extract(text, '^func\\s*(\\(\\s*({IDENT}\\s+)?([^)]*)\\))?\\s*({IDENT})\\s*\\(([^)]*)\\)', 3) AS recv,
  regexp_extract(text, '^func\\s*(\\(\\s*({IDENT}\\s+)?([^)]*)\\))?\\s*({IDENT})\\s*\\(([^)]*)\\)', 5) AS params
  FROM blk WHERE text = header AND regexp_matches(text, '^func')),
h AS (SELECT * FROM hd WHERE regexp_matches(name, '^[A-Z]') AND regexp_matches(params, 'ResponseWriter|Request|Context')),
body AS (SELECT blk.* FROM blk SEMI JOIN h USING (repo, path, block)),
lt AS (SELECT repo, path, block, regexp_extract(text, '^\\s*var\\s+({IDENT})\\s+(\\S+)', 1) AS var,
         regexp_extract(text, '^\\s*var\\s+({IDENT})\\s+(\\S+)', 2) AS type, line FROM body
       WHERE regexp_matches(text, '^\\s*var\\s+{IDENT}\\s+\\S+$')
       UNION ALL
       SELECT repo, path, block, regexp_extract(text, '^\\s*({IDENT})\\s*:?=\\s*&?([A-Za-z0-9_.*\\[\\]]+)\\s*\\{{', 1),
         regexp_extract(text, '^\\s*({IDENT})\\s*:?=\\s*&?([A-Za-z0-9_.*\\[\\]]+)\\s*\\{{', 2), line FROM body
       WHERE regexp_matches(text, '^\\s*({IDENT})\\s*:?=\\s*&?([A-Za-z0-9_.*\\[\\]]+)\\s*\\{{')),
ltl AS (SELECT repo, path, block, var, arg_max(type, line) AS type FROM lt GROUP BY ALL),
cc AS (SELECT repo, path, block, line, regexp_extract(text, '\\.(Decode|Encode|WriteHeader)\\(([^()]*)\\)', 1) AS name,
  trim(regexp_extract(text, '\\.(Decode|Encode|WriteHeader)\\(([^()]*)\\)', 2)) AS arg FROM body
  WHERE regexp_matches(text, '\\.(Decode|Encode|WriteHeader)\\(')),
hcr AS (SELECT cc.*, coalesce(ltl.type, ltrim(arg, '&')) AS resolved FROM cc
  LEFT JOIN ltl ON ltl.repo = cc.repo AND ltl.path = cc.path AND ltl.block = cc.block AND ltl.var = ltrim(cc.arg, '&')),
agg AS (SELECT repo, path, block,
  coalesce(arg_max(resolved, line) FILTER (WHERE name = 'Decode'), '') AS decodes,
  coalesce(arg_max(resolved, line) FILTER (WHERE name = 'Encode'), '') AS encodes,
  coalesce(string_agg(CAST(CASE WHEN regexp_matches(arg, '^[0-9]+$') THEN CAST(arg AS INTEGER)
                                WHEN arg = 'http.StatusOK' THEN 200 WHEN arg = 'http.StatusCreated' THEN 201 END AS VARCHAR),
                      ',' ORDER BY line) FILTER (WHERE name = 'WriteHeader'), '') AS status_codes
  FROM hcr GROUP BY ALL),
handlers AS (SELECT h.repo, h.path, h.block, h.package, h.name, regexp_replace(h.recv, '^\\s+|\\s+$', '', 'g') AS receiver,
  coalesce(agg.decodes, '') AS decodes, coalesce(agg.encodes, '') AS encodes,
  coalesce(agg.status_codes, '') AS status_codes FROM h LEFT JOIN agg USING (repo, path, block))"""


# ---------------------------------------------------------------- spark side
def _files(spark, sf_dir):
    return D.source_files(spark, sf_dir)


def _blocks(spark, sf_dir):
    return X.file_blocks(X.scan_filter(_files(spark, sf_dir)))


def _import_blocks(spark, sf_dir):
    return X.file_blocks(X.scan_filter(_files(spark, sf_dir), for_imports=True))


def _scanned(spark, sf_dir, finds="all"):
    return X.scan_source(X.scan_filter(_files(spark, sf_dir)), finds)


def _keep(df, name):
    """``df`` stored.  No join broadcasts it: the size of its files says little of its rows in memory."""
    return stored(df, name)[0].hint("merge")


def _scan(spark, sf_dir):
    """Scan outputs, each stored once in the shared checkpoint folder
    (they feed several joins; without this every consumer re-runs extraction)."""
    b = _keep(_scanned(spark, sf_dir), "scan")
    sf = _keep(X.extract_struct_fields(b), "fields")
    rt = _keep(X.extract_routes(b), "routes")
    hd = _keep(X.collect_handler_calls(b), "handlers")
    fw = _keep(X.detect_framework(X.extract_imports(_import_blocks(spark, sf_dir)), _files(spark, sf_dir)), "frameworks")
    return b, sf, rt, hd, fw


@register("source_corpus", f"""
WITH files AS ({O.SOURCE_FILES})
SELECT repo, path, CAST(len(string_split(content, chr(10))) AS INTEGER) AS n_lines,
  CAST(length(content) AS INTEGER) AS n_chars FROM files WHERE {_KEEP}""")
def q_source_corpus(spark, sf_dir):
    """The scanned file set (test, vendor and hidden files dropped)."""
    f = X.scan_filter(_files(spark, sf_dir))
    return f.select("repo", "path", F.size(F.split("content", "\n")).alias("n_lines"),
                    F.length("content").alias("n_chars"))


@register("source_blocks", f"WITH {lines_cte()} SELECT repo, path, line, block, header FROM blk")
def q_source_blocks(spark, sf_dir):
    """Every line with its top-level declaration block."""
    return _blocks(spark, sf_dir).select("repo", "path", "line", F.col("block").cast("long").alias("block"), "header")


@register("imports", f"WITH {lines_cte('ends_with(path, \'.go\')')}, {_IMPORTS} SELECT * FROM imports")
def q_imports(spark, sf_dir):
    """Imports of every .go file (test and vendor files included)."""
    return X.extract_imports(_import_blocks(spark, sf_dir))


@register("detect_framework", f"""
WITH {lines_cte("ends_with(path, '.go')")}, {_IMPORTS},
c AS (SELECT repo, coalesce(fwmap.fw, CASE WHEN imports.import = 'net/http' THEN 'stdlib' END) AS fw, count(*) AS n
      FROM imports LEFT JOIN fwmap USING (import)
      GROUP BY ALL HAVING fw IS NOT NULL),
b AS (SELECT repo, arg_min(fw, (-n, fw)) FILTER (WHERE fw <> 'stdlib') AS best,
      max(n) FILTER (WHERE fw = 'stdlib') AS std FROM c GROUP BY repo)
SELECT repo, coalesce(best, CASE WHEN std > 0 THEN 'stdlib' END, 'unknown') AS framework
FROM (SELECT DISTINCT repo FROM files) LEFT JOIN b USING (repo)""")
def q_detect_framework(spark, sf_dir):
    """A1: framework per repo by import counts."""
    return X.detect_framework(X.extract_imports(_import_blocks(spark, sf_dir)), _files(spark, sf_dir))


@register("framework_from_imports", f"""
WITH {lines_cte("ends_with(path, '.go')")}, {_IMPORTS}
SELECT repo, path, coalesce(arg_min(fwmap.fw, pos) FILTER (WHERE fwmap.fw IS NOT NULL),
  CASE WHEN bool_or(imports.import = 'net/http') THEN 'stdlib' END, 'unknown') AS framework
FROM imports LEFT JOIN fwmap USING (import) GROUP BY repo, path""")
def q_framework_from_imports(spark, sf_dir):
    """Framework per file by first known import."""
    return X.framework_from_imports(X.extract_imports(_import_blocks(spark, sf_dir)))


@register("struct_fields", f"WITH {lines_cte()}, {_FIELDS} SELECT * FROM struct_fields")
def q_struct_fields(spark, sf_dir):
    """X2 (+F12): exported struct fields with JSON tags."""
    return X.extract_struct_fields(_scanned(spark, sf_dir, "types"))


@register("routes", f"WITH {lines_cte()}, {_ROUTES} SELECT * FROM routes")
def q_routes(spark, sf_dir):
    """X3 (+F13): route registrations."""
    return X.extract_routes(_scanned(spark, sf_dir, "calls"))


@register("handlers", f"WITH {lines_cte()}, {_HANDLERS} SELECT repo, path, package, name, receiver, decodes, encodes, status_codes FROM handlers")
def q_handlers(spark, sf_dir):
    """X4 + X5 + X6 + A8: handlers with decoded / encoded types and status codes."""
    h = X.collect_handler_calls(_scanned(spark, sf_dir))
    return h.select("repo", "path", "package", "name", "receiver", "decodes", "encodes",
                    F.array_join(F.transform("status_codes", lambda c: c.cast("string")), ",").alias("status_codes"))


@register("handler_calls", f"""
WITH {lines_cte()}, {_HANDLERS}
SELECT repo, path, line, CASE name WHEN 'Decode' THEN 'decode' WHEN 'Encode' THEN 'encode' ELSE 'status' END AS kind, arg,
  CASE WHEN name <> 'WriteHeader' THEN resolved WHEN arg = 'http.StatusOK' THEN '200'
       WHEN arg = 'http.StatusCreated' THEN '201' ELSE arg END AS resolved FROM hcr""")
def q_handler_calls(spark, sf_dir):
    """Every decode / encode / status call with its resolved argument."""
    return X.handler_calls(_scanned(spark, sf_dir)).select("repo", "path", "line", "kind", "arg", "resolved")


@register("local_types", f"WITH {lines_cte()}, {_HANDLERS} SELECT repo, path, var, type FROM ltl")
def q_local_types(spark, sf_dir):
    """Local variable types inside handler bodies."""
    return X.local_types(_scanned(spark, sf_dir)).select("repo", "path", "var", "type")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: CTE ``files``: the files of the service corpus, with line comments taken out; the broken one is no Go file.
_SERVICE = "files AS (SELECT 'svc-' || p_partkey AS repo, f.path, regexp_replace(replace(replace(f.text, '%N%', " + \
    "CAST(p_size AS VARCHAR)), '%D%', CAST(p_size % 10 AS VARCHAR)), '//[^\\n]*', '', 'g') AS t FROM part, (VALUES " + \
    ", ".join(f"({_sql_text(p)}, {_sql_text(t)})" for p, t in D.SERVICE_FILES) + \
    ") f(path, text) WHERE f.path <> 'cmd/server/broken.go')"

# a receiver, what may stand between, the verb, a literal and the start of the second argument, over any lines
_CALL = (r"""[A-Za-z_]\w*\s*\.\s*(?:With\([a-z]+\)\s*\.\s*)?(Get|Post|Put|HandleFunc|Handle)\(\s*"([^"]*)"\s*,\s*"""
         r"""(func\(|[A-Za-z_][\w.]*\s*[,)]|[^,)\s])""")


@register("routes_multiline", f"""
WITH {_SERVICE},
m AS (SELECT repo, path, string_split(regexp_replace(t, '{_CALL}', chr(1) || '\\0', 'g'), chr(1)) AS p FROM files),
c AS (SELECT repo, path, p[i + 1] AS s, 1 + len(string_split(array_to_string(p[1:i], ''), chr(10))) - 1 AS line
      FROM m, range(1, 50) r(i) WHERE i < len(p)),
g AS (SELECT repo, path, line, regexp_extract(s, '{_CALL}', 1) AS name, regexp_extract(s, '{_CALL}', 2) AS lit,
             regexp_extract(s, '{_CALL}', 3) AS second FROM c)
SELECT repo, path, CAST(line AS INTEGER) AS line,
  CASE WHEN name IN ('Get', 'Post', 'Put') THEN upper(name) WHEN contains(lit, ' ') THEN split_part(lit, ' ', 1) ELSE 'ANY' END AS method,
  CASE WHEN contains(lit, ' ') THEN split_part(lit, ' ', 2) ELSE lit END AS route,
  CASE WHEN second = 'func(' THEN '<anonymous>' WHEN regexp_matches(second, '[,)]$') THEN regexp_replace(second, '\\s*[,)]$', '')
       ELSE '<unknown>' END AS handler
FROM g""")
def q_routes_multiline(spark, sf_dir):
    """X3 over calls that span lines, chains, nested functions and deep arguments, in several files per repo."""
    return X.extract_routes(X.scan_source(X.scan_filter(D.service_files(spark, sf_dir)), "calls"))


@register("handlers_multiline", f"""
WITH {_SERVICE},
f AS (SELECT repo, path, unnest(regexp_extract_all(t, '(?s)\\nfunc [^\\n]*.*?\\n\\}}')) AS f FROM files WHERE path LIKE 'api/%'),
h AS (SELECT repo, path, f, regexp_extract(f, '^\\nfunc \\(\\w+ ([^)]*)\\) (\\w+)\\(([^)]*)\\)', 1) AS receiver,
             regexp_extract(f, '^\\nfunc \\(\\w+ ([^)]*)\\) (\\w+)\\(([^)]*)\\)', 2) AS name,
             regexp_extract(f, '^\\nfunc \\(\\w+ ([^)]*)\\) (\\w+)\\(([^)]*)\\)', 3) AS params FROM f),
k AS (SELECT *, regexp_extract(f, '\\.Decode\\(\\s*&(\\w+)', 1) AS dvar,
             coalesce(nullif(regexp_extract(f, '\\.Encode\\(\\s*(\\w+)', 1), ''), regexp_extract(f, ', (\\w+)\\)\\n', 1)) AS evar,
             regexp_extract(f, '\\.(?:WriteHeader|JSON)\\(\\s*([\\w.]+)', 1) AS code
      FROM h WHERE regexp_matches(params, 'ResponseWriter|Request|Context')),
v AS (SELECT *, regexp_extract(f, 'var ' || dvar || ' (\\S+)', 1) AS decodes,
             regexp_extract(f, evar || ' := ([\\w.\\[\\]]+)\\{{', 1) AS encodes FROM k)
SELECT repo, path, 'api' AS package, name, receiver, decodes, encodes,
  CASE code WHEN 'http.StatusCreated' THEN '201' ELSE code END AS status_codes FROM v""")
def q_handlers_multiline(spark, sf_dir):
    """X4-X6 and A8 over signatures and calls that span lines, with arguments nested eleven deep."""
    h = X.collect_handler_calls(X.scan_source(X.scan_filter(D.service_files(spark, sf_dir))))
    return h.select("repo", "path", "package", "name", "receiver", "decodes", "encodes",
                    F.array_join(F.transform("status_codes", lambda c: c.cast("string")), ",").alias("status_codes"))


_GENERIC_SQL = f"""
WITH {_SERVICE},
s AS (SELECT repo, path, unnest(regexp_extract_all(t, '\\w+(?:\\[[^\\]]*\\])? struct ?\\{{[^{{}}]*\\}}')) AS s FROM files),
b AS (SELECT repo, path, regexp_extract(s, '^\\w+') AS struct,
             list_filter(list_transform(string_split_regex(regexp_extract(s, '\\{{([^{{}}]*)\\}}', 1), '[;\\n]'),
               lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM s),
d AS (SELECT repo, path, struct, i, regexp_replace(l[i], '\\s*`[^`]*`$', '') AS decl,
             regexp_extract(l[i], 'json:"([^"]*)"', 1) AS tag FROM b, range(1, 20) r(i) WHERE i <= len(l)),
n AS (SELECT *, CASE WHEN regexp_matches(decl, '^\\w+(, \\w+)* \\S') THEN
               string_split(regexp_extract(decl, '^(\\w+(?:, \\w+)*) ', 1), ', ') ELSE [''] END AS names,
             regexp_replace(decl, '^\\w+(, \\w+)* ', '') AS ty FROM d),
x AS (SELECT *, unnest(names) AS nm, unnest(range(1, len(names) + 1)) AS j,
             CASE WHEN regexp_matches(ty, '\\w\\[\\w') AND NOT starts_with(ty, 'map') THEN 'unknown' ELSE ty END AS type FROM n)
SELECT repo, path, 'model' AS package, struct,
  CAST(row_number() OVER (PARTITION BY repo, path, struct ORDER BY i, j) - 1 AS INTEGER) AS pos,
  CASE WHEN nm = '' THEN type ELSE nm END AS field, type,
  CASE WHEN tag <> '' THEN split_part(tag, ',', 1) WHEN nm = '' THEN '' ELSE lower(nm) END AS json_tag,
  contains(tag, ',omitempty') AS omitempty
FROM x WHERE nm = '' OR regexp_matches(nm, '^[A-Z]')"""


@register("struct_fields_generic", _GENERIC_SQL)
def q_struct_fields_generic(spark, sf_dir):
    """X2 over structs with type parameters, on one line, in groups, and embedded generic types."""
    return X.extract_struct_fields(X.scan_source(X.scan_filter(D.service_files(spark, sf_dir)), "types"))


@register("resolved_types", f"""
SELECT repo, path, struct, field, CASE type WHEN 'Codes' THEN '[]string' WHEN '*SKU' THEN '*string' ELSE type END AS type
FROM ({_GENERIC_SQL})""")
def q_resolved_types(spark, sf_dir):
    """Named types and aliases closed over before the types are mapped (opt-in)."""
    s = X.scan_source(X.scan_filter(D.service_files(spark, sf_dir)), "types").checkpoint()
    return X.resolve_named_types(X.extract_struct_fields(s), X.named_types(s)).select("repo", "path", "struct", "field", "type")


#: The fields of ItemPage once its generic types are expanded: path, depth, json_type, item_type, required.
_ITEM_PAGE = [("items", 0, "array", "object", True), ("items[].id", 1, "string", None, True), ("items[].size", 1, "integer", None, True),
              ("items[].weight", 1, "integer", None, True), ("total_%N%", 0, "integer", None, True), ("next", 0, "object", None, True),
              ("next.key", 1, "string", None, True), ("next.value", 1, "object", None, False), ("next.value.id", 2, "string", None, True),
              ("next.value.size", 2, "integer", None, True), ("next.value.weight", 2, "integer", None, True),
              ("seen", 0, "object", None, True), ("codes", 0, "ref", None, True), ("first", 0, "ref", None, True)]


@register("expand_fields_generic", "SELECT 'svc-' || p_partkey AS repo, replace(v.path, '%N%', CAST(p_size AS VARCHAR)) AS field_path, "
          "v.depth, v.pos, v.json_type, v.item_type, v.required FROM part, (VALUES "
          + ", ".join(f"({_sql_text(p)}, {d}, {i}, '{t}', {_sql_text(x) if x else 'NULL'}, {str(q).lower()})"
                      for i, (p, d, t, x, q) in enumerate(_ITEM_PAGE)) + ") v(path, depth, pos, json_type, item_type, required)")
def q_expand_fields_generic(spark, sf_dir):
    """J4 with generic structs: embedded Page[Item] and Pair[string, Item] expand to the fields of their arguments."""
    s = X.scan_source(X.scan_filter(D.service_files(spark, sf_dir)), "types")
    return R.expand_fields(X.extract_struct_fields(s, generics=True)).where(F.col("root") == "ItemPage").select(
        "repo", "field_path", "depth", "pos", "json_type", "item_type", "required")


@register("routes_grouped", f"""
WITH {_SERVICE},
m AS (SELECT repo, path, string_split(regexp_replace(t, '{_CALL}', chr(1) || '\\0', 'g'), chr(1)) AS p FROM files),
c AS (SELECT repo, path, p[i + 1] AS s, split_part(array_to_string(p[1:i], ''), 'r.Route("/v1"', 2) AS since
      FROM m, range(1, 50) r(i) WHERE i < len(p)),
g AS (SELECT repo, path, since, regexp_extract(s, '{_CALL}', 2) AS lit FROM c)
SELECT repo, path, CASE WHEN since <> '' AND NOT contains(since, chr(10) || chr(9) || '}})') THEN '/v1' ELSE '' END
  || CASE WHEN contains(lit, ' ') THEN split_part(lit, ' ', 2) ELSE lit END AS route FROM g""")
def q_routes_grouped(spark, sf_dir):
    """X3 with the prefixes of the route groups around each route (opt-in)."""
    return X.extract_routes(X.scan_source(X.scan_filter(D.service_files(spark, sf_dir)), "calls"), groups=True).select("repo", "path", "route")


_EXTRA = "package main\n\nfunc extra() {\n\tr.Put(\"/extra\", h.List)\n}\n"


def _changed_corpus(spark, sf_dir):
    """The service corpus after an edit: some files changed, some gone, some new."""
    part = F.substring_index("repo", "-", -1).cast("long")
    main = F.col("path") == "cmd/server/main.go"
    f = X.scan_filter(D.service_files(spark, sf_dir)).withColumn("_p", part)
    kept = f.where(~(main & (F.col("_p") % 7 == 0))).withColumn("content", F.when(
        main & (F.col("_p") % 5 == 0), F.replace("content", F.lit('"/raw"'), F.lit('"/raw2"'))).otherwise(F.col("content")))
    new = f.where(main & (F.col("_p") % 11 == 0)).withColumn("path", F.lit("cmd/extra/main.go")).withColumn("content", F.lit(_EXTRA))
    return kept.unionByName(new).drop("_p")


@register("rescan_changed", f"""
WITH {_SERVICE},
p AS (SELECT 'svc-' || p_partkey AS repo, p_partkey AS k FROM part),
v AS (SELECT repo, path, CASE WHEN k % 5 = 0 AND path = 'cmd/server/main.go' THEN replace(t, '"/raw"', '"/raw2"') ELSE t END AS t
      FROM files JOIN p USING (repo) WHERE NOT (k % 7 = 0 AND path = 'cmd/server/main.go')
      UNION ALL SELECT repo, 'cmd/extra/main.go', {_sql_text(_EXTRA)} FROM p WHERE k % 11 = 0),
m AS (SELECT repo, path, string_split(regexp_replace(t, '{_CALL}', chr(1) || '\\0', 'g'), chr(1)) AS p FROM v),
c AS (SELECT repo, path, i, p[i + 1] AS s FROM m, range(1, 50) r(i) WHERE i < len(p)),
g AS (SELECT repo, path, i, regexp_extract(s, '{_CALL}', 1) AS name, regexp_extract(s, '{_CALL}', 2) AS lit FROM c)
SELECT repo AS dependency, CAST(row_number() OVER (PARTITION BY repo ORDER BY path, i) - 1 AS INTEGER) AS ord,
  CASE WHEN name IN ('Get', 'Post', 'Put') THEN upper(name) WHEN contains(lit, ' ') THEN split_part(lit, ' ', 1) ELSE 'ANY' END AS method,
  CASE WHEN contains(lit, ' ') THEN split_part(lit, ' ', 2) ELSE lit END AS endpoint_path,
  (SELECT count(*) FILTER (k % 5 = 0 AND k % 7 <> 0) + count(*) FILTER (k % 11 = 0) FROM p)::BIGINT AS extracted
FROM g""")
def q_rescan_changed(spark, sf_dir):
    """S3: a corpus is scanned, edited and scanned again; only the edited files are extracted the second time."""
    path = shared_path(spark, "rescan")
    R.rescan(spark, X.scan_filter(D.service_files(spark, sf_dir)), path)
    ends, n = R.rescan(spark, _changed_corpus(spark, sf_dir), path)
    return ends.select("dependency", "ord", "method", "endpoint_path", F.lit(n).cast("long").alias("extracted"))


@register("type_mapping", f"""
WITH {lines_cte()}, {_FIELDS}
SELECT repo, struct, field, type,
  CASE WHEN regexp_matches(regexp_replace(type, '^[*]+', ''), '^(\\[\\]|\\.\\.\\.)') THEN 'array'
       ELSE (CASE regexp_replace(type, '^[*]+', '') WHEN 'string' THEN 'string' WHEN 'bool' THEN 'boolean'
             WHEN 'time.Time' THEN 'string' WHEN 'uuid.UUID' THEN 'string'
             ELSE CASE WHEN regexp_matches(regexp_replace(type, '^[*]+', ''), '^u?int(8|16|32|64)?$') THEN 'integer'
                       WHEN regexp_matches(regexp_replace(type, '^[*]+', ''), '^float(32|64)$') THEN 'number'
                       WHEN starts_with(regexp_replace(type, '^[*]+', ''), 'map[') THEN 'object'
                       ELSE 'ref' END END) END AS json_type,
  CASE regexp_replace(type, '^[*]+', '') WHEN 'time.Time' THEN 'date-time' WHEN 'uuid.UUID' THEN 'uuid' END AS format,
  starts_with(type, '*') AS nullable,
  regexp_replace(type, '^([*]|\\[\\]|\\.\\.\\.)+', '') AS ref_name
FROM struct_fields""")
def q_type_mapping(spark, sf_dir):
    """F11 + F15 over every extracted field type."""
    sf = X.extract_struct_fields(_scanned(spark, sf_dir, "types"))
    m, r = G.map_source_type(F.col("type")), G.type_ref(F.col("type"))
    return sf.select("repo", "struct", "field", "type", m["json_type"].alias("json_type"),
                     m["format"].alias("format"), m["nullable"].alias("nullable"),
                     F.when(r["pkg"] != "", F.concat(r["pkg"], F.lit("."), r["name"])).otherwise(r["name"])
                     .alias("ref_name"))


#: CTE ``eps``: J3 over the CTEs of routes, fields and handlers (handler names are unique per repo in this corpus).
_EPS = """
sname AS (SELECT DISTINCT repo, struct FROM struct_fields),
eps AS (SELECT r.repo AS dependency, r.repo,
  CAST(row_number() OVER (PARTITION BY r.repo ORDER BY r.path, r.line) - 1 AS INTEGER) AS ord, r.method,
  r.route AS endpoint_path, CASE WHEN h.decodes <> '' THEN coalesce(q.struct, h.decodes) END AS request_type,
  CASE WHEN h.encodes <> '' THEN coalesce(p.struct, h.encodes) END AS response_type,
  CASE WHEN starts_with(h.encodes, '[]') THEN 'array' ELSE 'object' END AS body_type,
  coalesce(list_extract(list_filter(list_transform(string_split(h.status_codes, ','), lambda c: TRY_CAST(c AS INTEGER)),
                                    lambda c: c BETWEEN 200 AND 299), 1), 200) AS status_code
  FROM routes r LEFT JOIN handlers h ON h.repo = r.repo AND h.name = list_extract(string_split(r.handler, '.'), -1)
  LEFT JOIN sname q ON q.repo = r.repo AND q.struct = regexp_replace(h.decodes, '^([*]|\\[\\])+', '')
  LEFT JOIN sname p ON p.repo = r.repo AND p.struct = regexp_replace(h.encodes, '^([*]|\\[\\])+', ''))"""
_SCAN_CTES = f"{lines_cte()}, {_FIELDS}, {_ROUTES}, {_HANDLERS}, {_EPS}"
_REGISTRY_SQL = f"""
WITH {_SCAN_CTES}
SELECT dependency, ord, method, endpoint_path, request_type, response_type, body_type, status_code FROM eps"""


@register("build_registry", _REGISTRY_SQL)
def q_build_registry(spark, sf_dir):
    """Endpoint registry joined from routes, handlers and structs."""
    _, sf, rt, hd, _ = _scan(spark, sf_dir)
    e = R.build_registry(rt, hd, sf)
    return e.select("dependency", "ord", "method", "endpoint_path", "request_type", "response_type",
                    "body_type", "status_code")


def _expand_sql(source: str) -> str:
    """CTEs for J4 over ``source`` (X2's columns), as a recursive walk; ends in the result's SELECT."""
    bare = "regexp_replace(type, '^[*]+', '')"
    return f"""
xt AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_replace(type, '^([*]|\\[\\]|\\.\\.\\.)+', '') AS ref,
  regexp_matches({bare}, '^(\\[\\]|\\.\\.\\.)') AS is_list FROM {source} WHERE json_tag <> '-'),
xs AS (SELECT DISTINCT repo, dir, package, struct FROM xt),
xr AS (SELECT xt.*, xs.dir AS cdir, xs.package AS cpackage, xs.struct AS cstruct,
  xt.field = xt.type AND xs.struct IS NOT NULL AS embedded,
  CASE WHEN json_tag = '' THEN lower(field) ELSE json_tag END AS json_key,
  CASE WHEN is_list THEN 'array' WHEN {bare} IN ('string', 'time.Time', 'uuid.UUID') THEN 'string'
       WHEN {bare} = 'bool' THEN 'boolean' WHEN regexp_matches({bare}, '^u?int(8|16|32|64)?$') THEN 'integer'
       WHEN regexp_matches({bare}, '^float(32|64)$') THEN 'number' WHEN starts_with({bare}, 'map[') THEN 'object'
       WHEN xs.struct IS NOT NULL THEN 'object' ELSE 'ref' END AS json_type
  FROM xt LEFT JOIN xs ON xs.repo = xt.repo AND (
    (NOT contains(ref, '.') AND xs.struct = ref AND xs.dir = xt.dir)
    OR (contains(ref, '.') AND xs.struct = split_part(ref, '.', 2) AND xs.package = split_part(ref, '.', 1)))),
walk(repo, root_dir, root_package, root, dir, package, struct, prefix, depth, ord, seen) AS (
  SELECT repo, dir, package, struct, dir, package, struct, '', 0, CAST([] AS INTEGER[]), [dir || '|' || package || '|' || struct] FROM xs
  UNION ALL
  SELECT w.repo, w.root_dir, w.root_package, w.root, c.cdir, c.cpackage, c.cstruct,
    w.prefix || CASE WHEN c.embedded THEN '' WHEN c.is_list THEN c.json_key || '[].' ELSE c.json_key || '.' END,
    w.depth + CASE WHEN c.embedded THEN 0 ELSE 1 END, list_append(w.ord, CAST(c.pos AS INTEGER)),
    list_append(w.seen, c.cdir || '|' || c.cpackage || '|' || c.cstruct)
  FROM walk w JOIN xr c ON c.repo = w.repo AND c.dir = w.dir AND c.package = w.package AND c.struct = w.struct
  WHERE c.cstruct IS NOT NULL AND NOT list_contains(w.seen, c.cdir || '|' || c.cpackage || '|' || c.cstruct))
SELECT w.repo, root_dir, root_package, root, prefix || json_key AS field_path, depth, field AS name, json_key, json_type,
  CASE {bare} WHEN 'time.Time' THEN 'date-time' WHEN 'uuid.UUID' THEN 'uuid' END AS format,
  NOT omitempty AS required, starts_with(type, '*') AS nullable,
  CAST(row_number() OVER (PARTITION BY w.repo, root_dir, root_package, root
                          ORDER BY list_append(w.ord, CAST(c.pos AS INTEGER))) - 1 AS INTEGER) AS pos
FROM walk w JOIN xr c ON c.repo = w.repo AND c.dir = w.dir AND c.package = w.package AND c.struct = w.struct
WHERE NOT embedded"""


EXPANDED = ["repo", "root_dir", "root_package", "root", "field_path", "depth", "name", "json_key", "json_type", "format",
            "required", "nullable", "pos"]


@register("expand_fields", f"WITH RECURSIVE {lines_cte()}, {_FIELDS}, {_expand_sql('struct_fields')}")
def q_expand_fields(spark, sf_dir):
    """Every struct's fields fully expanded (nested structs inlined)."""
    return R.expand_fields(X.extract_struct_fields(_scanned(spark, sf_dir, "types"))).select(*EXPANDED)


_NESTED_VALUES = ", ".join("(" + ", ".join(str(v).lower() if isinstance(v, bool) else repr(v) for v in row) + ")"
                           for row in D.NESTED_STRUCTS)


@register("expand_fields_deep", f"""
WITH RECURSIVE p AS (SELECT 'svc-' || p_partkey AS repo, p_size % 4 + 9 AS last FROM part),
nested AS (
  SELECT repo, 'deep/chain.go' AS path, 'deep' AS package, 'S' || i AS struct, pos,
    CASE pos WHEN 0 THEN 'Val' ELSE 'Next' END AS field,
    CASE pos WHEN 0 THEN 'float64' ELSE '*S' || CASE WHEN i < last THEN i + 1 ELSE 0 END END AS type,
    CASE pos WHEN 0 THEN 'v' || i ELSE 'next' END AS json_tag, false AS omitempty
  FROM (SELECT repo, last, unnest(range(0, last + 1)) AS i FROM p), (VALUES (0), (1)) AS q(pos)
  UNION ALL
  SELECT repo, v.* FROM p, (VALUES {_NESTED_VALUES}) AS v(path, package, struct, pos, field, type, json_tag, omitempty)),
{_expand_sql('nested')}""")
def q_expand_fields_deep(spark, sf_dir):
    """J4 over chains deeper than eight, cycles, equal names in packages and directories, and embedding."""
    return R.expand_fields(D.nested_struct_fields(spark, sf_dir)).select(*EXPANDED)


#: CTE ``fw``: the framework of every repo (one file and at most one framework each in this corpus).
_FRAMEWORKS = r"""
fw_imp AS (SELECT regexp_extract(unnest(string_split(content, chr(10))), '^\t(?:[A-Za-z_]+ )?"([^"]+)"$', 1) AS import, repo
  FROM files WHERE ends_with(path, '.go')),
fw_map AS (SELECT * FROM (VALUES ('github.com/go-chi/chi/v5', 'chi'), ('github.com/gin-gonic/gin', 'gin'),
  ('github.com/labstack/echo/v4', 'echo'), ('github.com/gorilla/mux', 'gorilla'), ('net/http', 'stdlib')) t(import, fw)),
fw AS (SELECT repo, coalesce(min(fw_map.fw) FILTER (WHERE fw_map.fw <> 'stdlib'), min(fw_map.fw), 'unknown') AS framework
  FROM (SELECT DISTINCT repo FROM files) LEFT JOIN fw_imp USING (repo) LEFT JOIN fw_map USING (import) GROUP BY repo)"""


@register("scan_summary", f"""
WITH {_SCAN_CTES}, {_FRAMEWORKS},
per AS (SELECT f.repo,
  CAST((SELECT count(DISTINCT struct) FROM struct_fields s WHERE s.repo = f.repo) AS BIGINT) AS structs,
  CAST((SELECT count(*) FROM routes r WHERE r.repo = f.repo) AS BIGINT) AS routes,
  CAST((SELECT count(*) FROM handlers h WHERE h.repo = f.repo) AS BIGINT) AS handlers, fw.framework
  FROM (SELECT DISTINCT repo FROM kept) f JOIN fw USING (repo))
SELECT repo, structs, routes, handlers, framework, 0 AS is_total FROM per
UNION ALL SELECT NULL, sum(structs)::BIGINT, sum(routes)::BIGINT, sum(handlers)::BIGINT, NULL, 1 FROM per""")
def q_scan_summary(spark, sf_dir):
    """A3: per-repo extraction counts and the grand total."""
    b, sf, rt, hd, fw = _scan(spark, sf_dir)
    kept = X.scan_filter(_files(spark, sf_dir))
    s = R.scan_summary(kept, sf, rt, hd, fw)
    return s.select("repo", "structs", "routes", "handlers", "framework", "is_total")


@register("scan_rejected", f"""
WITH {_SCAN_CTES}
SELECT DISTINCT repo, 'no structs, routes or handlers found' AS reason FROM files
WHERE repo NOT IN (SELECT repo FROM struct_fields) AND repo NOT IN (SELECT repo FROM routes)
  AND repo NOT IN (SELECT repo FROM handlers)""")
def q_scan_rejected(spark, sf_dir):
    """A4: repos whose scan found nothing (rejected with a reason)."""
    files = _files(spark, sf_dir)
    _, sf, rt, hd, fw = _scan(spark, sf_dir)
    # every repo of the corpus, including those whose files were all filtered out
    s = R.scan_summary(files.select("repo").distinct(), sf, rt, hd, fw)
    _, rejected = R.scan_quality_gate(s)
    return rejected


@register("registry_summary", f"""
WITH {_SCAN_CTES}, {_FRAMEWORKS}
SELECT fw.repo AS dependency, CAST(count(eps.ord) AS BIGINT) AS endpoints, fw.framework
FROM fw LEFT JOIN eps USING (repo) GROUP BY ALL""")
def q_registry_summary(spark, sf_dir):
    """A2: endpoints and framework per dependency (0 kept)."""
    files = _files(spark, sf_dir)
    _, sf, rt, hd, fw = _scan(spark, sf_dir)
    deps = files.select(F.col("repo").alias("name"), "repo").distinct()
    return R.registry_summary(R.build_registry(rt, hd, sf), deps, fw)


@register("registry_detail", f"""
WITH {lines_cte()}, {_ROUTES}
SELECT repo AS dependency, CAST(row_number() OVER (PARTITION BY repo ORDER BY path, line) - 1 AS INTEGER) AS ord,
  method, route AS endpoint_path FROM routes WHERE repo = 'svc-2'""")
def q_registry_detail(spark, sf_dir):
    """Q1: all endpoints of one dependency, in order."""
    _, sf, rt, hd, _ = _scan(spark, sf_dir)
    e = R.registry_detail(R.build_registry(rt, hd, sf), "svc-2")
    return e.select("dependency", "ord", "method", "endpoint_path")


_ROUNDTRIP_SQL = f"""
WITH RECURSIVE {_SCAN_CTES},
x AS (WITH RECURSIVE {_expand_sql('struct_fields')}),
f AS (SELECT repo, root, string_agg(field_path || ':' || json_type, ',' ORDER BY pos) AS fields FROM x GROUP BY ALL)
SELECT dependency, ord, method, endpoint_path, request_type, response_type, body_type, status_code, q.fields AS request_fields, s.fields AS response_fields
FROM eps LEFT JOIN f q ON q.repo = eps.repo AND q.root = request_type
  LEFT JOIN f s ON s.repo = eps.repo AND s.root = response_type"""


@register("registry_roundtrip", _ROUNDTRIP_SQL)
def q_registry_roundtrip(spark, sf_dir):
    """S2 + S3: write the registry as JSON documents with full bodies; the rows come from what is read back,
    the second time without a scan."""
    _, sf, rt, hd, fw = _scan(spark, sf_dir)
    eps = R.build_registry(rt, hd, sf)
    path = shared_path(spark, "registry")
    scans = []

    def scan():
        scans.append(path)
        R.write_registry(eps, R.expand_fields(sf), fw, path)

    R.load_or_scan(spark, path, scan)
    reg = R.load_or_scan(spark, path, scan)
    if len(scans) != 1:
        raise RuntimeError("a written registry must be reused")
    shown = lambda c: F.array_join(F.transform(c, lambda f: F.concat(f["field_path"], F.lit(":"), f["type"])), ",")
    return reg.select("dependency", "ord", "method", "endpoint_path", "request_type", "response_type", "body_type",
                      "status_code", shown("request_fields").alias("request_fields"),
                      shown("response_fields").alias("response_fields"))


@register("registry_priority", f"""
WITH {_SCAN_CTES}
SELECT dependency, ord, method AS ep_method, endpoint_path AS ep_path, '/' || repo AS pfx,
  CAST(length(repo) + 1 AS INTEGER) AS plen FROM eps""")
def q_registry_priority(spark, sf_dir):
    """The scanned routes in match order (longest prefix first, then registry order)."""
    _, sf, rt, hd, _ = _scan(spark, sf_dir)
    eps = R.build_registry(rt, hd, sf).withColumn("prefix", F.concat(F.lit("/"), F.col("dependency")))
    return M.registry_priority(M.prepare_routes(eps.withColumnRenamed("path", "file").withColumnRenamed("endpoint_path", "path")))


# ------------------------------------------------------------ large registry
def lineitem_request_id():
    """Unique id of a lineitem row ((orderkey, linenumber) alone repeats in this data)."""
    return ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000003 + F.col("l_partkey")) * 101 \
        + F.col("l_suppkey")


def _lineitem_requests(spark, sf_dir):
    li = D.table(spark, sf_dir, "lineitem")
    return li.select(
        lineitem_request_id().alias("request_id"),
        F.when(F.col("l_linenumber") % 3 == 0, "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/svc-"), F.col("l_partkey").cast("string"),
                 F.when(F.col("l_linenumber") % 3 == 0, F.lit("/parts"))
                 .when(F.col("l_linenumber") % 3 == 1,
                       F.concat(F.lit("/parts/"), F.col("l_orderkey").cast("string")))
                 .otherwise(F.concat(F.lit("/legacy/"), F.col("l_suppkey").cast("string")))).alias("path"))


@register("match_corpus_registry", f"""
WITH {lines_cte()}, {_ROUTES},
e AS (SELECT repo AS dependency, CAST(row_number() OVER (PARTITION BY repo ORDER BY path, line) - 1 AS INTEGER) AS ord,
  method AS ep_method, route AS ep_path, '/' || repo AS pfx,
  list_filter(string_split(route, '/'), lambda x: x <> '') AS psegs FROM routes),
r AS (SELECT ((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 101 + l_suppkey AS request_id,
  CASE WHEN l_linenumber % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
  '/svc-' || CAST(l_partkey AS VARCHAR) || CASE WHEN l_linenumber % 3 = 0 THEN '/parts'
    WHEN l_linenumber % 3 = 1 THEN '/parts/' || CAST(l_orderkey AS VARCHAR)
    ELSE '/legacy/' || CAST(l_suppkey AS VARCHAR) END AS path FROM lineitem),
c AS (SELECT r.request_id, e.*, list_filter(string_split(substr(r.path, length(e.pfx) + 1), '/'), lambda x: x <> '') AS rsegs
  FROM r JOIN e ON e.pfx = '/' || split_part(r.path, '/', 2) AND starts_with(r.path, e.pfx)
   AND (e.ep_method = r.method OR e.ep_method = 'ANY')),
ok AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY length(pfx) DESC, ord) AS rn FROM c
  WHERE len(rsegs) = len(psegs) AND coalesce(list_bool_and(list_transform(list_zip(psegs, rsegs),
        lambda z: {O.is_param('z[1]')} OR z[1] = z[2])), true))
SELECT r.request_id, r.method, r.path, ok.dependency, ok.ep_method AS endpoint_method, ok.ep_path AS endpoint_path,
  CASE WHEN ok.request_id IS NULL THEN NULL
       ELSE array_to_string(list_transform(list_filter(list_zip(ok.psegs, ok.rsegs), lambda z: {O.is_param('z[1]')}),
                            lambda z: substr(z[1], 2, length(z[1]) - 2) || '=' || z[2]), '&') END AS path_params
FROM r LEFT JOIN ok ON ok.request_id = r.request_id AND ok.rn = 1""")
def q_match_corpus_registry(spark, sf_dir):
    """J1 hash-join form against the registry scanned from the corpus (one
    dependency per repo at '/<repo>'): thousands of routes, every lineitem a request."""
    _, sf, rt, hd, _ = _scan(spark, sf_dir)
    # the routes are read by the count, the prefix lengths, the shapes and the join: one registry for all
    eps = _keep(R.build_registry(rt, hd, sf), "registry").select(
        "dependency", "ord", "method", F.col("endpoint_path").alias("path"), "status_code")
    deps = eps.select(F.col("dependency").alias("name"), F.concat(F.lit("/"), F.col("dependency")).alias("prefix")) \
        .distinct()
    routes = M.prepare_routes(eps, deps)
    m = M.match_requests(_lineitem_requests(spark, sf_dir), routes, strategy="auto")
    return m.select("request_id", "method", "path", "dependency", "endpoint_method", "endpoint_path",
                    params_to_string("path_params").alias("path_params"))
