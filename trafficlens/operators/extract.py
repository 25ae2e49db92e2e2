"""Contract extraction over a source corpus.

A file is one row.  ``scan_source`` passes over its text once and keeps what
the extractors need as arrays: statements, calls and function headers, over
any number of lines and any depth of brackets.  The extractors are column
expressions over those arrays, inside the file's own row: no shuffle but the
one that numbers struct fields is needed, and nothing is collected.  A file
whose brackets do not match, or that has no package clause, is skipped, as a
parser would.  Lines, declaration blocks and imports (W2, X1) read the text
line by line; declarations there start in column 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trafficlens.functions import gosrc as G
from trafficlens.functions.goscan import scan
from trafficlens.session import qualified_path, ship_package

IDENT = G.IDENT
DECL = "^(func|type|var|const|import|package)([^A-Za-z0-9_]|$)"

# Import paths that identify a web framework.
FRAMEWORK_IMPORTS = {
    "github.com/go-chi/chi": "chi",
    "github.com/go-chi/chi/v5": "chi",
    "github.com/gin-gonic/gin": "gin",
    "github.com/labstack/echo": "echo",
    "github.com/labstack/echo/v4": "echo",
    "github.com/gorilla/mux": "gorilla",
}


# ------------------------------------------------------------------ S1
def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """S1 from a directory tree: root/<repo>/<path...> -> (repo, path, content)."""
    df = (spark.read.option("wholetext", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", "*.go").text(root)
          .select(F.input_file_name().alias("_f"), F.col("value").alias("content")))
    base = qualified_path(spark, root).rstrip("/") + "/"
    # the file's URI without scheme and authority, decoded, below the root
    full = F.url_decode(F.replace(F.regexp_replace("_f", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", ""), F.lit("+"), F.lit("%2B")))
    rel = F.substring(full, len(base) + 1, 1 << 30)
    repo = F.substring_index(rel, "/", 1)
    return df.select(repo.alias("repo"), rel.substr(F.length(repo) + 2, F.lit(1 << 30)).alias("path"), "content")


def scan_filter(files: DataFrame, scan_paths: DataFrame | None = None, for_imports: bool = False) -> DataFrame:
    """S1 selection: ``*.go`` files, minus ``*_test.go`` and anything below a
    directory named ``vendor`` or starting with '.' (the scan root itself is
    exempt).  ``scan_paths`` (repo, scan_path) restricts and may repeat files
    when paths overlap (kept, as the reference concatenates per scan path);
    a scan path may name one file.  ``for_imports`` keeps the wider file set
    used for framework detection (test and vendor files count there).
    """
    f = files
    if scan_paths is not None:
        sp = scan_paths.select("repo", F.regexp_replace(F.col("scan_path"), "^\\./?|/$", "").alias("_sp"))
        f = f.join(sp, "repo")
        inside = ((F.col("_sp") == "") | (F.col("path") == F.col("_sp"))
                  | F.col("path").startswith(F.concat(F.col("_sp"), F.lit("/"))))
        rel = F.when(F.col("_sp") == "", F.col("path")).otherwise(
            F.col("path").substr(F.length("_sp") + 2, F.lit(1 << 30)))
        f = f.where(inside).withColumn("_rel", F.when(F.col("path") == F.col("_sp"), F.col("path")).otherwise(rel))
    else:
        f = f.withColumn("_rel", F.col("path"))
    go = F.col("path").endswith(".go")
    if for_imports:
        keep = go
    else:
        parts = F.split(F.col("_rel"), "/")
        dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        hidden = F.exists(dirs, lambda d: (d == "vendor") | d.startswith("."))
        keep = go & ~F.col("path").endswith("_test.go") & ~hidden
    return f.where(keep).select("repo", "path", "content")


# ------------------------------------------------------------------ lines, W2
# A file's pieces: block comment, line comment, interpreted string, raw string, rune, other text.
_PIECES = (r"""(?s)/\*.*?\*/|//[^\n]*|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|`[^`]*`|'(?:\\.|[^'\\\n])+'|[^/"`']+|.""")
# A line comment, or as $1 what may hold its sign: for texts without block comments.
_NO_COMMENT = r"""(?s)//[^\n]*|("[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|`[^`]*`|'(?:\\.|[^'\\\n])+')"""
_GROUP = r"(?ms)^type \($.*?^\)$|.+?(?=^type \($|\z)"
_ANON = r"(?m)^\t[A-Za-z_][\w, ]* (?:\[\]|\*)*struct \{\n(?:\t\t.*\n|\n)*\t\}[^\n]*$|(?s).+?(?=^\t[A-Za-z_][\w, ]* (?:\[\]|\*)*struct \{$|\z)"


def _breaks(text):
    """As many line breaks as the text has, so that line numbers stay."""
    return F.repeat(F.lit("\n"), _count_breaks(text))


def _count_breaks(text):
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _pieces(text, pattern: str, change):
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change), "")


def clean_source(content):
    """A file's text without comments (strings kept), with grouped ``type ( ... )`` declarations
    written one by one and anonymous struct types shortened to ``struct{}``; line numbers stay."""
    text = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    # a step that would change nothing is left out: cutting a text in pieces costs far more than looking for what it changes
    text = G.let(text, lambda t: F.when(t.contains("/*"), _pieces(t, _PIECES, lambda p: F.when(
        p.startswith("/*"), _breaks(p)).when(p.startswith("//"), F.lit("")).otherwise(p))).otherwise(
        F.regexp_replace(t, _NO_COMMENT, "$1")))
    one_by_one = lambda p: F.concat(F.lit(""), F.regexp_replace(F.regexp_replace(F.regexp_replace(
        p, r"\Atype \(|\)\z", ""), "(?m)^\t", ""), r"(?m)^([A-Za-z_]\w*)(?= )", "type $1"))
    text = G.let(text, lambda t: F.when(t.contains("type (\n"), _pieces(t, _GROUP, lambda p: F.when(
        p.startswith("type (\n"), one_by_one(p)).otherwise(p))).otherwise(t))
    short = lambda p: F.concat(F.regexp_extract(p, r"^(\t[^\n]*?)struct \{", 1), F.lit("struct{}"),
                               F.regexp_extract(p, r"\n\t\}([^\n]*)$", 1), _breaks(p))
    return G.let(text, lambda t: F.when(t.rlike(r"(?m)^\t[^\n]* (?:\[\]|\*)*struct \{\n"), _pieces(t, _ANON, lambda p: F.when(
        p.rlike(r"\A\t[^\n]* (?:\[\]|\*)*struct \{\n"), short(p)).otherwise(p))).otherwise(t))


def source_lines(files: DataFrame) -> DataFrame:
    """One row per line: repo, path, line (1-based), text (comments removed)."""
    lines = files.select("repo", "path", F.posexplode(F.split(clean_source(F.col("content")), "\n")).alias("_pos", "_raw"))
    return lines.select("repo", "path", (F.col("_pos") + 1).alias("line"), F.rtrim("_raw").alias("text"))


def source_blocks(lines: DataFrame) -> DataFrame:
    """Each line with its top-level declaration block, block header and package."""
    w = Window.partitionBy("repo", "path").orderBy("line")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.col("text").rlike(DECL)
    pkg = F.regexp_extract(F.col("text"), f"^package\\s+({IDENT})", 1)
    return lines.select(
        "*",
        F.sum(starts.cast("int")).over(run).alias("block"),
        F.last(F.when(starts, F.col("text")), ignorenulls=True).over(run).alias("header"),
        F.max(F.when(pkg != "", pkg)).over(Window.partitionBy("repo", "path")).alias("package"))


def file_blocks(files: DataFrame) -> DataFrame:
    """``source_blocks(source_lines(files))`` without a shuffle: each file is cut before its column-0 declarations
    inside its own row, and a block's first line is the count of line breaks before it."""
    cut = r"(?m)(?=^(?:func|type|var|const|import|package)(?:[^A-Za-z0-9_]|$))"
    text = clean_source(F.col("content"))
    f = files.select("repo", "path", text.alias("_text"))
    f = f.select("repo", "path", F.regexp_extract("_text", rf"(?m)^package\s+({IDENT})", 1).alias("_pkg"),
                 F.split("_text", cut).alias("_parts"))
    starts = F.aggregate(
        "_parts", F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + _count_breaks(p)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        lambda acc: acc["out"])
    b = f.select("repo", "path", "_pkg", F.get("_parts", F.lit(0)).rlike(DECL).alias("_first"),
                 F.size("_parts").alias("_n"),
                 F.posexplode(F.arrays_zip(F.col("_parts").alias("text"), starts.alias("start"))).alias("_i", "_b"))
    # every part but the last ends with the break before the next declaration, behind which it has no line
    lines = F.split(F.col("_b.text"), "\n")
    lines = F.when(F.col("_i") < F.col("_n") - 1, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    head = F.rtrim(F.substring_index("_b.text", "\n", 1))
    return (b.select("repo", "path", "_pkg", "_first", "_i", F.col("_b.start").alias("_start"), head.alias("_head"),
                    F.posexplode(lines).alias("_k", "_raw"))
            .select("repo", "path", (F.col("_start") + F.col("_k")).alias("line"), F.rtrim("_raw").alias("text"),
                    (F.col("_i") + F.col("_first").cast("int")).cast("long").alias("block"),
                    F.when((F.col("_i") > 0) | F.col("_first"), F.col("_head")).alias("header"),
                    F.when(F.col("_pkg") != "", F.col("_pkg")).alias("package")))


# ------------------------------------------------------------------ X1, A1, A1b
def extract_imports(blocks: DataFrame) -> DataFrame:
    """Repo, path, pos, import — single-line and grouped import declarations."""
    imp = blocks.where(F.col("header").startswith("import"))
    path = F.regexp_extract(F.col("text"), '"([^"]+)"', 1)
    single = F.col("text").rlike(f'^import\\s+({IDENT}\\s+|[._]\\s+)?"')
    grouped = F.col("text").rlike(f'^\\s+({IDENT}\\s+|[._]\\s+)?"')
    x = imp.where((single | grouped) & (path != ""))
    w = Window.partitionBy("repo", "path").orderBy("line")
    return x.select("repo", "path", (F.row_number().over(w) - 1).alias("pos"), path.alias("import"))


def _fw_map():
    return F.create_map(*[x for k, v in FRAMEWORK_IMPORTS.items() for x in (F.lit(k), F.lit(v))])


def detect_framework(imports: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """A1: per repo, the most frequently imported framework; 'stdlib' if none
    but net/http is imported; else 'unknown'.  Ties: count desc, name asc.

    ``repos``: every repo of the corpus (column repo); without it, the repos
    that import something."""
    repos = (imports if repos is None else repos).select("repo").distinct()
    fw = F.coalesce(_fw_map()[F.col("import")], F.when(F.col("import") == "net/http", "stdlib"))
    counts = imports.select("repo", fw.alias("fw")).where(F.col("fw").isNotNull()).groupBy("repo", "fw").count()
    best = counts.groupBy("repo").agg(
        F.min(F.when(F.col("fw") != "stdlib", F.struct((-F.col("count")).alias("_n"), F.col("fw")))).alias("_b"),
        F.max(F.when(F.col("fw") == "stdlib", F.col("count"))).alias("_std"))
    return repos.join(best.hint("merge"), "repo", "left").select("repo", F.coalesce(
        F.col("_b.fw"), F.when(F.col("_std") > 0, "stdlib"), F.lit("unknown")).alias("framework"))


def framework_from_imports(imports: DataFrame) -> DataFrame:
    """Per file, the first known framework import in order, then net/http, then unknown."""
    known = _fw_map()[F.col("import")]
    agg = imports.groupBy("repo", "path").agg(
        F.min_by(known, F.when(known.isNotNull(), F.col("pos"))).alias("_fw"),
        F.max((F.col("import") == "net/http").cast("int")).alias("_http"))
    return agg.select("repo", "path", F.coalesce("_fw", F.when(F.col("_http") == 1, "stdlib"), F.lit("unknown"))
                      .alias("framework"))


# ------------------------------------------------------------------ X2-X6: one pass over a file
SCANNED = ("package string, statements array<struct<block:int,start:int,line:int,depth:int,owner:string,text:string,"
           "targets:string,values:array<string>>>, calls array<struct<block:int,line:int,start:int,stop:int,name:string,"
           "args:array<string>>>, funcs array<struct<block:int,receiver:string,name:string,params:array<string>>>")
_GROUPS = ["Route", "Group"]
_CALLS = {*G.DECODE_CALLS, *G.ENCODE_CALLS, "WriteHeader", "HandleFunc", "Handle", *_GROUPS}


def _wanted(name: str) -> bool:
    return name in _CALLS or name.upper() in G.HTTP_VERBS


#: Files whose finds a task holds as Python objects before they become columns.
_SCAN_ROWS = 256


def _list_column(lists: list, kind: pa.ListType) -> pa.ListArray:
    """Lists (of tuples, for structs) as an Arrow column, made from flat columns instead of an object for each entry."""
    offsets = pa.array([0, *accumulate(map(len, lists))], pa.int32())
    of = kind.value_type
    if not pa.types.is_struct(of):
        return pa.ListArray.from_arrays(offsets, pa.array(list(chain.from_iterable(lists)), of), type=kind)
    columns = list(zip(*chain.from_iterable(lists))) or [()] * of.num_fields
    made = [_list_column(c, f.type) if pa.types.is_list(f.type) else pa.array(c, f.type) for c, f in zip(columns, of)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(made, fields=list(of)), type=kind)


#: The lists that each kind of scan returns; extractors that need one of them alone ask for no more.
FINDS = {"all": ["statements", "calls", "funcs"], "types": ["statements"], "calls": ["calls"]}


def scan_source(files: DataFrame, finds: str = "all") -> DataFrame:
    """repo, path and what one pass over each file finds (SCANNED); files that do not parse are left out.

    ``finds``: "all"; "types" for ``extract_struct_fields`` and ``named_types`` (type declarations and
    what stands in them); "calls" for ``extract_routes``.
    """
    ship_package(files.sparkSession)
    made = T.StructType([f for f in T._parse_datatype_string(SCANNED).fields if f.name in ("package", *FINDS[finds])])
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(lo, _SCAN_ROWS) for lo in range(0, whole.num_rows, _SCAN_ROWS)):
                found = [None if c is None else scan(c, _wanted, finds) for c in b.column("content").to_pylist()]
                keep = pa.array([f is not None for f in found])
                rows = [f for f in found if f is not None]
                columns = [_list_column([f[c.name] for f in rows], c.type) if pa.types.is_list(c.type)
                           else pa.array([f[c.name] for f in rows], c.type) for c in arrow]
                yield pa.RecordBatch.from_arrays([b.column("repo").filter(keep), b.column("path").filter(keep), *columns],
                                                 ["repo", "path", *arrow.names])

    src = files.select("repo", "path", F.regexp_replace("content", "\r\n", "\n").alias("content"))
    return src.mapInArrow(run, T.StructType([*src.schema.fields[:2], *made.fields]))


def _scanned(source: DataFrame, finds: str) -> DataFrame:
    """``scan_source`` of a table of lines (their files put together), or the table itself if it is scanned."""
    if {"statements", "calls"} & {*source.columns}:
        return source
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return scan_source(source.groupBy("repo", "path").agg(text.alias("content")), finds)


# ------------------------------------------------------------------ X2
_STRUCT = rf"(?s)^type\s+({IDENT})\s*(\[.*\])?\s*=?\s*struct$"
_NAMED = rf"(?s)^({IDENT}(\s*,\s*{IDENT})*)\s+(\S.*)$"
_TAG = r"(?s)(`[^`]*`|\"(?:[^\"\\]|\\.)*\")$"


def extract_struct_fields(source: DataFrame, generics: bool = False) -> DataFrame:
    """Repo, path, package, struct, pos, field, type, json_tag, omitempty.

    Struct types declared at the file's level, alone or in a group, on one
    line or several, with or without type parameters.  Unexported named fields
    are skipped; an embedded field is named by its type; ``A, B int`` gives
    two rows; a missing tag becomes the lower-cased name (not for embedded
    fields).  With ``generics`` two more columns let J4 expand generic types:
    source_type (the type as written) and type_params (the struct's).
    """
    inside = F.filter("statements", lambda s: (s["depth"] == 1) & s["owner"].startswith("type"))
    # each step's columns are made once: Spark does not merge steps that would make them again
    body = (_scanned(source, "types").select("repo", "path", "package", F.explode(inside).alias("s"))
            .where(F.col("s.owner").rlike(_STRUCT))
            .select("repo", "path", "package", F.regexp_extract("s.owner", _STRUCT, 1).alias("struct"),
                    F.col("s.start").alias("start"), F.col("s.text").alias("content"),
                    F.regexp_replace(F.regexp_extract("s.owner", _STRUCT, 2), r"^\[|\]$", "").alias("_params")))
    kept = ["repo", "path", "package", "struct", "start", "_params"]
    # what stands before a space is a name, unless it is a type's own word
    is_named = F.col("_decl").rlike(_NAMED) & ~F.col("_decl").rlike(r"^(chan|func|map|struct|interface)\b")
    parsed = body.select(*kept, F.regexp_extract("content", _TAG, 1).alias("_raw"),
                         G.strip(F.regexp_replace("content", _TAG, "")).alias("_decl"))
    parsed = parsed.select(*kept, "_raw", "_decl", is_named.alias("_is"))
    parsed = parsed.select(*kept, "_raw", F.when(F.col("_is"), F.split(F.regexp_extract("_decl", _NAMED, 1), "\\s*,\\s*")).alias("_names"),
                           F.when(F.col("_is"), F.regexp_extract("_decl", _NAMED, 3)).otherwise(F.col("_decl")).alias("_type"))
    parsed = parsed.select(
        "repo", "path", "package", "struct", "start", "_names", G.type_text("_type").alias("type"), G.parse_json_tag("_raw").alias("_tag"),
        F.regexp_replace(G.strip("_type"), r"\s+", " ").alias("source_type"),
        F.filter(F.transform(F.split("_params", ","), lambda x: F.regexp_extract(x, rf"^\s*({IDENT})", 1)), lambda x: x != "")
        .alias("type_params"))
    more = ["source_type", "type_params"] if generics else []
    # an embedded field has one row without a name; both kinds come from one pass
    named = F.col("_name").isNotNull()
    rows = (parsed.select("*", F.posexplode(F.coalesce("_names", F.array(F.lit(None).cast("string")))).alias("_i", "_name"))
            .where(~named | F.substring("_name", 1, 1).rlike("^\\p{Lu}"))
            .select("repo", "path", "package", "struct", "start", "_i", F.coalesce("_name", "type").alias("field"), "type",
                    F.when(named & (F.col("_tag.key") == ""), F.lower("_name")).otherwise(F.col("_tag.key")).alias("json_tag"),
                    F.col("_tag.omitempty").alias("omitempty"), *more))
    w = Window.partitionBy("repo", "path", "struct").orderBy("start", "_i")
    return rows.select("repo", "path", "package", "struct", (F.row_number().over(w) - 1).alias("pos"),
                       "field", "type", "json_tag", "omitempty", *more)


_NAMED_TYPE = rf"(?s)^type\s+({IDENT})\s*=?\s*([^\s=\[({{][^({{]*|\[.*|map\[.*)$"


def named_types(source: DataFrame) -> DataFrame:
    """repo, path, package, name, target of types declared as another type: ``type UserID string``, ``type IDs = []UserID``.

    Structs, interfaces, functions and types with parameters are left out.
    """
    text = F.regexp_replace(F.col("s.text"), r"\s+", " ")
    rows = (_scanned(source, "types").select("repo", "path", "package", F.explode("statements").alias("s"))
            .where((F.col("s.depth") == 0) & text.rlike(_NAMED_TYPE)))
    target = G.type_text(F.regexp_extract(text, _NAMED_TYPE, 2))
    return (rows.select("repo", "path", "package", F.regexp_extract(text, _NAMED_TYPE, 1).alias("name"), target.alias("target"))
            .where(~F.col("target").contains("unknown") & ~F.col("target").rlike(r"(^|\W)(struct|interface)(\W|$)")))


_WRAPPED = r"^((?:[*]|\[\]|\.\.\.)*)(.*)$"


def _home(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def resolve_named_types(struct_fields: DataFrame, named: DataFrame) -> DataFrame:
    """``struct_fields`` with named types and aliases replaced by what they stand for, through any chain of them.

    A name without a package belongs to the field's directory and package; ``pkg.Name`` to
    the first directory (in order) of a package of that name.  A name that
    leads back to itself stays as it is.  One join per link of the longest chain.
    """
    n = named.select("repo", _home(F.col("path")).alias("_dir"), F.col("package").alias("_pkg"), F.col("name").alias("_name"),
                     F.col("target").alias("_target"))
    first = Window.partitionBy("repo", "_pkg", "_name").orderBy("_dir")
    n = n.groupBy("repo", "_dir", "_pkg", "_name").agg(F.min("_target").alias("_target"))
    n = n.withColumn("_first", F.row_number().over(first) == 1).withColumnRenamed("repo", "_repo").checkpoint()
    rows = struct_fields.withColumn("_at", _home(F.col("path"))).withColumn("_in", F.col("package")).withColumn(
        "_seen", F.array().cast("array<string>")).withColumn("_now", F.col("type")).withColumn("_open", F.lit(True))
    hit, key = F.col("_name").isNotNull(), F.concat_ws("\n", "_dir", "_pkg", "_name")
    again = hit & F.array_contains("_seen", key)
    while True:
        rows = rows.withColumn("_base", F.regexp_extract("_now", _WRAPPED, 2))
        dotted = F.col("_base").contains(".")
        same = (F.col("_open") & (F.col("repo") == F.col("_repo")) & (F.substring_index("_base", ".", -1) == F.col("_name"))
                & (F.when(dotted, F.substring_index("_base", ".", 1)).otherwise(F.col("_in")) == F.col("_pkg"))
                & F.when(dotted, F.col("_first")).otherwise(F.col("_at") == F.col("_dir")))
        rows = rows.join(n.hint("merge"), same, "left").select(
            *struct_fields.columns,
            F.when(again, F.col("type")).when(hit, F.concat(F.regexp_extract("_now", _WRAPPED, 1), F.col("_target")))
            .otherwise(F.col("_now")).alias("_now"),
            F.when(hit, F.col("_dir")).otherwise(F.col("_at")).alias("_at"),
            F.when(hit, F.col("_pkg")).otherwise(F.col("_in")).alias("_in"),
            F.when(hit, F.array_append("_seen", key)).otherwise(F.col("_seen")).alias("_seen"),
            (hit & ~again).alias("_open")).checkpoint()
        if rows.where("_open").isEmpty():
            break
    return rows.select(*[F.col("_now").alias("type") if c == "type" else F.col(c) for c in struct_fields.columns])


# ------------------------------------------------------------------ X3
_STRING = r'(?s)^("(?:[^"\\]|\\.)*"|`[^`]*`)$'


def _group_prefix(c):
    """The joined first arguments of the group calls around a call, from the outside in (``calls``: all of the file's)."""
    around = F.filter("calls", lambda g: g["name"].isin(*_GROUPS) & (F.size(g["args"]) >= 2) & (g["start"] < c["start"])
                      & (g["stop"] >= c["stop"]) & F.get(g["args"], F.lit(0)).rlike(_STRING))
    ordered = F.array_sort(F.transform(around, lambda g: F.struct(g["start"].alias("start"), g["args"].alias("args"))))
    return F.array_join(F.transform(ordered, lambda g: F.regexp_replace(F.get(g["args"], F.lit(0)), r"^[\"`]|/*[\"`]$", "")), "")


def extract_routes(source: DataFrame, groups: bool = False) -> DataFrame:
    """Repo, path, line, method, route, handler.

    ``.Verb("lit", h, ...)`` for the seven verbs (case-insensitive) on any
    receiver, also inside a chain of calls; ``HandleFunc``/``Handle`` with a
    'METHOD /path' pattern or method ANY.  Handler = second argument; line =
    where the receiver begins.  Non-literal or empty routes are dropped; a
    back-quoted literal keeps its back-quotes.  With ``groups`` a route inside
    ``x.Route("/prefix", func...)`` or ``x.Group("/prefix", func...)`` has that
    prefix, and those of the groups around it, before it.
    """
    verb = F.upper("c.name").isin(*G.HTTP_VERBS)
    first = F.get("c.args", F.lit(0))
    calls = (_scanned(source, "calls").select("repo", "path", *(["calls"] if groups else []), F.explode("calls").alias("c"))
             .where((verb | F.col("c.name").isin("HandleFunc", "Handle")) & (F.size("c.args") >= 2) & first.rlike(_STRING)))
    lit = F.when(first.startswith('"'), F.regexp_replace(first, '^"+|"+$', "")).otherwise(first)
    pat = G.parse_route_pattern(lit)
    method = F.when(verb, F.upper("c.name")).otherwise(F.coalesce(pat["method"], F.lit("ANY")))
    route = F.when(verb, lit).otherwise(F.coalesce(pat["path"], lit))
    prefix = _group_prefix(F.col("c")) if groups else F.lit("")
    out = calls.select("repo", "path", F.col("c.line").alias("line"), method.alias("method"), route.alias("route"),
                       G.handler_name(F.get("c.args", F.lit(1))).alias("handler"), prefix.alias("_prefix"))
    return out.where(F.col("route") != "").withColumn("route", F.concat("_prefix", "route")).drop("_prefix")


# ------------------------------------------------------------------ X4
def _param_type(p):
    """A parameter's rendered type: without its names (of ``a, b T`` the last carries it)."""
    bare = F.regexp_replace(p, rf"^{IDENT}\s+(?=\S)", "")
    return G.type_text(F.when(p.rlike(r"^(chan|func|map|struct|interface)\b"), p).otherwise(bare))


def _handlers(source: DataFrame) -> DataFrame:
    """One row per handler, with its file's arrays."""
    f = _scanned(source, "all").select("*", F.explode("funcs").alias("_f"))
    is_handler = F.exists("_f.params", lambda p: _param_type(p).rlike("ResponseWriter|Request|Context"))
    recv = F.regexp_replace(G.strip("_f.receiver"), rf"^{IDENT}\s+(?=\S)", "")
    return (f.where(F.col("_f.name").rlike("^\\p{Lu}") & is_handler)
            .select("repo", "path", "package", F.col("_f.block").alias("block"), F.col("_f.name").alias("name"),
                    F.when(recv == "", F.lit("")).otherwise(G.type_text(recv)).alias("receiver"), "statements", "calls"))


def extract_handlers(source: DataFrame) -> DataFrame:
    """Repo, path, package, block, name, receiver for exported functions whose
    parameter types mention ResponseWriter, Request or Context."""
    return _handlers(source).drop("statements", "calls")


# ------------------------------------------------------------------ X5
_VAR = f"(?s)^var\\s+({IDENT}(\\s*,\\s*{IDENT})*)\\s+([^=\\s][^=]*?)\\s*(=.*)?$"


def _locals(handlers: DataFrame) -> DataFrame:
    """``handlers`` with ``_locals``: (start, var, type) of its typed variables, in order."""
    h = handlers.withColumn("_s", F.filter("statements", lambda s: s["block"] == F.col("block")))
    declared = F.flatten(F.transform(F.filter("_s", lambda s: s["text"].rlike(_VAR)), lambda s: F.transform(
        F.split(F.regexp_extract(s["text"], _VAR, 1), "\\s*,\\s*"), lambda n: F.struct(
            s["start"].alias("start"), n.alias("var"), G.type_text(F.regexp_extract(s["text"], _VAR, 3)).alias("type")))))
    assigned = F.flatten(F.transform(F.filter("_s", lambda s: F.size(s["values"]) > 0), lambda s: F.zip_with(
        F.split(s["targets"], "\\s*,\\s*"), s["values"], lambda n, v: F.struct(
            s["start"].alias("start"), n.alias("var"), G.literal_type(v).alias("type")))))
    assigned = F.filter(assigned, lambda x: x["type"].isNotNull() & x["var"].rlike(f"^{IDENT}$"))
    return h.withColumn("_locals", F.array_sort(F.concat(declared, assigned))).drop("_s", "statements")


def local_types(source: DataFrame) -> DataFrame:
    """(repo, path, block, var, type) of each handler from ``var x T``, ``x := T{...}`` and
    ``x := &T{...}``, also in lists; the last assignment in the body wins."""
    rows = (_locals(_handlers(source)).select("repo", "path", "block", F.explode("_locals").alias("v"))
            .select("repo", "path", "block", "v.*"))
    return rows.groupBy("repo", "path", "block", "var").agg(F.max_by("type", "start").alias("type"))


# ------------------------------------------------------------------ X6, A8
def _resolved(arg, locals_):
    """The type name an argument stands for: a variable's type, an inline literal's, or a dotted name; else ''."""
    bare = F.regexp_replace(arg, r"^(?:[&!+\-^]|<-)\s*", "")
    own = F.try_element_at(F.filter(locals_, lambda x: x["var"] == bare), F.lit(-1))["type"]
    name = G.handler_name(bare)
    return (F.when(bare.rlike(f"^{IDENT}$"), F.coalesce(own, bare))
            .when(name.rlike(r"\.") & ~bare.startswith('"'), name)
            .otherwise(F.coalesce(G.literal_type(bare), F.lit(""))))


def _handler_call_rows(source: DataFrame) -> DataFrame:
    """Handlers with ``_calls``: their decode, encode and status calls in the order in which a reader of the syntax
    tree meets them (an outer call before those inside it)."""
    h = _locals(_handlers(source))
    mine = F.filter("calls", lambda c: (c["block"] == F.col("block")) & (F.size(c["args"]) > 0))
    ordered = F.array_sort(F.transform(mine, lambda c: F.struct(
        c["start"].alias("start"), (-c["stop"]).alias("stop"), c["line"].alias("line"), c["name"].alias("name"),
        c["args"].alias("args"))))

    def row(c, kind, arg, resolved):
        # what a call without a kind stands for is not worked out
        return F.struct(c["line"].alias("line"), c["start"].alias("start"), c["stop"].alias("stop"), kind.alias("kind"),
                        arg.alias("arg"), F.when(kind.isNotNull(), resolved).alias("resolved"))

    def typed(c):
        kind = F.when(c["name"].isin(*G.DECODE_CALLS), "decode").when(c["name"].isin(*G.ENCODE_CALLS), "encode")
        last = F.element_at(c["args"], -1)
        return row(c, kind, last, _resolved(last, F.col("_locals")))

    def status(c):
        has = (c["name"] == "WriteHeader") | (c["name"].isin("JSON", "JSONP") & (F.size(c["args"]) >= 2))
        first = F.get(c["args"], F.lit(0))
        code = G.status_code(first)
        return row(c, F.when(has & (code > 0), "status"), first, code.cast("string"))

    both = F.flatten(F.transform("_c", lambda c: F.array(typed(c), status(c))))
    return (h.withColumn("_c", ordered)
            .withColumn("_calls", F.filter(both, lambda x: x["kind"].isNotNull())).drop("_c", "calls", "_locals"))


def _only(rows: DataFrame, handlers: DataFrame | None) -> DataFrame:
    return rows if handlers is None else rows.join(handlers.select("repo", "path", "block"), ["repo", "path", "block"], "left_semi")


def handler_calls(source: DataFrame, handlers: DataFrame | None = None) -> DataFrame:
    """Decode / encode / status calls inside handler bodies, arguments resolved.

    repo, path, block, line, kind, arg, resolved (type name for decode/encode,
    code for status), call_pos.  The resolved type of ``&x``/``x`` comes from
    X5, an inline ``T{...}`` gives ``T``, a dotted name is kept, any other
    expression gives ''.  handlers: keeps only those.
    """
    rows = _only(_handler_call_rows(source), handlers)
    return (rows.select("repo", "path", "block", F.posexplode("_calls").alias("call_pos", "c"))
            .select("repo", "path", "block", "c.line", "c.kind", "c.arg", "c.resolved", "call_pos"))


def collect_handler_calls(source: DataFrame, handlers: DataFrame | None = None) -> DataFrame:
    """A8 + X4: handlers with last decode type, last encode type and status codes in order."""
    rows = _only(_handler_call_rows(source), handlers)
    of = lambda kind: F.transform(F.filter("_calls", lambda c: c["kind"] == kind), lambda c: c["resolved"])
    last = lambda kind: F.coalesce(F.try_element_at(of(kind), F.lit(-1)), F.lit(""))
    return rows.select("repo", "path", "package", "block", "name", "receiver", last("decode").alias("decodes"),
                       last("encode").alias("encodes"),
                       F.transform(of("status"), lambda c: c.cast("int")).alias("status_codes"))
