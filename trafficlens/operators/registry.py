"""Endpoint registry: build (J3), field expansion (J4), summaries (A2-A4), detail (Q1),
persistence (S2, S3).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trafficlens import schemas
from trafficlens.functions import gosrc as G
from trafficlens.functions.paths import normalize_param
from trafficlens.operators import extract as X
from trafficlens.session import delete, list_names, path_exists, ship_package, stored


def directory(path: F.Column) -> F.Column:
    """A file's directory: what makes a package, besides its name."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _struct_lookup(refs: DataFrame, structs: DataFrame, type_col: str, home_dir: str, out: str,
                   key_cols: list[str]) -> DataFrame:
    """Resolve ``type_col`` of each ref row (unique by ``key_cols``) to a struct of the same repo.

    Qualified ``pkg.Name`` must match the package name; an unqualified name
    prefers the struct in ``home_dir``; then the lowest (directory, package,
    path) counts.  Adds ``{out}_struct``, ``{out}_package``, ``{out}_dir``,
    ``{out}_array`` (NULL struct when not found).  The structs are never
    broadcast: the planner takes their size for that of the small table they
    were made from.
    """
    r = refs.withColumn("_ref", G.type_ref(F.col(type_col)))
    s = structs.select(F.col("repo").alias("_srepo"), F.col("package").alias("_spkg"),
                       F.col("struct").alias("_sname"), F.col("path").alias("_spath")).distinct()
    cond = ((F.col("repo") == F.col("_srepo")) & (F.col("_ref.name") == F.col("_sname"))
            & ((F.col("_ref.pkg") == "") | (F.col("_ref.pkg") == F.col("_spkg"))))
    j = r.join(s.hint("merge"), cond, "left")
    cand = F.when(F.col("_sname").isNotNull(), F.struct(
        ((F.col("_ref.pkg") == "") & ~F.col(home_dir).eqNullSafe(directory(F.col("_spath")))).alias("_away"),
        directory(F.col("_spath")).alias("_sdir"), F.col("_spkg"), F.col("_spath"), F.col("_sname")))
    j = (j.withColumn("_cand", cand).withColumn("_best", F.min("_cand").over(Window.partitionBy(*key_cols)))
         .where(F.col("_best").isNull() | (F.col("_cand") == F.col("_best"))))
    return (j.withColumn(f"{out}_struct", F.col("_best._sname"))
            .withColumn(f"{out}_package", F.col("_best._spkg"))
            .withColumn(f"{out}_dir", F.col("_best._sdir"))
            .withColumn(f"{out}_array", F.col("_ref.is_array"))
            .drop("_ref", "_srepo", "_spkg", "_sname", "_spath", "_cand", "_best"))


def build_registry(routes: DataFrame, handlers: DataFrame, struct_fields: DataFrame,
                   repo_to_dependency: DataFrame | None = None) -> DataFrame:
    """One endpoint per route.

    route -> handler by the last dotted part of the route's handler name in the
    same repo (ambiguity: same directory first, then lowest (path, block);
    flagged); request / response struct from the handler's decodes / encodes;
    status = first 2xx in handler order, else 200; ':id' params become '{id}'.
    """
    r = routes.withColumn("_hname", F.substring_index(F.col("handler"), ".", -1)).withColumn(
        "_dir", directory(F.col("path")))
    h = handlers.select("repo", F.col("name").alias("_hname"), F.col("path").alias("_hpath"),
                        F.col("block").alias("_hblock"),
                        directory(F.col("path")).alias("_hdir"), "decodes", "encodes", "status_codes")
    j = r.join(h.hint("merge"), ["repo", "_hname"], "left")  # no broadcast, as in _struct_lookup
    same_dir = F.col("_hdir") == F.col("_dir")
    w = Window.partitionBy("repo", "path", "line")
    pick = F.struct((~F.coalesce(same_dir, F.lit(False))).alias("_o"), F.col("_hpath"), F.col("_hblock"))
    j = (j.withColumn("_n", F.count("_hpath").over(w))
         .withColumn("_best", F.min(pick).over(w))
         .where(F.col("_hpath").isNull() | (pick == F.col("_best"))))
    structs = struct_fields.select("repo", "package", "struct", "path")
    j = _struct_lookup(j, structs, "decodes", "_hdir", "req", ["repo", "path", "line"])
    j = _struct_lookup(j, structs, "encodes", "_hdir", "resp", ["repo", "path", "line"])
    norm_path = F.array_join(F.transform(F.split(F.col("route"), "/"), normalize_param), "/")
    status = F.coalesce(F.get(F.filter("status_codes", lambda c: (c >= 200) & (c < 300)), 0), F.lit(200))
    dep = F.col("repo")
    out = j.select(
        dep.alias("dependency"), "repo", "path", "line", "method", norm_path.alias("endpoint_path"),
        "handler",
        F.concat(F.col("method"), F.lit(" "), norm_path, F.lit(" handled by "), F.col("handler")).alias("description"),
        F.when(F.col("decodes") != "", F.coalesce("req_struct", "decodes")).alias("request_type"),
        F.when(F.col("encodes") != "", F.coalesce("resp_struct", "encodes")).alias("response_type"),
        F.when(F.col("decodes") != "", F.col("req_dir")).alias("request_dir"),
        F.when(F.col("decodes") != "", F.col("req_package")).alias("request_package"),
        F.when(F.col("encodes") != "", F.col("resp_dir")).alias("response_dir"),
        F.when(F.col("encodes") != "", F.col("resp_package")).alias("response_package"),
        F.when(F.col("resp_array") & (F.col("encodes") != ""), "array").otherwise("object").alias("body_type"),
        status.cast("int").alias("status_code"),
        (F.col("_n") > 1).alias("ambiguous"))
    if repo_to_dependency is not None:
        out = out.join(repo_to_dependency.select(F.col("repo"), F.col("name").alias("_dep")), "repo", "left") \
            .withColumn("dependency", F.coalesce("_dep", "dependency")).drop("_dep")
    wo = Window.partitionBy("dependency").orderBy("path", "line")
    return out.withColumn("ord", (F.row_number().over(wo) - 1).cast("int"))


_INSTANCE = rf"(?s)^((?:[*]|\[\]|\.\.\.)*)(?!map\[)({G.IDENT}(?:\.{G.IDENT})?)\[(.*)\]$"


def _type_args(text) -> F.Column:
    """The arguments of a generic type, split at the commas that stand in no bracket of their own."""
    def open_(t):
        return F.length(F.replace(t, F.lit("["), F.lit(""))) != F.length(F.replace(t, F.lit("]"), F.lit("")))

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        return F.when((F.size(acc) > 0) & open_(last), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.concat(last, F.lit(","), x))) \
            .otherwise(F.array_append(acc, G.strip(x)))

    return F.aggregate(F.split(text, ","), F.array().cast("array<string>"), step)


def _with_args(text, params, args) -> F.Column:
    """A type's text with type parameters replaced by their arguments, all at once."""
    name = lambda p: F.concat(F.lit(r"(?<![\w.])"), p, F.lit(r"(?!\w)"))
    spot = lambda i: F.concat(F.lit("\x01"), i.cast("string"), F.lit("\x02"))
    each = F.sequence(F.lit(0), F.size(params) - 1)
    marked = F.aggregate(each, text, lambda t, i: F.regexp_replace(t, name(F.get(params, i)), spot(i)))
    filled = F.aggregate(each, marked, lambda t, i: F.replace(t, spot(i), F.coalesce(F.get(args, i), F.get(params, i))))
    return F.when((F.size(params) > 0) & (F.size(args) > 0), filled).otherwise(text)


#: Fields of a repo that one task expands together; a larger repo's are expanded level by level, by joins.
WALK_FIELDS = 20_000
#: Rows of an expansion that a task holds before it hands them on.
_WALK_ROWS = 20_000


def expand_fields(struct_fields: DataFrame) -> DataFrame:
    """Every struct fully expanded into (repo, root_dir, root_package, root, field_path, depth, ...).

    Nested and ``[]struct`` fields are inlined (children under
    ``parent.child`` / ``parent[].child``); embedded structs are flattened
    into the parent level; ``json:"-"`` fields are dropped.  A struct is known
    by its directory, package and name; one that repeats on its own path
    stops there, and nothing else does, so the expansion ends with the longest
    path.  What a field's type names is looked up once for each field; a
    repo's fields then come together in one task, which walks its structs and
    hands the rows on as it goes, so that no path is shuffled or stored.
    A repo of more than ``WALK_FIELDS`` fields is expanded by joins instead
    (``_expand_by_level``), with the same rows.

    With X2's columns source_type and type_params (``generics``) a field of
    type ``Page[User]`` expands to the fields of Page with User in place of its
    parameter, by joins for every repo.  A generic struct stops where it repeats on its own path with
    arguments that hold the ones it had.
    """
    sf = struct_fields.where(F.col("json_tag") != "-").withColumn("dir", directory(F.col("path")))
    if "source_type" in sf.columns:
        return _expand_by_level(sf.withColumn("_embeds", F.col("field") == F.col("type")).checkpoint())
    sf = sf.withColumn("source_type", F.col("type")).withColumn("type_params", F.array().cast("array<string>"))
    typed = stored(sf.withColumn("_embeds", F.col("field") == F.col("type")), "fields")[0]
    large = typed.groupBy("repo").count().where(F.col("count") > WALK_FIELDS).select(F.col("repo").alias("_large")).checkpoint()
    if large.isEmpty():
        return _expand_by_walk(typed)
    same = F.col("repo").eqNullSafe(F.col("_large"))
    return _expand_by_walk(typed.join(large.hint("merge"), same, "left_anti")).unionByName(
        _expand_by_level(typed.join(large.hint("merge"), same, "left_semi").checkpoint()))


def _typed_lookup(fields: DataFrame, structs: DataFrame, key_cols: list[str]) -> DataFrame:
    """``fields`` with ``type`` without its arguments (``_inside``), ``_m`` (F11) and the child struct it names."""
    written = _with_args(F.col("source_type"), F.col("type_params"), F.col("_args"))
    level = fields.withColumn("_written", written).withColumn("_inside", F.regexp_extract("_written", _INSTANCE, 3))
    plain = F.when((F.size("_args") > 0) & (F.size("type_params") > 0), G.type_text(F.col("_written"))).otherwise(F.col("type"))
    level = level.withColumn("type", F.when(F.col("_inside") != "", F.concat(
        F.regexp_extract("_written", _INSTANCE, 1), F.regexp_extract("_written", _INSTANCE, 2))).otherwise(plain))
    level = level.withColumn("_m", G.map_source_type(F.col("type")))
    return _struct_lookup(level, structs, "type", "_dir", "child", key_cols)


def _shown_columns() -> dict:
    """What a looked-up field shows, whatever its path."""
    key = F.when(F.col("json_tag") == "", F.lower("name")).otherwise(F.col("json_tag"))
    return {
        "name": F.col("name"), "json_key": key,
        "json_type": F.when(F.col("child_struct").isNotNull() & (F.col("_m.json_type") == "ref"), F.lit("object"))
        .otherwise(F.col("_m.json_type")),
        "format": F.col("_m.format"),
        "item_type": F.when(F.col("child_struct").isNotNull() & F.col("_m.json_type").isin("array"), F.lit("object"))
        .otherwise(F.col("_m.item_type")),
        "required": ~F.col("omitempty"), "nullable": F.col("_m.nullable")}


_ROOT = ["repo", "root_dir", "root_package", "root"]
_SHOWN = ["name", "json_key", "json_type", "format", "item_type", "required", "nullable"]
#: Of a looked-up field, what a walk reads: the struct it stands in, its place there, and where it leads.
_STEP = ["_dir", "package", "struct", "_pos", "json_key", "_emits", "_flat", "_step", "_inside", "child_dir", "child_package", "child_struct"]


def _walked(fields: list[tuple]) -> Iterator[tuple]:
    """(a row of the root struct, row of the field, path, depth, pos) of all that a repo's structs (_STEP) expand to.

    Rows of one struct and place (a field that is there twice) stand at one place of the order, and all of
    them lead to one struct (_struct_lookup); each is a way of its own into it.
    """
    structs: dict[tuple, list[list[int]]] = {}
    for i in sorted(range(len(fields)), key=lambda i: (fields[i][3] is not None, fields[i][3])):
        places = structs.setdefault(fields[i][:3], [])
        if places and fields[places[-1][0]][3] == fields[i][3]:
            places[-1].append(i)
        else:
            places.append([i])
    for root, places in structs.items():
        pos, todo = 0, [(iter(places), [("", 0, ((root, ""),))])]
        while todo:
            place, ways = next(todo[-1][0], None), todo[-1][1]
            if place is None:
                todo.pop()
                continue
            below = []
            for i in place:
                _, _, _, _, key, emits, flat, step, inside, *child = fields[i]
                for prefix, depth, seen in ways:
                    if emits:
                        yield places[0][0], i, None if prefix is None or key is None else prefix + key, depth, pos
                        pos += 1
                    target = tuple(child)
                    if child[2] is None or any(s == target and args in inside for s, args in seen):
                        continue
                    into = prefix if flat else None if prefix is None or step is None else prefix + step
                    below.append((into, depth if flat else depth + 1, (*seen, (target, inside))))
            if below:
                todo.append((iter(structs.get(target, ())), below))


def _expand_by_walk(typed: DataFrame) -> DataFrame:
    """J4 for repos whose fields a task can hold: the fields are shuffled, what they expand to is not."""
    ship_package(typed.sparkSession)
    structs = typed.select("repo", "package", "struct", "path").distinct()
    fields = typed.select("repo", F.col("dir").alias("_dir"), "package", "struct", F.col("pos").alias("_pos"), F.col("field").alias("name"),
                          "type", "json_tag", "omitempty", "source_type", "type_params", "_embeds", F.array().cast("array<string>").alias("_args"))
    found = _typed_lookup(fields, structs, ["repo", "_dir", "package", "struct", "_pos"])
    shown = _shown_columns()
    embedded = F.col("_embeds") & F.col("child_struct").isNotNull()
    rows = found.select("repo", *[c.alias(n) for n, c in shown.items()], F.coalesce(~embedded, F.lit(False)).alias("_emits"),
                        F.coalesce(embedded, F.lit(False)).alias("_flat"),
                        F.concat(shown["json_key"], F.when(F.col("child_array"), F.lit("[].")).otherwise(F.lit("."))).alias("_step"),
                        *[c for c in _STEP if c not in ("json_key", "_emits", "_flat", "_step")])
    rows = stored(rows, "looked-up")[0]
    of = {f.name: f.dataType for f in rows.schema.fields}
    made = T.StructType([T.StructField(n, T.StringType()) for n in (*_ROOT, "field_path")] + [T.StructField("depth", T.IntegerType())]
                        + [T.StructField(n, of[n]) for n in _SHOWN] + [T.StructField("pos", T.IntegerType())])
    arrow = to_arrow_schema(made)

    def batch(t: pa.Table, got: list[tuple]) -> pa.RecordBatch:
        root, field, path, depth, pos = (list(c) for c in zip(*got))
        root, field = pa.array(root), pa.array(field)
        columns = [t.column(c).take(root) for c in ("repo", "_dir", "package", "struct")] + [path, depth]
        columns += [t.column(c).take(field) for c in _SHOWN] + [pos]
        return pa.RecordBatch.from_arrays([(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type)).cast(f.type)
                                           for c, f in zip(columns, arrow)], schema=arrow)

    def expanded(t: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        steps, got = list(zip(*(t.column(c).to_pylist() for c in _STEP))), []
        for lo, hi in zip(starts, starts[1:]):
            for root, field, *row in _walked(steps[lo:hi]):
                got.append((lo + root, lo + field, *row))
                if len(got) == _WALK_ROWS:
                    yield batch(t, got)
                    got = []
        if got:
            yield batch(t, got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last repo so far, which may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            repos = t.column("repo").to_pylist()
            starts = [i for i in range(len(repos)) if i == 0 or repos[i] != repos[i - 1]]
            yield from expanded(t, starts)
            rest = t.slice(starts[-1]) if starts else None
        if rest is not None:
            yield from expanded(rest, [0, rest.num_rows])

    return rows.repartition("repo").sortWithinPartitions("repo").mapInArrow(run, made)


def _expand_by_level(typed: DataFrame) -> DataFrame:
    """J4 by joins: each level is one equi-join of the frontier with the field table and is checkpointed once its types
    are looked up, so the plan stays linear in depth and no level is made twice."""
    structs = typed.select("repo", "package", "struct", "path").distinct().checkpoint()
    roots = _ROOT
    name_of = lambda d, p, s: F.concat_ws("\n", d, p, s)  # noqa: E731 - no path has a newline in this corpus layout
    own = ["pos", F.col("field").alias("name"), "type", "json_tag", "omitempty", "source_type", "type_params", "_embeds"]
    level = (typed.select(
        "repo", F.col("dir").alias("root_dir"), F.col("package").alias("root_package"), F.col("struct").alias("root"),
        F.col("dir").alias("_dir"), *own, F.array().cast("array<string>").alias("_args"),
        F.array(F.struct(name_of("dir", "package", "struct").alias("key"), F.lit("").alias("args"))).alias("_seen"),
        F.lit("").alias("_prefix"), F.lit(0).alias("depth"), F.array(F.col("pos")).alias("_order")))
    out_levels = []
    while True:
        level = _typed_lookup(level, structs, [*roots, "_order"]).checkpoint()
        if out_levels and level.isEmpty():
            break
        embedded = F.col("_embeds") & F.col("child_struct").isNotNull()
        shown = _shown_columns()
        key = shown["json_key"]
        emit = level.where(~embedded).select(*roots, F.concat("_prefix", key).alias("field_path"), "depth", "_order",
                                             *[c.alias(n) for n, c in shown.items()])
        out_levels.append(emit)
        child = name_of("child_dir", "child_package", "child_struct")
        repeats = F.exists("_seen", lambda s: (s["key"] == child) & F.col("_inside").contains(s["args"]))
        grow = level.where(F.col("child_struct").isNotNull() & ~repeats)
        child_prefix = F.when(embedded, F.col("_prefix")).otherwise(
            F.concat(F.col("_prefix"), key, F.when(F.col("child_array"), F.lit("[].")).otherwise(F.lit("."))))
        parents = grow.select(
            *roots, F.col("child_struct").alias("_cs"), F.col("child_package").alias("_cp"),
            F.col("child_dir").alias("_cd"),
            F.array_append("_seen", F.struct(child.alias("key"), F.col("_inside").alias("args"))).alias("_seen"),
            child_prefix.alias("_prefix"),
            F.when(F.col("_inside") != "", _type_args(F.col("_inside"))).otherwise(F.array().cast("array<string>")).alias("_args"),
            F.when(embedded, F.col("depth")).otherwise(F.col("depth") + 1).alias("depth"),
            F.col("_order").alias("_porder"))
        kids = typed.select("repo", F.col("dir").alias("_cd"), F.col("package").alias("_cp"),
                            F.col("struct").alias("_cs"), F.col("dir").alias("_dir"), *own)
        level = (parents.join(kids.hint("merge"), ["repo", "_cd", "_cp", "_cs"])
                 .withColumn("_order", F.concat("_porder", F.array(F.col("pos"))))
                 .drop("_cd", "_cp", "_cs", "_porder"))
    out = out_levels[0]
    for o in out_levels[1:]:
        out = out.unionByName(o)
    w = Window.partitionBy(*roots).orderBy("_order")
    return out.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).drop("_order")


def registry_summary(endpoints: DataFrame, dependencies: DataFrame, frameworks: DataFrame) -> DataFrame:
    """A2: dependency, endpoint count (0 kept), framework."""
    counts = endpoints.groupBy("dependency").agg(F.count(F.lit(1)).alias("endpoints"))
    d = dependencies.select(F.col("name").alias("dependency"), "repo")
    return (d.join(counts.hint("merge"), "dependency", "left").join(frameworks.hint("merge"), "repo", "left")
            .select("dependency", F.coalesce("endpoints", F.lit(0)).cast("long").alias("endpoints"),
                    F.coalesce("framework", F.lit("unknown")).alias("framework")))


def scan_summary(repos: DataFrame, struct_fields: DataFrame, routes: DataFrame, handlers: DataFrame,
                 frameworks: DataFrame) -> DataFrame:
    """A3: per repo #structs, #routes, #handlers, framework, plus a grand-total row (repo NULL)."""
    ns = struct_fields.select("repo", "path", "struct").distinct().groupBy("repo").agg(F.count(F.lit(1)).alias("structs"))
    nr = routes.groupBy("repo").agg(F.count(F.lit(1)).alias("routes"))
    nh = handlers.groupBy("repo").agg(F.count(F.lit(1)).alias("handlers"))
    per = (repos.select("repo").distinct().join(ns.hint("merge"), "repo", "left").join(nr.hint("merge"), "repo", "left")
           .join(nh.hint("merge"), "repo", "left").join(frameworks.hint("merge"), "repo", "left")
           .select("repo", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("structs", "routes", "handlers")],
                   F.coalesce("framework", F.lit("unknown")).alias("framework")))
    return per.rollup("repo").agg(
        F.sum("structs").alias("structs"), F.sum("routes").alias("routes"), F.sum("handlers").alias("handlers"),
        F.max("framework").alias("_fw"), F.grouping("repo").cast("int").alias("is_total")
    ).select("repo", "structs", "routes", "handlers",
             F.when(F.col("is_total") == 1, F.lit(None).cast("string")).otherwise(F.col("_fw")).alias("framework"),
             "is_total")


def scan_quality_gate(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: (accepted, rejected) repos; a repo with no structs, routes or handlers is rejected."""
    per = summary.where(F.col("is_total") == 0)
    empty = (F.col("structs") + F.col("routes") + F.col("handlers")) == 0
    rejected = per.where(empty).select("repo", F.lit("no structs, routes or handlers found").alias("reason"))
    return per.where(~empty).drop("is_total"), rejected


def registry_detail(endpoints: DataFrame, dependency: str) -> DataFrame:
    """Q1: all endpoints of one dependency in registry order (empty = not found)."""
    return endpoints.where(F.col("dependency") == dependency).orderBy("ord")


# ------------------------------------------------------------------ S2, S3
def write_registry(endpoints: DataFrame, fields: DataFrame, frameworks: DataFrame, path: str,
                   scanned_at: str | None = None) -> None:
    """One JSON document per dependency (registry with nested endpoint list and flat body fields)."""
    ts = F.current_timestamp() if scanned_at is None else F.lit(scanned_at).cast("timestamp")
    key = ["repo", "root_dir", "root_package", "root"]
    fl = fields.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(
        "field_path", "depth", "name", "json_key", F.col("json_type").alias("type"), "format", "required", "item_type",
        "nullable").alias("_f")))), lambda x: x["_f"]).alias("_fields"))
    e = endpoints
    for kind in ("request", "response"):
        named = [F.col(r).alias(f"{kind}_{n}") for r, n in zip(key[1:], ("dir", "package", "type"))]
        e = e.join(fl.select("repo", *named, F.col("_fields").alias(f"{kind}_fields")).hint("merge"),
                   ["repo", f"{kind}_dir", f"{kind}_package", f"{kind}_type"], "left")
    body = lambda kind, shape: F.when(F.col(f"{kind}_type").isNotNull(), F.struct(
        shape.alias("type"), F.col(f"{kind}_type").alias("struct"), F.col(f"{kind}_dir").alias("dir"),
        F.col(f"{kind}_package").alias("package"), F.col(f"{kind}_fields").alias("fields")))
    ep = F.struct(F.col("method"), F.col("endpoint_path").alias("path"), F.col("description"),
                  body("request", F.lit("object")).alias("request_body"),
                  body("response", F.col("body_type")).alias("response_body"), F.col("status_code"))
    docs = (e.groupBy("dependency", "repo")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", ep.alias("e")))), lambda x: x["e"])
                 .alias("endpoints"))
            .join(frameworks.hint("merge"), "repo", "left")
            .select(ts.alias("scanned_at"), "dependency", F.col("repo").alias("repo_path"),
                    F.coalesce("framework", F.lit("unknown")).alias("framework_detected"), "endpoints"))
    docs.write.mode("overwrite").json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Endpoint rows as J3 makes them (with framework and the flat body fields) from persisted registries."""
    docs = spark.read.schema(schemas.REGISTRY_DOC).json(path)
    rows = docs.select("dependency", F.col("repo_path").alias("repo"), "framework_detected",
                       F.posexplode_outer("endpoints").alias("ord", "e"))
    bodies = [F.col(f"e.{k}_body.{f}").alias(f"{k}_{n}") for k in ("request", "response")
              for f, n in (("struct", "type"), ("dir", "dir"), ("package", "package"), ("fields", "fields"))]
    return rows.select("dependency", "repo", "framework_detected", F.col("ord").cast("int").alias("ord"),
                       F.col("e.method").alias("method"), F.col("e.path").alias("endpoint_path"),
                       F.col("e.description").alias("description"), F.col("e.status_code").alias("status_code"), *bodies,
                       F.coalesce("e.response_body.type", F.lit("object")).alias("body_type"))


def registry_fields(registry: DataFrame) -> DataFrame:
    """J4's field rows of the structs that a read registry names, so that prompts and bodies need no new scan."""
    out = None
    for kind in ("request", "response"):
        part = (registry.where(F.col(f"{kind}_fields").isNotNull())
                .select("repo", F.col(f"{kind}_dir").alias("root_dir"), F.col(f"{kind}_package").alias("root_package"),
                        F.col(f"{kind}_type").alias("root"), F.posexplode(f"{kind}_fields").alias("pos", "f"))
                .select("repo", "root_dir", "root_package", "root", "pos", "f.field_path", "f.depth", "f.name",
                        "f.json_key", F.col("f.type").alias("json_type"), "f.format", "f.item_type", "f.required",
                        "f.nullable"))
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["repo", "root_dir", "root_package", "root", "pos"])


def load_or_scan(spark: SparkSession, path: str, scan, rescan: bool = False) -> DataFrame:
    """S3: reuse a persisted, non-empty registry unless ``rescan``; else run
    ``scan()`` (which must write the registry to ``path``) and read it back."""
    if not rescan:
        try:
            reg = read_registry(spark, path)
            if not reg.where(F.col("method").isNotNull()).isEmpty():
                return reg
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # only an absent registry means: scan
                raise
    scan()
    return read_registry(spark, path)


# ------------------------------------------------------------ rescan of changed files
def _overwrite(spark: SparkSession, rows: DataFrame, path: str, touched: list[str]) -> None:
    """Replaces the buckets ``touched`` by ``rows`` (all of them in these buckets); one left without rows is removed."""
    rows, at = stored(rows, "rescan-rows")
    (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))
    have = {r[0] for r in rows.select("bucket").distinct().collect()}
    delete(spark, at, *[f"{path}/bucket={b}" for b in touched if b not in have])


def rescan(spark: SparkSession, files: DataFrame, path: str, buckets: int = 64) -> tuple[DataFrame, int]:
    """S3 for a corpus that changes: (endpoints as J3 gives them for all files, how many files were extracted).

    files: (repo, path, content), the whole corpus, already filtered (S1).
    Under ``path`` lie what was found in each file, with the digest of its
    text, and the endpoints; both by buckets of repos.  Only files that are
    new or differ are extracted, only buckets with such files or with removed
    ones are rewritten, and only their repos' endpoints are joined again.
    Files that do not parse are remembered too.  A run that ended early is
    repaired by the next: a file's digest is written with what was found in it,
    and buckets whose endpoints were not written are in ``_pending``.
    """
    scan_path, end_path, pending = f"{path}/scan", f"{path}/endpoints", f"{path}/_pending"
    bucket = F.concat(F.lit("b"), F.pmod(F.xxhash64("repo"), F.lit(buckets)).cast("string"))
    now = files.select("repo", "path", F.sha2("content", 256).alias("digest"), bucket.alias("bucket"))
    known = (spark.read.schema("repo string, path string, digest string, bucket string").parquet(scan_path)
             if path_exists(spark, scan_path) else now.limit(0))
    old = known.select("repo", "path", F.col("digest").alias("_old"), F.col("bucket").alias("_b"))
    diff = (now.join(old, ["repo", "path"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("_old")))
            .select("repo", "path", "digest", F.coalesce("bucket", "_b").alias("bucket")).checkpoint())
    touched = sorted({r[0] for r in diff.select("bucket").distinct().collect()}
                     | {n[2:] for n in list_names(spark, pending) if n.startswith("b=")})
    diff = diff.hint("merge")  # no broadcast, as in _struct_lookup: neither the files nor what they hold fit the driver
    changed = diff.where(F.col("digest").isNotNull())
    n = changed.count()
    if touched:
        spark.createDataFrame([(b,) for b in touched], "b string").withColumn("x", F.lit(1)).write.mode("append").partitionBy("b").parquet(pending)
        found = X.scan_source(files.join(changed.select("repo", "path"), ["repo", "path"], "left_semi"))
        fresh = changed.join(found.hint("merge"), ["repo", "path"], "left")
        kept = None
        if path_exists(spark, scan_path):
            kept = (spark.read.schema(fresh.schema).parquet(scan_path).where(F.col("bucket").isin(touched))
                    .join(diff.select("repo", "path"), ["repo", "path"], "left_anti"))
        _overwrite(spark, fresh if kept is None else kept.select(*fresh.columns).unionByName(fresh), scan_path, touched)
        again = spark.read.schema(fresh.schema).parquet(scan_path).where(F.col("bucket").isin(touched) & F.col("package").isNotNull())
        ends = build_registry(X.extract_routes(again).checkpoint(), X.collect_handler_calls(again).checkpoint(),
                              X.extract_struct_fields(again).checkpoint())
        _overwrite(spark, ends.withColumn("bucket", bucket), end_path, touched)
        delete(spark, pending)
    out = spark.read.parquet(end_path) if any(x.startswith("bucket=") for x in list_names(spark, end_path)) else None
    if out is None:
        empty = X.scan_source(files.limit(0))
        return build_registry(X.extract_routes(empty), X.collect_handler_calls(empty), X.extract_struct_fields(empty)), n
    return out.drop("bucket"), n
