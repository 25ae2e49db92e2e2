"""Request -> endpoint matching (theta join with first-match precedence).

A request matches an endpoint when the normalised path starts with the
dependency prefix (raw characters), the method is equal or the endpoint says
``ANY``, the stripped path has as many segments as the pattern, and every
literal segment is equal.  Among the candidates the first by
(prefix length desc, registry order) wins; a dependency without a configured
prefix is served at '/'.

Two physical forms:

* ``array``: the ordered route list is one small value attached to every row
  through a scalar subquery and scanned with ``filter``.  No shuffle at all.
  Used while the registry is at most ``array_max_routes`` routes (checked).
* ``hash``: the first characters of the paths, as many as the longest prefix
  has, are expanded by the registry's distinct prefix lengths and meet the
  routes of their prefixes, of which those stay that such a path can fit; the
  requests meet their routes in one join that Spark can split, and the first
  that fits wins.  For prefixes of more than ``INLINE_ROUTES`` routes each
  distinct (method, path) is expanded instead, and candidates are found with
  equi-joins on (prefix, segment count, parameter mask) and (…, masked
  literal key): the cost grows with requests x prefix lengths, not requests x
  routes; the longer prefix of both wins.

Both forms give the same rows, also for repeated request ids (tested).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.paths import (normalize_path, params_from_segments, path_segments,
                                         pattern_segments)
from trafficlens.session import stored

_REST = 1 << 30
MATCH_COLS = ["dependency", "endpoint_method", "endpoint_path", "endpoint_ord", "status_code", "path_params"]


def prepare_routes(endpoints: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """Endpoints with their dependency prefix, parsed pattern and priority.

    ``dependencies`` (name, prefix) is a small configuration dimension; an
    endpoint whose dependency has no prefix is served at '/'.
    """
    if dependencies is not None:
        deps = dependencies.select(F.col("name").alias("_dep"), F.col("prefix").alias("_prefix"))
        ep = endpoints.join(deps, endpoints["dependency"] == deps["_dep"], "left").drop("_dep")
    else:
        ep = endpoints.withColumn("_prefix", F.col("prefix") if "prefix" in endpoints.columns else F.lit(None))
    pfx = normalize_path(F.coalesce(F.col("_prefix"), F.lit("/")))
    psegs = pattern_segments(F.col("path"))
    out = ep.select(
        F.col("dependency"), F.col("ord").cast("int").alias("ord"),
        F.col("method").alias("ep_method"), F.col("path").alias("ep_path"),
        F.col("status_code").cast("int").alias("status_code"),
        pfx.alias("pfx"), psegs.alias("psegs"))
    return out.select(
        "*",
        F.length("pfx").alias("plen"),
        F.size("psegs").alias("nseg"),
        F.array_join(F.transform("psegs", lambda s: F.when(s["is_param"], "1").otherwise("0")), "").alias("mask"),
        F.array_join(F.transform("psegs", lambda s: F.when(s["is_param"], "").otherwise(s["value"])), "/")
        .alias("mkey"))


def registry_priority(routes: DataFrame) -> DataFrame:
    """Routes in match order (prefix length desc, then registry order)."""
    return routes.select("dependency", "ord", "ep_method", "ep_path", "pfx", "plen").orderBy(
        F.col("plen").desc(), F.col("ord").asc())


def _route_struct(r: DataFrame) -> Column:
    return F.struct(
        (-F.col("plen")).alias("_r_neg_plen"), F.col("ord").alias("_r_ord"),
        F.col("dependency").alias("_r_dependency"), F.col("ep_method").alias("_r_method"),
        F.col("ep_path").alias("_r_path"), F.col("status_code").alias("_r_status"), F.col("pfx").alias("_r_pfx"),
        F.col("psegs").alias("_r_psegs"))


_ROUTE = ["_r_neg_plen", "_r_ord", "_r_dependency", "_r_method", "_r_path", "_r_status", "_r_pfx", "_r_psegs"]


def _fits(r: Column, np: Column, method: Column) -> Column:
    segs = path_segments(np.substr(F.length(r["_r_pfx"]) + 1, F.lit(_REST)))
    return (np.startswith(r["_r_pfx"])
            & (r["_r_method"].eqNullSafe(method) | (r["_r_method"] == "ANY"))
            & (F.size(segs) == F.size(r["_r_psegs"]))
            & F.forall(F.zip_with(r["_r_psegs"], segs, lambda p, s: p["is_param"] | (p["value"] == s)),
                       lambda ok: ok))


def _by_first(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with the first of ``_routes`` (in match order) that fits ``_np``, as _r_* (null: none)."""
    first = F.slice(F.filter(F.col("_routes"), lambda r: _fits(r, F.col("_np"), F.col("method"))), 1, 1)
    # inline_outer evaluates the route scan once per row (a projection would be
    # inlined into every output column) and keeps unmatched rows with NULLs.
    return rows.select(*columns, "_np", F.inline_outer(first))


def _shown(m: DataFrame, columns: list[str]) -> DataFrame:
    segs = path_segments(F.col("_np").substr(F.length(F.col("_r_pfx")) + 1, F.lit(_REST)))
    return m.select(
        *columns,
        F.col("_r_dependency").alias("dependency"),
        F.col("_r_method").alias("endpoint_method"),
        F.col("_r_path").alias("endpoint_path"),
        F.col("_r_ord").alias("endpoint_ord"),
        F.col("_r_status").alias("status_code"),
        F.when(F.col("_r_path").isNotNull(), params_from_segments(F.col("_r_psegs"), segs)).alias("path_params"))


def _match_array(requests: DataFrame, routes: DataFrame) -> DataFrame:
    ordered = routes.select(F.array_sort(F.collect_list(_route_struct(routes))).alias("r")).scalar()
    rows = requests.withColumn("_np", normalize_path(F.col("path"))).withColumn("_routes", ordered)
    return _shown(_by_first(rows, requests.columns), requests.columns)


#: Routes of one prefix that go along with the requests under it; those of a prefix with more are found by joins.
INLINE_ROUTES = 16


def _may_begin(r: Column, rest: Column) -> Column:
    """Whether a route can fit a path that goes on with ``rest`` behind its prefix (rest may end inside a segment)."""
    begun = F.substring_index(F.regexp_replace(rest, "^/+", ""), "/", 1)
    first = F.get(r["_r_psegs"], F.lit(0))
    return F.when(F.size(r["_r_psegs"]) == 0, begun == "").otherwise(first["is_param"] | first["value"].startswith(begun))


def _heads(requests: DataFrame, routes: DataFrame, longest) -> DataFrame:
    """(_h, _routes): the first characters of paths, as many as the longest prefix has, with the routes in match order
    that a path beginning so can fit."""
    lens = routes.select(F.sort_array(F.collect_set("plen"), asc=False).alias("l")).scalar()
    by_prefix = routes.groupBy("pfx").agg(F.array_sort(F.collect_list(_route_struct(routes))).alias("_all"))
    heads = requests.select(normalize_path(F.col("path")).substr(F.lit(1), longest).alias("_h")).distinct()
    probe = (heads.select("_h", F.explode(lens).alias("_l")).where(F.length("_h") >= F.col("_l"))
             .select("_h", "_l", F.col("_h").substr(F.lit(1), F.col("_l")).alias("pfx")))
    rest = F.col("_h").substr(F.col("_l") + 1, F.lit(_REST))
    found = (probe.join(by_prefix.hint("merge"), "pfx")
             .select("_h", "_l", F.filter("_all", lambda r: _may_begin(r, rest)).alias("_all")).where(F.size("_all") > 0))
    return found.groupBy("_h").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_l")).alias("l"), "_all"))),
                                                         lambda x: x["_all"])).alias("_routes"))


def _match_hash(requests: DataFrame, routes: DataFrame) -> DataFrame:
    large = routes.groupBy("pfx").count().where(F.col("count") > INLINE_ROUTES).select("pfx").checkpoint()
    alone = large.isEmpty()
    few = routes if alone else routes.join(large, "pfx", "left_anti")
    longest = few.select(F.max("plen").alias("l")).scalar()
    # stored, so that both sides of this join are plain shuffles and Spark can split a very common head
    heads = stored(_heads(requests, few, longest), "heads")[0].hint("merge")
    rows = requests.withColumn("_np", normalize_path(F.col("path")))
    rows = rows.withColumn("_h", F.col("_np").substr(F.lit(1), longest)).join(heads, "_h", "left")
    m = _by_first(rows, requests.columns)
    if not alone:
        best = _best_pairs(requests, routes.join(large, "pfx", "left_semi"))
        # null-safe: a request without a method still meets an endpoint of any method
        m = m.join(best, m["method"].eqNullSafe(best["_m"]) & m["path"].eqNullSafe(best["_p"]), "left")
        # of two prefixes of a path, one is longer
        first = F.col("_best").isNotNull() & (F.col("_r_neg_plen").isNull() | (F.col("_best._r_neg_plen") < F.col("_r_neg_plen")))
        m = m.select(*requests.columns, "_np", *[F.when(first, F.col(f"_best.{c}")).otherwise(F.col(c)).alias(c) for c in _ROUTE])
    return _shown(m, requests.columns)


def _best_pairs(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(_m, _p, _best): the winning route of each (method, path) that has one, by joins on prefix and literal segments."""
    # Distinct prefix lengths: at most one per distinct prefix length (tiny).
    lens = routes.select(F.sort_array(F.collect_set("plen"), asc=False).alias("l")).scalar()
    shapes = routes.select("pfx", "nseg", "mask").distinct()
    # a match depends on (method, path) only: repeated requests collapse before any shuffle, bodies never take part
    req = (requests.select(F.col("method").alias("_m"), F.col("path").alias("_p")).distinct()
           .withColumn("_np", normalize_path(F.col("_p"))))
    cand = (req.select("*", F.explode(lens).alias("_l"))
            .where(F.length("_np") >= F.col("_l"))
            .select("_m", "_p",
                    F.col("_np").substr(F.lit(1), F.col("_l")).alias("pfx"),
                    path_segments(F.col("_np").substr(F.col("_l") + 1, F.lit(_REST))).alias("_segs"))
            .withColumn("nseg", F.size("_segs")))
    cand = cand.join(shapes, ["pfx", "nseg"])
    cand = cand.withColumn("mkey", F.array_join(F.transform(
        "_segs", lambda s, i: F.when(F.col("mask").substr(i + 1, F.lit(1)) == "1", F.lit("")).otherwise(s)), "/"))
    hit = (cand.join(routes, ["pfx", "nseg", "mask", "mkey"])
           .where(F.col("ep_method").eqNullSafe(F.col("_m")) | (F.col("ep_method") == "ANY")))
    # stored, so that both sides of the requests' join are plain shuffles and Spark can split a very common path
    return hit.groupBy("_m", "_p").agg(F.min(_route_struct(hit)).alias("_best")).checkpoint()


def match_requests(requests: DataFrame, routes: DataFrame, strategy: str = "auto",
                   array_max_routes: int = 256) -> DataFrame:
    """Every request with its winning endpoint (NULLs when unmatched).

    ``routes`` comes from ``prepare_routes``.  ``strategy`` is 'array', 'hash'
    or 'auto' (array form while the registry has at most ``array_max_routes``
    routes: the route list then rides along every task as one small value).
    """
    if strategy == "auto":
        n = routes.limit(array_max_routes + 1).count()
        strategy = "array" if n <= array_max_routes else "hash"
    if strategy == "array":
        return _match_array(requests, routes)
    if strategy == "hash":
        if requests.isStreaming:
            raise ValueError("too many routes to ride along a stream: match it per micro-batch (match_stream)")
        return _match_hash(requests, routes)
    raise ValueError(f"unknown strategy {strategy!r}")


def unmatched_requests(matched: DataFrame) -> DataFrame:
    """Requests with no endpoint, shaped as 501 rows."""
    return matched.where(F.col("endpoint_path").isNull()).select(
        *[c for c in matched.columns if c not in MATCH_COLS],
        F.lit(501).alias("status"),
        F.to_json(F.struct(F.lit("no matching endpoint").alias("error"),
                           F.col("method").alias("method"), F.col("path").alias("path"))).alias("error_body"))


def diagnose_unmatched(matched: DataFrame, routes: DataFrame) -> DataFrame:
    """Unmatched requests split into 404 no_dependency_match (with the
    configured prefixes) and 501 no_operation_match (with the operations of the
    longest-prefix dependency)."""
    um = matched.where(F.col("endpoint_path").isNull())
    pref = routes.select("pfx", "plen", "dependency", "ord")
    # Longest prefix per prefix string; ties between dependencies sharing a prefix -> registry order.
    dep_of_prefix = pref.groupBy("pfx", "plen").agg(F.min(F.struct("ord", "dependency"))["dependency"].alias("dep"))
    lens = routes.select(F.sort_array(F.collect_set("plen"), asc=False).alias("l")).scalar()
    # the dependency follows from the path alone: repeated paths are looked up once
    probe = (um.select(F.col("path").alias("_path")).distinct().withColumn("_np", normalize_path(F.col("_path")))
             .select("_path", F.explode(lens).alias("_l"), "_np")
             .select("_path", F.col("_np").substr(F.lit(1), F.col("_l")).alias("pfx")))
    longest = (probe.join(dep_of_prefix, "pfx")
               .groupBy("_path").agg(F.max(F.struct("plen", "dep"))["dep"].alias("_dep")))
    ops = (routes.groupBy("dependency")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ep_method", "ep_path"))),
                                         lambda x: F.concat(x["ep_method"], F.lit(" "), x["ep_path"])), ",")
                .alias("available_operations")))
    prefixes = routes.select(F.array_join(F.array_sort(F.collect_set("pfx")), ",").alias("p")).scalar()
    d = um.join(longest, um["path"] == longest["_path"], "left").join(
        ops, F.col("_dep") == ops["dependency"], "left")
    no_dep = F.col("_dep").isNull()
    return d.select(
        um["request_id"], um["method"], um["path"],
        F.when(no_dep, "no_dependency_match").otherwise("no_operation_match").alias("error"),
        F.when(no_dep, 404).otherwise(501).alias("status"),
        F.col("_dep").alias("dependency"),
        F.when(no_dep, prefixes).otherwise(F.col("available_operations")).alias("available"))
