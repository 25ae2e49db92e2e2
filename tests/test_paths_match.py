"""Path functions and request matching (table-driven, as rows)."""
from pyspark.sql import functions as F

from trafficlens.functions import paths as P
from trafficlens.operators import match as M


def _one(spark, col, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(col(F.col("v"))).collect()]


def test_normalize_path(spark):
    assert _one(spark, P.normalize_path, ["", "/", "/users/", "users", "/api/v1/", "//"]) == \
        ["/", "/", "/users", "/users", "/api/v1", ""]


def test_normalize_param(spark):
    assert _one(spark, P.normalize_param, [":id", "{id}", "users"]) == ["{id}", "{id}", "users"]


def test_pattern_segments(spark):
    df = spark.createDataFrame([("/users/{id}.json/{a:[0-9]+}/*rest",)], "p string")
    segs = df.select(P.pattern_segments("p").alias("s")).first()["s"]
    assert [(s["value"], s["is_param"]) for s in segs] == [
        ("users", False), ("{id}.json", False), ("a:[0-9]+", True), ("*rest", False)]


ENDPOINTS = [
    ("api", 0, "GET", "/users", 200), ("api", 1, "POST", "/users", 201), ("api", 2, "GET", "/users/{id}", 200),
    ("api", 3, "PUT", "/users/{id}", 200), ("api", 4, "DELETE", "/users/{id}", 204), ("api", 5, "GET", "/teams", 200),
    ("api", 6, "POST", "/teams", 201), ("api", 7, "GET", "/teams/{id}", 200),
]
CASES = [
    (1, "GET", "/api/v1/users", "/users", ""), (2, "GET", "/api/v1/users/42", "/users/{id}", "id=42"),
    (3, "POST", "/api/v1/users", "/users", ""), (4, "PUT", "/api/v1/users/99", "/users/{id}", "id=99"),
    (5, "DELETE", "/api/v1/users/99", "/users/{id}", "id=99"), (6, "GET", "/api/v1/teams", "/teams", ""),
    (7, "GET", "/api/v1/teams/eng", "/teams/{id}", "id=eng"), (8, "POST", "/api/v1/teams", "/teams", ""),
    (9, "GET", "/unknown/path", None, None), (10, "PATCH", "/api/v1/users/1", None, None),
]


def _match(spark, endpoints, deps, cases, strategy):
    ep = spark.createDataFrame(endpoints, "dependency string, ord int, method string, path string, status_code int")
    dp = spark.createDataFrame(deps, "name string, prefix string")
    req = spark.createDataFrame([c[:3] for c in cases], "request_id long, method string, path string")
    m = M.match_requests(req, M.prepare_routes(ep, dp), strategy=strategy)
    return {r["request_id"]: (r["endpoint_path"], r["p"]) for r in
            m.select("request_id", "endpoint_path", P.params_to_string("path_params").alias("p")).collect()}


def test_match_table_both_forms(spark):
    for strategy in ("array", "hash"):
        got = _match(spark, ENDPOINTS, [("api", "/api/v1")], CASES, strategy)
        assert got == {c[0]: (c[3], c[4]) for c in CASES}, strategy


def test_longest_prefix_colon_and_nested(spark):
    eps = [("short", 0, "GET", "/data", 200), ("long", 1, "GET", "/data", 200),
           ("root", 2, "GET", "/items/:itemId", 200), ("orders", 3, "GET", "/orders/{orderId}/items", 200)]
    deps = [("short", "/api"), ("long", "/api/v2"), ("root", "/"), ("orders", "/api/orders-svc")]
    cases = [(1, "GET", "/api/v2/data", "/data", ""), (2, "GET", "/items/xyz", "/items/:itemId", "itemId=xyz"),
             (3, "GET", "/api/orders-svc/orders/ord-42/items", "/orders/{orderId}/items", "orderId=ord-42"),
             (4, "GET", "/api/orders-svc/orders/ord-42/items/x", None, None),
             (5, "GET", "/api/orders-svc/orders/ord-42/other", None, None)]
    for strategy in ("array", "hash"):
        ep = spark.createDataFrame(eps, "dependency string, ord int, method string, path string, status_code int")
        dp = spark.createDataFrame(deps, "name string, prefix string")
        req = spark.createDataFrame([c[:3] for c in cases], "request_id long, method string, path string")
        m = M.match_requests(req, M.prepare_routes(ep, dp), strategy=strategy)
        got = {r["request_id"]: (r["dependency"], r["endpoint_path"], r["p"]) for r in m.select(
            "request_id", "dependency", "endpoint_path", P.params_to_string("path_params").alias("p")).collect()}
        assert got[1][0] == "long"
        for c in cases[1:]:
            assert got[c[0]][1:] == (c[3], c[4]), (strategy, c)


def test_duplicate_param_names_last_wins(spark):
    ep = [("d", 0, "GET", "/a/{x}/{x}", 200)]
    got = _match(spark, ep, [("d", "/")], [(1, "GET", "/a/1/2", "/a/{x}/{x}", "x=2")], "array")
    assert got[1] == ("/a/{x}/{x}", "x=2")


def test_fixture_winner_counts(spark):
    from conftest import SF01
    from trafficlens.sources import derived as D
    ep, deps = D.fixture_registry(spark)
    routes = M.prepare_routes(ep, deps)
    for strategy in ("array", "hash"):
        m = M.match_requests(D.requests(spark, SF01), routes, strategy=strategy)
        counts = {r["ep"]: r["n"] for r in m.groupBy(F.col("endpoint_path").alias("ep"))
                  .agg(F.count("*").alias("n")).collect()}
        assert counts == {"/users/:id": 1982, "/users": 2017, "/orders/{orderId}": 1981,
                          "/orders/{orderId}/items": 2006, None: 2014}


def test_prefixes_of_few_and_of_many_routes(spark, monkeypatch):
    """Few routes go along with the requests, many are found by joins; all ways give the array form's rows."""
    eps = [("v", i, m, p, 200 + i) for i, (m, p) in enumerate([
               ("GET", "/"), ("GET", "/users/{id}"), ("ANY", "/users/me"), ("GET", "/{x}/me"), ("POST", "/users")])]
    eps += [("v1", i, "GET", p, None) for i, p in enumerate(["/users/{id}", "2/{y}", "/2"])]
    eps += [("root", i, m, p, 300 + i) for i, (m, p) in enumerate([("GET", "/v12/{z}"), (None, "/none"), ("GET", "{a}"), ("GET", "/api/v1/2")])]
    deps = [("v", "/api/v"), ("v1", "/api/v1"), ("root", "/")]
    paths = ["/api/v", "/api/v/", "/api/v/users/7", "/api//v/users/me", "/api/v/users/me", "/api/v1/users/me", "/api/v12", "/api/v12/3", "/api/v1/2",
             "/api/v1//2", "/api/v1users/me", "/api/vx/me", "/v12/api", "/none", "none", "", "/", "//", None, "/api/v1", "/a", "/api", "/api/v/nope/x"]
    cases = [(i, m, p) for i, (m, p) in enumerate((m, p) for m in ("GET", "POST", "PUT", None) for p in paths)] * 2
    ep = spark.createDataFrame(eps, "dependency string, ord int, method string, path string, status_code int")
    routes = M.prepare_routes(ep, spark.createDataFrame(deps, "name string, prefix string"))
    req = spark.createDataFrame(cases, "request_id long, method string, path string")
    rows = lambda strategy: sorted(map(str, M.match_requests(req, routes, strategy=strategy).collect()))
    want = rows("array")
    assert sum("endpoint_ord=None" not in r for r in want) > 30
    for most in (16, 4, 3, 0):
        monkeypatch.setattr(M, "INLINE_ROUTES", most)
        assert rows("hash") == want, most
