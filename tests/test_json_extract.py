"""JSON repair, endpoint parsing, tags, route patterns, frameworks, handler bodies."""
from pyspark.sql import functions as F

from trafficlens.functions import gosrc as G
from trafficlens.functions.jsonfix import repair_json
from trafficlens.operators import extract as X
from trafficlens.operators.analysis import parse_endpoints


def test_repair_json(spark):
    cases = [('[{"a":1}]', '[{"a":1}]'), ('```json\n[{"a":1}]\n```', '[{"a":1}]'),
             ('```\n[{"a":1}]\n```', '[{"a":1}]'), ('  \n[{"a":1}]\n ', '[{"a":1}]'),
             ('Here:\n```json\n[{"a":1}]\n```', '[{"a":1}]'), ('{"a":1,}', '{"a":1}'), ("[1,2,3,]", "[1,2,3]"),
             ('{"items":[{"a":1,},]}', '{"items":[{"a":1}]}'), ('{"a":1 , \n}', '{"a":1 }')]
    df = spark.createDataFrame(cases, "i string, o string")
    assert [tuple(r) for r in df.select(repair_json("i"), "o").collect()] == [(o, o) for _, o in cases]


def test_parse_endpoints_errors(spark):
    df = spark.createDataFrame([(1, "[]"), (2, "not json at all"), (3, '[{"method":"GET","path":"/x",}]')],
                               "output_id long, raw string")
    good, bad = parse_endpoints(df)
    assert {r["output_id"]: r["error"] for r in bad.collect()} == {1: "empty_array", 2: "invalid_json"}
    assert [(r["method"], r["path"]) for r in good.collect()] == [("GET", "/x")]


def test_json_tag(spark):
    tags = ['`json:"id"`', '`json:"name,omitempty"`', '`json:"-"`', '`xml:"data"`', None]
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    got = [(r[0]["key"], r[0]["omitempty"]) for r in df.select(G.parse_json_tag("t")).collect()]
    assert got == [("id", False), ("name", True), ("-", False), ("", False), ("", False)]


def test_route_pattern(spark):
    pats = ["GET /health", "POST /messages/{user_id}", "PUT /users/{id}", "DELETE /items/{id}", "PATCH /update",
            "get /lowercase", "GET  /double-space", "/legacy", "GET", "INVALID /foo", ""]
    df = spark.createDataFrame([(p,) for p in pats], "p string")
    got = [(r[0]["method"], r[0]["path"]) for r in df.select(G.parse_route_pattern("p")).collect()]
    assert got[:7] == [("GET", "/health"), ("POST", "/messages/{user_id}"), ("PUT", "/users/{id}"),
                       ("DELETE", "/items/{id}"), ("PATCH", "/update"), ("GET", "/lowercase"),
                       ("GET", "/double-space")]
    assert all(m is None for m, _ in got[7:])


def test_framework_from_imports(spark):
    lists = [["github.com/go-chi/chi/v5"], ["github.com/gin-gonic/gin"], ["github.com/labstack/echo/v4"],
             ["github.com/gorilla/mux"], ["net/http"], ["encoding/json"], ["net/http", "github.com/go-chi/chi/v5"]]
    rows = [("r", f"f{i}", p, imp) for i, l in enumerate(lists) for p, imp in enumerate(l)]
    df = spark.createDataFrame(rows, "repo string, path string, pos int, import string")
    got = {r["path"]: r["framework"] for r in X.framework_from_imports(df).collect()}
    assert [got[f"f{i}"] for i in range(len(lists))] == ["chi", "gin", "echo", "gorilla", "stdlib", "unknown", "chi"]


SRC = """package handler

import (
\t"encoding/json"
\t"net/http"
)

type CreateRequest struct {
\tName string `json:"name"`
\tA, B int
\tinternal string
}

func (h *Handler) Create(w http.ResponseWriter, r *http.Request) {
\tvar req CreateRequest
\tif err := json.NewDecoder(r.Body).Decode(&req); err != nil {
\t\treturn
\t}
\tresp := CreateResponse{ID: "1"}
\tw.WriteHeader(http.StatusCreated)
\tjson.NewEncoder(w).Encode(resp)
}

func Routes(mux *http.ServeMux, h *Handler) {
\tmux.HandleFunc("GET /health", h.Health)
\tmux.HandleFunc("POST /messages/{user_id}/{channel_id}", h.Send)
\tmux.HandleFunc("/legacy", h.Legacy)
\tr.Get(`/raw`, func(w http.ResponseWriter, r *http.Request) {})
}
"""


def test_handler_body_routes_fields(spark):
    files = spark.createDataFrame([("repo", "handler/h.go", SRC), ("repo", "handler/h_test.go", SRC),
                                   ("repo", "vendor/x/h.go", SRC)], "repo string, path string, content string")
    b = X.source_blocks(X.source_lines(X.scan_filter(files)))
    h = X.collect_handler_calls(b, X.extract_handlers(b)).collect()
    assert [(r["name"], r["receiver"], r["decodes"], r["encodes"], r["status_codes"]) for r in h] == \
        [("Create", "*Handler", "CreateRequest", "CreateResponse", [201])]
    routes = [(r["method"], r["route"], r["handler"]) for r in X.extract_routes(b).orderBy("line").collect()]
    assert routes == [("GET", "/health", "h.Health"), ("POST", "/messages/{user_id}/{channel_id}", "h.Send"),
                      ("ANY", "/legacy", "h.Legacy"), ("GET", "`/raw`", "<anonymous>")]
    fields = [(r["field"], r["type"], r["json_tag"]) for r in X.extract_struct_fields(b).orderBy("pos").collect()]
    assert fields == [("Name", "string", "name"), ("A", "int", "a"), ("B", "int", "b")]


def test_type_text(spark):
    types = ["string", "*pkg.T", "[4]int", "map[string]interface{}", "chan int", "func()", "[]*User", "List[int]"]
    df = spark.createDataFrame([(t,) for t in types], "t string")
    assert [r[0] for r in df.select(G.type_text("t")).collect()] == [
        "string", "*pkg.T", "[]int", "map[string]interface{}", "unknown", "unknown", "[]*User", "unknown"]
