"""Prompts, bodies, conformance and the model path on a small corpus."""
import json
import re
import uuid

from pyspark.sql import functions as F

from trafficlens.operators import extract as X
from trafficlens.operators import generate as GEN
from trafficlens.operators import match as M
from trafficlens.operators import registry as R

API = '''package api

type User struct {
	ID string `json:"id"`
	Age int `json:"age"`
	Home Address `json:"home"`
	Past []Address `json:"past,omitempty"`
	Ext dto.User `json:"ext"`
}

type Address struct {
	City string `json:"city"`
	Since time.Time `json:"since"`
}

func (h *H) List(w http.ResponseWriter, r *http.Request) {
	out := []User{}
	json.NewEncoder(w).Encode(out)
}

func (h *H) One(w http.ResponseWriter, r *http.Request) {
	var u User
	json.NewEncoder(w).Encode(u)
}

func Routes(r Router) {
	r.With(auth).Get("/users", h.List)
	r.Get("/users/{id}", h.One)
	r.Get("/users/{id}", h.One)
}
'''
DTO = '''package dto

type User struct {
	Phone string `json:"phone"`
}
'''


def _corpus(spark):
    files = spark.createDataFrame([("r", "api/a.go", API), ("r", "dto/d.go", DTO)], "repo string, path string, content string")
    b = X.source_blocks(X.source_lines(X.scan_filter(files)))
    sf, rt = X.extract_struct_fields(b), X.extract_routes(b)
    hd = X.collect_handler_calls(b, X.extract_handlers(b))
    eps = R.build_registry(rt, hd, sf)
    return files, sf, rt, hd, eps, R.expand_fields(sf)


def _matched(spark, eps):
    deps = spark.createDataFrame([("r", "/")], "name string, prefix string")
    routes = M.prepare_routes(eps.select("dependency", "ord", "method", F.col("endpoint_path").alias("path"), "status_code"), deps)
    req = spark.createDataFrame([(1, "GET", "/users"), (2, "GET", "/users/u-7"), (2, "GET", "/users/u-8")],
                                "request_id long, method string, path string")
    m = M.match_requests(req, routes).withColumn("request_key", F.concat("method", F.lit("|"), "path"))
    return req, routes, m.withColumn("query", F.lit("")).withColumn("body", F.lit(""))


def test_bodies_and_conformance(spark):
    _, sf, _, _, eps, fields = _corpus(spark)
    _, _, m = _matched(spark, eps)
    e = eps.select("dependency", F.col("ord").alias("endpoint_ord"), "repo", "response_dir", "response_package",
                   "response_type", "body_type")
    rows = m.join(e, ["dependency", "endpoint_ord"])
    got = {r["path"]: json.loads(r["body"]) for r in GEN.generate_responses(rows, fields).collect()}
    users = got["/users"]
    assert isinstance(users, list) and 2 <= len(users) <= 3
    assert len({u["id"] for u in users}) == len(users)  # items differ
    one = got["/users/u-7"]
    assert one["id"] == "u-7" and set(one) == {"id", "age", "home", "past", "ext"}
    assert set(one["ext"]) == {"phone"} and set(one["home"]) == {"city", "since"}
    assert len({p["city"] for p in one["past"]}) == len(one["past"]) >= 2
    ok = GEN.check_conformance(GEN.generate_responses(rows, fields), fields).collect()
    assert all(r["valid_json"] and not (r["missing"] or r["unexpected"] or r["mismatched"]) and r["n_ok"] == r["n_fields"] > 5
               for r in ok)


def _conformance(spark, bodies, schema):
    """Results by body; schema: (path, type, required[, nullable]) of one struct; a body in a list stands for a list body."""
    names = ("repo", "root_dir", "root_package", "root")
    rows = [("r", "d", "p", "S", f[0], f[0].count("."), f[0].rsplit(".", 1)[-1], f[1], f[2], f[3] if len(f) > 3 else False)
            for f in schema]
    fields = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", field_path string, depth int, "
                                   "json_key string, json_type string, required boolean, nullable boolean")
    given = [(i, "r", "d", "p", "S", "array" if is_list else "object", b) for i, (b, is_list) in enumerate(bodies)]
    df = spark.createDataFrame(given, "request_id long, repo string, response_dir string, response_package string, "
                               "response_type string, body_type string, body string")
    got = {r["request_id"]: r for r in GEN.check_conformance(df, fields).collect()}
    return [got[i] for i in range(len(bodies))]


def test_conformance_at_depth(spark):
    schema = [("id", "string", True), ("home", "object", True), ("home.city", "string", True), ("past", "array", False),
              ("past[].city", "string", True)]
    c, *rest = _conformance(spark, [
        ('{"id": 1, "home": {"town": "x"}, "past": [{"city": "a"}, {}], "more": 0}', False), ('{"id": "a", "id": "b"}', False),
        ("[]", False), ("[]", True), (None, False), ('[{"id": "a", "home": {"city": "c"}}, 7]', True), ("{}", False), ("", True)], schema)
    assert (c["missing"], c["unexpected"], c["mismatched"]) == ("home.city,past[].city", "home.town,more", "id")
    assert c["n_fields"] == 5 and c["n_ok"] == 2
    assert [r["valid_json"] for r in rest] == [False, False, True, False, True, True, False]
    assert [(r["n_fields"], r["n_ok"]) for r in rest] == [(3, 0), (3, 0), (0, 0), (3, 0), (4, 3), (3, 0), (3, 0)]
    assert (rest[4]["mismatched"], rest[5]["missing"]) == ("[]", "home,id")


def test_conformance_of_every_type(spark):
    """Each JSON value against each type, nulls only where they may be."""
    values = {"string": '"x"', "integer": "7", "long": "123456789012345678901234567890", "number": "7.5", "one": "1.0", "exp": "1e3",
              "boolean": "true", "array": "[1]", "object": '{"a": {"b": [1]}}', "null": "null"}
    fits = {"string": {"string"}, "integer": {"integer", "long", "one"}, "number": {"integer", "long", "number", "one", "exp"},
            "boolean": {"boolean"}, "array": {"array"}, "object": {"object"}, "ref": {"object"}, "any": set(values)}
    for nullable in (False, True):
        schema = [(t, t, False, nullable) for t in fits]
        bodies = [("{" + ", ".join(f'"{t}": {v}' for t in fits) + "}", False) for v in values.values()]
        for name, r in zip(values, _conformance(spark, bodies, schema)):
            want = [t for t in fits if name not in fits[t] and not (name == "null" and nullable)]
            assert r["mismatched"] == ",".join(sorted(want)), (name, nullable)


def test_body_values_by_type(spark):
    """A body is fixed by its request key; path values come back where they fit the type."""
    schema = [("id", "integer", None), ("code", "string", None), ("when", "string", "date-time"), ("uid", "string", "uuid"),
              ("cost", "number", None), ("on", "boolean", None), ("x", "any", None)]
    rows = [("r", "d", "p", "S", k, 0, i, k, t, f, None) for i, (k, t, f) in enumerate(schema)]
    fields = spark.createDataFrame(rows, "repo string, root_dir string, root_package string, root string, field_path string, "
                                   "depth int, pos int, json_key string, json_type string, format string, item_type string")
    misses = spark.createDataFrame(
        [("k1", "r", "d", "p", "S", "object", [("id", "42"), ("code", 'a"b')]), ("k2", "r", "d", "p", "S", "object", [("id", "x")]),
         ("k1", "r", "d", "p", "S", "array", None), (None, "r", "d", "p", "none", "object", None)],
        "request_key string, repo string, response_dir string, response_package string, response_type string, body_type string, "
        "path_params array<struct<key:string,value:string>>")
    got = [json.loads(r["body"]) for r in GEN.generate_responses(misses, fields).collect()]
    again = [json.loads(r["body"]) for r in GEN.generate_responses(misses, fields).collect()]
    assert got == again
    one = next(b for b in got if isinstance(b, dict) and b.get("id") == 42)
    assert one["code"] == 'a"b' and re.fullmatch(r"20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", one["when"]) and one["x"] is None
    assert uuid.UUID(one["uid"]).version == 4 and isinstance(one["cost"], float) and isinstance(one["on"], bool)
    lists = [b for b in got if isinstance(b, list)]
    assert len(lists) == 1 and len({b["uid"] for b in lists[0]}) == len(lists[0]) in (2, 3) and {} in got


def test_prompts_do_not_fan_out_and_carry_their_own_schema(spark):
    _, sf, rt, hd, eps, fields = _corpus(spark)
    _, _, m = _matched(spark, eps)
    rows = GEN.build_response_prompts(m, eps, fields).collect()
    assert len(rows) == 3
    assert sum("JSON array" in r["prompt"] for r in rows) == 1
    assert all('"ext.phone"' in r["prompt"] for r in rows)
    fw = spark.createDataFrame([("r", "chi")], "repo string, framework string")
    whole = GEN.build_analysis_prompts(sf, rt, hd, fw).collect()
    split = {r["package"]: r["prompt"] for r in GEN.build_analysis_prompts(sf, rt, hd, fw, by_package_over=100).collect()}
    assert len(whole) == 1 and set(split) == {"api", "dto"}
    assert "/users/{id}" in split["api"] and "/users/{id}" not in split["dto"]


def test_both_match_forms_agree_on_repeated_ids(spark):
    _, _, _, _, eps, _ = _corpus(spark)
    req, routes, _ = _matched(spark, eps)
    a, b = (sorted(map(str, M.match_requests(req, routes, strategy=s).collect())) for s in ("array", "hash"))
    assert a == b and len(a) == 3


def test_model_path_with_failures(spark):
    _, _, _, _, eps, fields = _corpus(spark)
    _, _, m = _matched(spark, eps)
    prompts = GEN.build_response_prompts(m, eps, fields)

    def factory():
        def client(system, prompt):
            if "JSON array" in prompt:
                raise RuntimeError("down")
            return '```json\n{"id": "x",}\n```'
        return client

    out = GEN.batch_infer(prompts, factory, max_retries=1, sleep=lambda s: None)
    failed = out.where("error IS NOT NULL")
    errors = GEN.error_responses(m.where("endpoint_path IS NULL"), failed).collect()
    assert [(r["request_id"], r["status"]) for r in errors] == [(1, 502)]
    assert out.where("error IS NULL").count() == 2


def test_registry_written_and_used_again(spark, tmp_path):
    _, sf, _, _, eps, fields = _corpus(spark)
    fw = spark.createDataFrame([("r", "chi")], "repo string, framework string")
    path = str(tmp_path / "reg")
    R.write_registry(eps, fields, fw, path)
    reg = R.read_registry(spark, path)
    back = R.registry_fields(reg)
    own = fields.where("root_dir = 'api' AND root = 'User'")
    cols = ["root_dir", "root_package", "root", "pos", "field_path", "json_type", "format", "required", "nullable", "item_type"]
    assert sorted(map(str, back.select(*cols).collect())) == sorted(map(str, own.select(*cols).collect()))
    calls = []
    R.load_or_scan(spark, path, lambda: calls.append(1))
    assert not calls


def test_corpus_read_from_a_directory(spark, tmp_path):
    for name, text in (("r1/api/a.go", "package a\n"), ("r1/api/a_test.go", "x"), ("r2/main x+y.go", "package main\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = {(r["repo"], r["path"]): r["content"].rstrip() for r in X.read_corpus(spark, root).collect()}
        assert got == {("r1", "api/a.go"): "package a", ("r1", "api/a_test.go"): "x", ("r2", "main x+y.go"): "package main"}
