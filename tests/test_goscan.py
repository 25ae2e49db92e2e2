"""The pass over a file: statements and calls over any lines and any depth."""
from pyspark.sql import functions as F

from trafficlens.functions.goscan import scan
from trafficlens.operators import extract as X
from trafficlens.operators import match as M


def every(_):
    return True


def calls(body):
    found = scan("package p\n\nfunc f() {\n" + body + "\n}\n", every)
    return [(line - 3, name, args) for _, line, _, _, name, args in found["calls"]]


def test_calls_over_lines_and_depth():
    assert calls('r.Get(\n\t"/a",\n\th.A,\n)') == [(1, "Get", ['"/a"', "h.A"])]
    assert calls('r.\n\tWith(mw).\n\tGet("/a", h.A)') == [(1, "With", ["mw"]), (1, "Get", ['"/a"', "h.A"])]
    assert calls('x := 1\nif a {\n}\nr.Get("/a", h.A)')[0][0] == 4
    assert calls('c.JSON(201, gin.H{\n"a": f(")"),\n})') == [(1, "JSON", ["201", 'gin.H{ "a": f(")"), }'])]
    deep = calls("c.JSON(201, " + "f([]int{" * 5000 + "1" + "})" * 5000 + ")")
    assert [(n, a[0], len(a)) for _, n, a in deep] == [("JSON", "201", 2)]
    nested = calls('r.Route("/v", func(r R) {\n\tr.Get("/a", func(w W) {\n\t\tw.WriteHeader(1)\n\t})\n})')
    assert [(x, n) for x, n, _ in nested] == [(3, "WriteHeader"), (2, "Get"), (1, "Route")]
    assert nested[1][2] == ['"/a"', "func(w W) {}"]


def test_files_that_do_not_parse():
    for text in ("", "// only\n", "x := 1\n", "package p\nfunc f() {\n", "package p\nvar x = f(1]\n", "package p\n)\n"):
        assert scan(text, every) is None
    assert scan('package p\nvar s = "}" // {\nvar r = `\n{ (`\nvar c = \'{\'\n', every)["package"] == "p"


def test_statements():
    got = scan("package p\nfunc f() {\n\tvar (\n\t\ta T\n\t)\n\tx, y := A{1}, &B{\n\t\t2,\n\t}\n"
               "\tfor i := 0; i < n; i++ {\n\t\tz = C{}\n\t}\n}\n", every)
    texts = {"".join(text.split()): (targets, ["".join(v.split()) for v in values])
             for *_, text, targets, values in got["statements"]}
    assert "varaT" in texts and texts["z=C{}"] == ("z", ["C{}"])
    assert texts["x,y:=A{1},&B{2,}"] == ("x, y", ["A{1}", "&B{2,}"])


SRC = '''package api

func (h *H) Mixed(
	w http.ResponseWriter,
	next func(http.Request) error,
) {
	a, b := A{}, &pkg.B{}
	var (
		in []In
	)
	dec.Decode(&in)
	func() {
		a = A2{
			X: 1,
		}
	}()
	w.WriteHeader(http.StatusAccepted); c.JSON(200, f(c.JSON(500, x)))
	enc.Encode(a)
	enc.Encode(b)
	enc.Encode(map[string]interface{}{"a": 1})
}

func (s *Svc[T]) Generic(c Context) {}

func Plain(ch chan http.Request, f func(http.Request)) {}

func (h *H) hidden(c Context) {}

func routes() {
	r.Get("/a", NewH().Get)
	r.Get("/b"+x, h.B)
	r.Post('x', h.B)
	r.Delete("/c", (h).C)
	r.Patch("/d", a[0])
	r.Get("/one")
}
'''


def _files(spark, text):
    return spark.createDataFrame([("r", "a.go", text), ("r", "broken.go", text + "}")],
                                 "repo string, path string, content string")


def test_extractors(spark):
    scanned = X.scan_source(_files(spark, SRC)).checkpoint()
    got = X.collect_handler_calls(scanned).collect()
    assert [(r["name"], r["receiver"], r["decodes"], r["encodes"], r["status_codes"]) for r in got] == [
        ("Mixed", "*H", "[]In", "map[string]interface{}", [202, 200, 500]), ("Generic", "*unknown", "", "", [])]
    assert {(r["var"], r["type"]) for r in X.local_types(scanned).collect()} == {("a", "A2"), ("b", "pkg.B"), ("in", "[]In")}
    assert [(r["kind"], r["resolved"]) for r in X.handler_calls(scanned).orderBy("call_pos").collect()] == [
        ("decode", "[]In"), ("status", "202"), ("encode", ""), ("status", "200"), ("encode", "x"), ("status", "500"),
        ("encode", "A2"), ("encode", "pkg.B"), ("encode", "map[string]interface{}")]
    routes = [(r["method"], r["route"], r["handler"]) for r in X.extract_routes(scanned).orderBy("line").collect()]
    assert routes == [("GET", "/a", "<unknown>.Get"), ("DELETE", "/c", "<unknown>.C"), ("PATCH", "/d", "<unknown>")]


def test_structs(spark):
    src = ("package m\n\ntype P[T any] struct {\n\tItems []T `json:\"items\"`\n\tIn struct {\n\t\tK int\n\t}\n\tF func(int) error\n"
           "\tC chan int\n\tL []List[T]\n}\ntype One struct{ A int; B string \"json:\\\"b\\\"\" }\ntype Al = struct{ Q bool }\n"
           "func f() {\n\ttype Local struct{ Z int }\n}\n")
    got = {(r["struct"], r["field"], r["type"], r["json_tag"]) for r in X.extract_struct_fields(X.scan_source(_files(spark, src))).collect()}
    assert got == {("P", "Items", "[]T", "items"), ("P", "In", "unknown", "in"), ("P", "F", "unknown", "f"),
                   ("P", "C", "unknown", "c"), ("P", "L", "[]unknown", "l"), ("One", "A", "int", "a"),
                   ("One", "B", "string", "b"), ("Al", "Q", "bool", "q")}


def test_request_without_a_method(spark):
    """Both matching forms answer a request that has no method (or path) alike."""
    ep = spark.createDataFrame([("d", 0, "GET", "/a/{id}", 200), ("d", 1, "ANY", "/a/{id}", 200)],
                               "dependency string, ord int, method string, path string, status_code int")
    req = spark.createDataFrame([(1, None, "/a/1"), (2, "GET", "/a/1"), (3, None, None), (4, "GET", None)],
                                "request_id long, method string, path string")
    got = [sorted(map(str, M.match_requests(req, M.prepare_routes(ep), strategy=s)
                      .select("request_id", "endpoint_ord", F.size("path_params")).collect())) for s in ("array", "hash")]
    assert got[0] == got[1] and "request_id=1, endpoint_ord=1" in got[0][0]
