"""Comments, grouped and anonymous types, chained route calls."""
from trafficlens.operators import extract as X

SRC = '''package api
/* block
r.Get("/no", h.No)
*/
type (
	A struct {
		X int `json:"x"`
	}
	B struct {
		Z bool `json:"z"`
	}
)

type C struct {
	ID string `json:"id"` // the "id"
	Meta struct {
		K int `json:"k"`
	} `json:"m"`
	Tail []B
}

func Routes(r Router) {
	r.HandleFunc("/a", h.A).Methods("GET")
	r.With(mw(1)).Get("/b", h.B)
	v1.Group("/x").GET("/e", h.E)
	r.Get("/c", h.C) // the "c" route (old)
	x := 1 // r.Get("/z", h.Z)
	r.Post("http://x/y", h.U)
	r.Get("/w", wrap(h.W, []int{2}), extra)
}
'''


def test_blocks_without_a_shuffle(spark):
    texts = [SRC, "", "// only\n", "x := 1\n\npackage p\ntype A struct {\n}\nvar\n\n", "package p", "\npackage p\nfunc"]
    files = spark.createDataFrame([("r", f"a{i}.go", t) for i, t in enumerate(texts)], "repo string, path string, content string")
    want = X.source_blocks(X.source_lines(files))
    got = X.file_blocks(files)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_long_lines(spark):
    """Lines far longer than a regular expression could recurse over."""
    big = 'var x = f("' + "a" * 200_000 + '", ' + ", ".join("g(1)" for _ in range(20_000)) + ")"
    src = "package p\n" + big + '\nfunc (h *H) A(w http.ResponseWriter, r *http.Request) {\n\tw.WriteHeader(f("' + "b" * 100_000 +         '"))\n\tr.Get("/z", ' + "c" * 100_000 + ")\n}\n"
    files = spark.createDataFrame([("r", "a.go", src)], "repo string, path string, content string")
    blocks = X.file_blocks(files)
    assert X.extract_routes(blocks).count() == 1
    assert X.collect_handler_calls(blocks, X.extract_handlers(blocks)).count() == 1


def test_layout(spark):
    files = spark.createDataFrame([("r", "api/a.go", SRC)], "repo string, path string, content string")
    lines = X.source_lines(X.scan_filter(files))
    assert lines.count() == SRC.count("\n") + 1
    blocks = X.source_blocks(lines)
    cut = X.file_blocks(X.scan_filter(files))
    assert sorted(map(str, cut.select(*blocks.columns).collect())) == sorted(map(str, blocks.collect()))
    fields = {(r["struct"], r["field"], r["type"], r["json_tag"]) for r in X.extract_struct_fields(blocks).collect()}
    assert fields == {("A", "X", "int", "x"), ("B", "Z", "bool", "z"), ("C", "ID", "string", "id"),
                      ("C", "Meta", "unknown", "m"), ("C", "Tail", "[]B", "tail")}
    routes = {r["line"]: (r["method"], r["route"], r["handler"]) for r in X.extract_routes(blocks).collect()}
    first = SRC[:SRC.index('r.HandleFunc("/a"')].count("\n") + 1
    assert routes == {first: ("ANY", "/a", "h.A"), first + 1: ("GET", "/b", "h.B"), first + 2: ("GET", "/e", "h.E"),
                      first + 3: ("GET", "/c", "h.C"), first + 5: ("POST", "http://x/y", "h.U"), first + 6: ("GET", "/w", "<unknown>")}
