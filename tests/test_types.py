"""Generic structs, named types and route groups."""
from trafficlens.operators import extract as X
from trafficlens.operators import registry as R

SRC = '''package m

type UserID string
type IDs = []UserID
type Deep IDs
type A B
type B A
type Fn func(int) error

type Page[T any] struct {
	Items []T `json:"items"`
	Next *Page[T] `json:"next"`
}

type Pair[K comparable, V any] struct {
	Key K `json:"key"`
	Val V `json:"val"`
	Swap *Pair[V, K] `json:"swap"`
}

type Box[T any] struct { In T `json:"in"` }

type User struct {
	ID UserID `json:"id"`
	All Deep `json:"all"`
	Odd A `json:"odd"`
}

type Out struct {
	Page[User]
	P Pair[string, Box[Box[int]]] `json:"p"`
	M map[string]Page[User] `json:"m"`
}

func routes(r chi.Router) {
	r.Get("/top", h.A)
	r.Route("/v1", func(r chi.Router) {
		r.Get("/a", h.A)
		r.Route(`/deep/`, func(r chi.Router) {
			r.Post("/b", h.B)
		})
		r.Group(func(r chi.Router) {
			r.Put("/c", h.C)
		})
	})
	r.Delete("/z", h.Z)
}
'''


def _scanned(spark):
    return X.scan_source(spark.createDataFrame([("r", "m/a.go", SRC)], "repo string, path string, content string")).checkpoint()


def _paths(fields, root):
    return [(r["field_path"], r["json_type"], r["item_type"]) for r in fields.where(f"root = '{root}'").orderBy("pos").collect()]


def test_generic_fields_expand(spark):
    s = _scanned(spark)
    fields = R.expand_fields(X.extract_struct_fields(s, generics=True)).checkpoint()
    assert _paths(fields, "Out") == [
        ("items", "array", "object"), ("items[].id", "ref", None), ("items[].all", "ref", None), ("items[].odd", "ref", None),
        ("next", "object", None), ("p", "object", None), ("p.key", "string", None), ("p.val", "object", None),
        ("p.val.in", "object", None), ("p.val.in.in", "integer", None), ("p.swap", "object", None), ("p.swap.key", "object", None),
        ("p.swap.key.in", "object", None), ("p.swap.key.in.in", "integer", None), ("p.swap.val", "string", None),
        ("p.swap.swap", "object", None), ("m", "object", None)]
    # without the sources of the types nothing changes
    plain = R.expand_fields(X.extract_struct_fields(s))
    assert _paths(plain, "Out") == [("unknown", "any", None), ("p", "any", None), ("m", "object", None)]


def test_named_types(spark):
    s = _scanned(spark)
    named = X.named_types(s)
    assert {(r["name"], r["target"]) for r in named.collect()} == {
        ("UserID", "string"), ("IDs", "[]UserID"), ("Deep", "IDs"), ("A", "B"), ("B", "A")}
    got = X.resolve_named_types(X.extract_struct_fields(s), named)
    assert {r["field"]: r["type"] for r in got.where("struct = 'User'").collect()} == {"ID": "string", "All": "[]string", "Odd": "A"}
    assert got.columns == X.extract_struct_fields(s).columns


def test_route_groups(spark):
    s = _scanned(spark)
    plain = {(r["method"], r["route"]) for r in X.extract_routes(s).collect()}
    assert plain == {("GET", "/top"), ("GET", "/a"), ("POST", "/b"), ("PUT", "/c"), ("DELETE", "/z")}
    whole = {(r["method"], r["route"]) for r in X.extract_routes(s, groups=True).collect()}
    assert whole == {("GET", "/top"), ("GET", "/v1/a"), ("POST", "/v1/deep/b"), ("PUT", "/v1/c"), ("DELETE", "/z")}
