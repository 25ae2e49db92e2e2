"""Nested, slice-of-struct, embedded, ignored and cyclic fields."""
from trafficlens.operators import extract as X
from trafficlens.operators import registry as R

SRC = """package models

type Base struct {
\tID string `json:"id"`
}

type Node struct {
\tBase
\tName string `json:"name"`
\tSecret string `json:"-"`
\tKids []Node `json:"kids,omitempty"`
\tOwner *User `json:"owner"`
}

type User struct {
\tEmail string `json:"email"`
}
"""


def test_expand_fields(spark):
    files = spark.createDataFrame([("repo", "models/m.go", SRC)], "repo string, path string, content string")
    sf = X.extract_struct_fields(X.source_blocks(X.source_lines(X.scan_filter(files))))
    out = R.expand_fields(sf).where("root = 'Node'").orderBy("pos").collect()
    got = [(r["field_path"], r["depth"], r["json_type"], r["required"]) for r in out]
    assert got == [("id", 0, "string", True), ("name", 0, "string", True), ("kids", 0, "array", False),
                   ("owner", 0, "object", True), ("owner.email", 1, "string", True)]


def test_a_walk_gives_the_rows_of_the_joins(spark, monkeypatch):
    """Small repos are walked and only their fields stored; before, every level of every path was stored."""
    chain = [("r1", "deep/c.go", "deep", f"S{i}", p, f, t, j, False) for i in range(6)
             for p, f, t, j in ((0, "Val", "float64", f"v{i}"), (1, "Next", f"*S{(i + 1) % 6}", "next"))]
    odd = [("r2", "a/x.go", "a", "T", 0, "Base", "Base", "", False), ("r2", "a/x.go", "a", "T", 1, "Kids", "[]T", "kids", True),
           ("r2", "a/x.go", "a", "T", 2, "Other", "b.Base", "other", False), ("r2", "a/x.go", "a", "Base", 0, "ID", "uuid.UUID", "", False),
           ("r2", "b/x.go", "b", "Base", 0, "Name", "string", "name", False), ("r2", "b/y.go", "b", "Base", 0, "Name", "[]Leaf", "names", False),
           ("r2", "b/y.go", "b", "Leaf", 0, "X", "map[string]int", "x", False), ("r2", "b/y.go", "b", "Leaf", None, "Y", None, "y", None),
           ("r2", "c/z.go", "c", "P", 0, "Items", "Page[T]", "items", False), ("r2", "c/z.go", "c", "Page", 0, "Q", "Page[Page[T]]", "q", False),
           ("r2", None, "d", "N", 0, "T", "b.Base", "t", False), ("r2", "d/d.go", None, "N", 0, None, "N", None, False),
           (None, "a/x.go", "a", "T", 0, "Kids", "[]T", "kids", True), ("r2", "a/x.go", "a", "T", 3, "Gone", "int", "-", False)]
    twice = [("r3", *r[1:]) for r in odd[:7] for _ in (0, 1)]
    df = spark.createDataFrame(chain + odd + twice, "repo string, path string, package string, struct string, pos int, field string, "
                                                    "type string, json_tag string, omitempty boolean")
    plain = lambda rows, cols: sorted(str([r[c] for c in cols]) for r in rows)
    walked = R.expand_fields(df)
    assert "Window" not in walked._jdf.queryExecution().executedPlan().toString()
    got = {"walk": walked.collect()}
    for name, most in (("joins", 0), ("both", 11)):
        monkeypatch.setattr(R, "WALK_FIELDS", most)
        got[name] = R.expand_fields(df).collect()
    cols = [c for c in walked.columns if c != "pos"]
    where = ["repo", "root_dir", "root_package", "root", "pos"]
    assert len(got["walk"]) > 100 and any(r["repo"] is None for r in got["walk"])
    for name in ("joins", "both"):
        assert sorted(got[name][0].asDict()) == sorted(walked.columns)
        assert plain(got[name], cols) == plain(got["walk"], cols) and plain(got[name], where) == plain(got["walk"], where)
        once = lambda rows: [r for r in rows if r["repo"] == "r1"]
        assert plain(once(got[name]), walked.columns) == plain(once(got["walk"]), walked.columns)
    monkeypatch.undo()
    monkeypatch.setattr(R, "_WALK_ROWS", 7)
    assert plain(R.expand_fields(df).collect(), cols) == plain(got["walk"], cols)
