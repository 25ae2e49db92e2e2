"""Inputs derived from the driver's tables (events, pages, part).

Each function is a narrow projection over one scanned table, so Catalyst prunes
the parquet read to the columns used and the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a table from which a task makes source files or struct fields: text of some hundred times their size.
ROWS_PER_TASK = 4000


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the rows made from it need: a few bytes of a table, all in one split,
    stand for a whole repository.  The rows are counted; a table that is spread already stays as it is."""
    parts = -(-df.count() // ROWS_PER_TASK)
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(parts, min(cores, parts * 8))
    return df if parts <= 1 or df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))


def requests_from_events(events: DataFrame) -> DataFrame:
    """Request log: one request per event (method/path/query/body by event type)."""
    et = F.col("event_type")
    uid = F.col("user_id").cast("string")
    method = (F.when(et.isin("view", "click"), "GET")
              .when(et.isin("signup", "purchase"), "POST")
              .otherwise("PATCH"))
    path = (F.when(et == "view", F.concat(F.lit("/api/users/users/"), uid))
            .when(et == "click", F.concat(F.lit("/api//orders/"), uid, F.lit("/items/")))
            .when(et == "signup", F.lit("/api/users/users"))
            .when(et == "purchase", F.concat(F.lit("api/orders/"), uid))
            .otherwise(F.concat(F.lit("/nope/"), uid)))
    query = F.when(et == "view", F.concat(
        F.lit("page="), (F.col("event_id") % 3).cast("string"), F.lit("&tag=a%20b&tag=c"))
    ).otherwise(F.lit(""))
    body = F.when(et.isin("signup", "purchase"), F.col("props")).otherwise(F.lit(""))
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id"),
        method.alias("method"), path.alias("path"), query.alias("query"), body.alias("body"),
        F.col("value").alias("latency_ms"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from_events(table(spark, sf_dir, "events"))


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GET requests taken from real-looking page URLs."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("request_id"),
        F.lit("GET").alias("method"),
        F.regexp_extract(url, r"^[a-z]+://[^/]+([^?#]*)", 1).alias("path"),
        F.regexp_extract(url, r"[?]([^#]*)", 1).alias("query"),
        F.lit("").alias("body"))


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-like outputs: trailing commas, fences, empty arrays, non-JSON."""
    props, eid = F.col("props"), F.col("event_id")
    nl = F.lit("\n")
    raw = (F.when(eid % 5 == 0, F.concat(F.lit("["), F.replace(props, F.lit("}"), F.lit(",}")), F.lit("]")))
           .when(eid % 5 == 1, F.concat(F.lit("Here it is:"), nl, F.lit("```json"), nl,
                                        F.lit("["), props, F.lit(",]"), nl, F.lit("```")))
           .when(eid % 5 == 2, F.concat(F.lit("```"), nl, F.lit("["), props, F.lit("]"), nl, F.lit("```")))
           .when(eid % 5 == 3, F.lit("[]"))
           .otherwise(F.concat(F.lit("not json "), eid.cast("string"))))
    return table(spark, sf_dir, "events").select(eid.alias("output_id"), raw.alias("raw"))


def source_files_from_parts(part: DataFrame) -> DataFrame:
    """One Go source file per part: several frameworks, vendor and test files,
    nested/untagged/unexported fields, both handler kinds, three route forms."""
    size = F.col("p_size")
    sz = size.cast("string")
    tab = F.lit("\t")
    path = (F.when(size % 7 == 0, "vendor/lib/api.go")
            .when(size % 7 == 1, "api/api_test.go")
            .otherwise("api/api.go"))
    fw = (F.when(size % 5 == 0, "github.com/go-chi/chi/v5")
          .when(size % 5 == 1, "github.com/gin-gonic/gin")
          .when(size % 5 == 2, "github.com/labstack/echo/v4")
          .when(size % 5 == 3, "github.com/gorilla/mux")
          .otherwise("encoding/json"))
    lines = [
        F.lit("package api"), F.lit(""),
        F.lit("import ("), F.concat(tab, F.lit('"net/http"')),
        F.concat(tab, F.lit('"'), fw, F.lit('"')),
        F.lit(")"), F.lit(""),
        F.lit("// Part is one catalogue entry."),
        F.lit("type Part struct {"),
        F.concat(tab, F.lit('ID string `json:"id"`')),
        F.concat(tab, F.lit('Size int `json:"size_'), sz, F.lit(',omitempty"`')),
        F.concat(tab, F.lit('Made *Maker `json:"made"`')),
        F.concat(tab, F.lit("Seen time.Time")),
        F.concat(tab, F.lit("hidden bool")),
        F.lit("}"), F.lit(""),
        F.lit("type Maker struct {"), F.concat(tab, F.lit('Name string `json:"name"`')),
        F.concat(tab, F.lit('Tags []string `json:"tags,omitempty"`')), F.lit("}"), F.lit(""),
        F.lit("func (h *API) GetPart(w http.ResponseWriter, r *http.Request) {"),
        F.concat(tab, F.lit("part := Part{}")),
        F.concat(tab, F.lit("w.WriteHeader(http.StatusOK)")),
        F.concat(tab, F.lit("json.NewEncoder(w).Encode(part)")),
        F.lit("}"), F.lit(""),
        F.lit("func (h *API) AddPart(w http.ResponseWriter, r *http.Request) {"),
        F.concat(tab, F.lit("var in Part")),
        F.concat(tab, F.lit("json.NewDecoder(r.Body).Decode(&in)")),
        F.concat(tab, F.lit("w.WriteHeader(201)")),
        F.concat(tab, F.lit("json.NewEncoder(w).Encode(in)")),
        F.lit("}"), F.lit(""),
        F.lit("func Routes(r Router) {"),
        F.concat(tab, F.lit('r.Get("/parts/{id}", h.GetPart)')),
        F.concat(tab, F.lit('r.HandleFunc("POST /parts", h.AddPart)')),
        F.concat(tab, F.lit('r.HandleFunc("/legacy/'), sz, F.lit('", h.GetPart)')),
        F.lit("}"),
    ]
    return part.select(
        F.concat(F.lit("svc-"), F.col("p_partkey").cast("string")).alias("repo"),
        path.alias("path"),
        F.concat_ws("\n", *lines).alias("content"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files_from_parts(_parts(spark, sf_dir))


# The files of one service, as (path, text); %N% is the part's size.  Calls, signatures and structs run
# over several lines or stand on one, routes lie in nested functions, arguments nest deeply.
SERVICE_FILES = [
    ("model/types.go", """package model

type (
	Page[T any] struct {
		Items []T `json:"items"`
		Total int `json:"total_%N%"`
	}
	Pair[K comparable, V any] struct { Key K `json:"key"`; Value *V `json:"value,omitempty"` }
)

type Item struct{ ID string `json:"id"`; Size, Weight int; hidden bool }

type SKU string

type Codes = []SKU

type ItemPage struct {
	Page[Item]
	Next Pair[string, Item] `json:"next"`
	Seen map[string][]time.Time `json:"seen"`
	Codes Codes `json:"codes"`
	First *SKU `json:"first"`
}
"""),
    ("api/items.go", """package api

import "net/http"

// Create stores an item; its signature runs over lines.
func (h *Handler) Create(
	w http.ResponseWriter, // the answer
	r *http.Request,
) {
	var in model.Item
	if err := json.NewDecoder(
		r.Body,
	).Decode(
		&in,
	); err != nil {
		http.Error(w, "bad )", http.StatusBadRequest)
		return
	}
	out := model.ItemPage{
		Next: model.Pair[string, model.Item]{},
	}
	w.WriteHeader(
		http.StatusCreated,
	)
	json.NewEncoder(w).Encode(
		out,
	)
}

func (h *Handler) List(c *gin.Context) {
	items := []model.Item{}
	c.JSON(20%D%, wrap(a(b(c1(d(e(f(g(h1(i(j("(%N%"))))))))))), items)
}

func helper(n int) int { return n }
"""),
    ("cmd/server/main.go", """package main

func routes(r chi.Router, h *api.Handler) {
	r.Post(
		"/items",
		h.Create,
	)
	r.
		With(auth).
		Get("/items/%N%", h.List)
	r.Route("/v1", func(r chi.Router) {
		r.Get("/deep", func(w http.ResponseWriter, r *http.Request) {
			w.WriteHeader(200)
		})
		r.Put("/items/{id}", limit(m1(m2(m3(m4(m5(m6(m7(m8(m9(h.Create)))))))))))
	})
	mux.HandleFunc("DELETE /items/{id}", h.List)
	mux.Handle(
		"/raw", h.List)
}
"""),
    ("cmd/server/broken.go", "package main\n\nfunc broken() {\n\tr.Get(\"/lost\", h.Lost\n}\n"),
]


def service_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files and directories per part; the status in one handler comes from the part (200 to 209)."""
    size = F.col("p_size").cast("string")
    digit = (F.col("p_size") % 10).cast("string")
    each = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in SERVICE_FILES])
    files = _parts(spark, sf_dir).select(
        F.concat(F.lit("svc-"), F.col("p_partkey").cast("string")).alias("repo"), size.alias("n"), digit.alias("d"),
        F.inline(each))
    text = F.replace(F.replace("text", F.lit("%N%"), F.col("n")), F.lit("%D%"), F.col("d"))
    return files.select("repo", "path", text.alias("content"))


# Further structs of every nested corpus, as (path, package, struct, pos, field, type, json_tag, omitempty).
NESTED_STRUCTS = [
    ("models/user.go", "models", "User", 0, "Name", "string", "name", False),
    ("models/user.go", "models", "User", 1, "Ext", "dto.User", "ext", True),
    ("dto/user.go", "dto", "User", 0, "Phone", "string", "phone", False),
    ("cmd/a/main.go", "main", "Config", 0, "Alpha", "int", "alpha", False),
    ("cmd/b/main.go", "main", "Config", 0, "Beta", "*bool", "beta", False),
    ("models/node.go", "models", "Base", 0, "ID", "uuid.UUID", "id", False),
    ("models/node.go", "models", "Node", 0, "Base", "Base", "", False),
    ("models/node.go", "models", "Node", 1, "Kids", "[]Node", "kids", True),
    ("models/node.go", "models", "Node", 2, "Owner", "*User", "owner", False),
    ("models/node.go", "models", "Node", 3, "Secret", "string", "-", False),
]


def nested_struct_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2-shaped rows of one corpus per part: a chain of 10 to 13 structs that ends in a cycle, and
    equal names in two packages, one package name in two directories, embedding and a self-reference."""
    part = _parts(spark, sf_dir).select(
        F.concat(F.lit("svc-"), F.col("p_partkey").cast("string")).alias("repo"), (F.col("p_size") % 4 + 9).alias("last"))
    link = part.select("repo", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    link = link.select("repo", "last", "i", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    own, nxt = F.col("i").cast("string"), F.when(F.col("i") < F.col("last"), F.col("i") + 1).otherwise(F.lit(0))
    chain = link.select(
        "repo", F.lit("deep/chain.go").alias("path"), F.lit("deep").alias("package"),
        F.concat(F.lit("S"), own).alias("struct"), "pos",
        F.when(F.col("pos") == 0, "Val").otherwise("Next").alias("field"),
        F.when(F.col("pos") == 0, "float64").otherwise(F.concat(F.lit("*S"), nxt.cast("string"))).alias("type"),
        F.when(F.col("pos") == 0, F.concat(F.lit("v"), own)).otherwise("next").alias("json_tag"),
        F.lit(False).alias("omitempty"))
    names = ("path", "package", "struct", "pos", "field", "type", "json_tag", "omitempty")
    fixed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in NESTED_STRUCTS])
    return chain.unionByName(part.select("repo", F.inline(fixed)))


# The registry served to the derived request log.
# (dependency, prefix, ord, method, path, status_code)
FIXTURE_ROUTES = [
    ("user-service", "/api/users", 0, "GET", "/users", 200),
    ("user-service", "/api/users", 1, "GET", "/users/:id", 200),
    ("user-service", "/api/users", 2, "GET", "/users/me", 200),
    ("user-service", "/api/users", 3, "POST", "/users", 201),
    ("edge-service", "/api", 4, "ANY", "/orders/{orderId}", 200),
    ("edge-service", "/api", 5, "GET", "/orders/{orderId}/items", 200),
    ("edge-service", "/api", 6, "GET", "/users/users/{uid}", 200),
    ("root-service", "/", 7, "GET", "/health", 200),
]


def fixture_registry(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(endpoints, dependencies) for the derived request log."""
    rows = spark.createDataFrame(
        FIXTURE_ROUTES, "dependency string, prefix string, ord int, method string, path string, status_code int")
    endpoints = rows.select(
        "dependency", "ord", "method", "path",
        F.concat(F.col("method"), F.lit(" "), F.col("path")).alias("description"),
        F.lit(None).cast("string").alias("request_type"),
        F.lit(None).cast("string").alias("response_type"),
        F.lit("object").alias("body_type"),
        "status_code")
    deps = rows.select(F.col("dependency").alias("name"), "prefix").distinct().select(
        "name", "prefix", F.lit(None).cast("string").alias("repo"),
        F.array().cast("array<string>").alias("scan_paths"))
    return endpoints, deps


__all__ = [
    "table", "requests", "requests_from_events", "page_requests", "raw_outputs",
    "source_files", "source_files_from_parts", "service_files", "nested_struct_fields", "fixture_registry", "FIXTURE_ROUTES", "schemas",
]
