"""Work made from small tables runs on many tasks; planner's guesses of sizes decide no broadcast; keys cost no more for length."""
import datetime as dt
import random
import threading
import time

from pyspark.sql import functions as F

from trafficlens.functions import gosrc as G
from trafficlens.functions.goscan import scan
from trafficlens.operators import extract as X
from trafficlens.operators import generate as GEN
from trafficlens.operators import registry as R
from trafficlens.operators import ttl
from trafficlens.plans import q_generate
from trafficlens.sources import derived as D


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _part(spark, folder, rows):
    (spark.range(rows).coalesce(1).select((F.col("id") + 1).alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"))
     .write.parquet(f"{folder}/part.parquet"))


def test_files_of_one_split_make_many_tasks(spark, tmp_path):
    sf = str(tmp_path)
    _part(spark, sf, 3 * D.ROWS_PER_TASK)
    files = {"source": D.source_files(spark, sf), "service": D.service_files(spark, sf), "nested": D.nested_struct_fields(spark, sf)}
    for name, df in files.items():
        assert df.rdd.getNumPartitions() >= 3, name
        assert df.select("repo").distinct().count() == 3 * D.ROWS_PER_TASK
    assert D.spread(spark.range(9).coalesce(1).limit(0)).count() == 0


def test_struct_fields_come_from_one_pass(spark, tmp_path):
    _part(spark, str(tmp_path), 20)
    fields = X.extract_struct_fields(X.scan_source(D.source_files(spark, str(tmp_path))))
    assert _plan(fields).count("MapInArrow") == 1
    src = "package p\n\ntype A struct {\n\tX, y, Z int `json:\",omitempty\"`\n\t*q.Base\n\tinner\n\tW string `json:\"-\"`\n}\n"
    files = spark.createDataFrame([("r", "p/a.go", src)], "repo string, path string, content string")
    got = [tuple(r) for r in X.extract_struct_fields(X.scan_source(files)).orderBy("pos")
           .select("field", "type", "json_tag", "omitempty").collect()]
    assert got == [("X", "int", "x", True), ("Z", "int", "z", True), ("*q.Base", "*q.Base", "", False), ("inner", "inner", "", False),
                   ("W", "string", "-", False)]


def test_dotted_names_are_tokens_of_one_statement():
    text = "package p\n\nfunc f() {\n\ta . b.c(x.y ...)\n\tr.\n\t\tGet(\"/a\", h.i.J) // c\n\tdefer.x.go(1.5.e)\n}\n"
    found = scan(text, lambda _: True)
    assert [(name, args) for _, _, _, _, name, args in found["calls"]] == [("c", ["x.y ..."]), ("Get", ['"/a"', "h.i.J"]), ("go", ["1.5.e"])]
    assert [s[5] for s in found["statements"]][0] == "a . b.c(x.y ...)"


def test_expansion_broadcasts_no_struct_table(spark, tmp_path):
    _part(spark, str(tmp_path), 20)
    typed = D.nested_struct_fields(spark, str(tmp_path))
    refs = typed.withColumn("dir", R.directory(F.col("path")))
    found = R._struct_lookup(refs, typed, "type", "dir", "child", ["repo", "path", "struct", "pos"])
    assert "BroadcastHashJoin" not in _plan(found)
    plan = _plan(R.expand_fields(typed))
    assert "Join" not in plan  # every level is looked up once and kept


def test_default_folds_small_keys_and_jumps_for_large_ones(spark, monkeypatch):
    rnd, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 2 else rnd.choice(["a", "b", None]), "x" if i % 3 else "y",
             None if i % 97 == 0 else t0 + dt.timedelta(seconds=rnd.randint(0, 9000))) for i in range(1500)]
    df = spark.createDataFrame(rows, "request_id long, k string, l string, ts timestamp")
    monkeypatch.setattr(ttl, "FOLD_ROWS", 200)
    flags = {s: {r["request_id"]: (r["hit"], r["entry_created_at"]) for r in
                 ttl.ttl_dedup(df, ["k", "l"], ttl_seconds=60, strategy=s).collect()} for s in ("auto", "jump", "fold")}
    assert len(flags["auto"]) == 1500 and flags["auto"] == flags["jump"]
    known = {i for i, k, _, t in rows if k is not None and t is not None}
    assert {i: flags["fold"][i] for i in known} == {i: flags["auto"][i] for i in known}
    assert any(not hit for hit, _ in flags["auto"].values())


def test_small_keys_take_no_jumps(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"k{i % 5}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)) for i in range(100)],
                               "request_id long, key string, ts timestamp")
    monkeypatch.setattr(ttl, "_starts_jump", lambda *_: (_ for _ in ()).throw(AssertionError("jumps for small keys")))
    assert ttl.ttl_dedup(df, "key", ttl_seconds=30).where("not hit").count() == 15


def test_corpus_joins_broadcast_nothing(spark, tmp_path):
    _part(spark, str(tmp_path), 20)
    s = X.scan_source(D.source_files(spark, str(tmp_path))).checkpoint()
    sf, rt, hd = X.extract_struct_fields(s).checkpoint(), X.extract_routes(s).checkpoint(), X.collect_handler_calls(s).checkpoint()
    fw = spark.createDataFrame([("svc-1", "chi")], "repo string, framework string")
    eps = R.build_registry(rt, hd, sf)
    deps = rt.select(F.col("repo").alias("name"), "repo").distinct()
    for df in (eps, R.registry_summary(eps, deps, fw), R.scan_summary(rt, sf, rt, hd, fw),
               GEN.build_analysis_prompts(sf, rt, hd, fw, by_package_over=10)):
        assert "BroadcastHashJoin" not in _plan(df)


def test_finds_become_columns_without_an_object_for_each(spark, monkeypatch):
    text = "package p\n\ntype A struct {\n\tX int\n}\n\nfunc F(c C) {\n\tx, y := A{}, &B{1}\n\tx.JSON(201, y)\n}\n"
    files = spark.createDataFrame([("r", f"a{i:03}.go", None if i == 7 else "x" if i == 8 else "package q" if i == 9 else text)
                                   for i in range(600)], "repo string, path string, content string").coalesce(1)
    monkeypatch.setattr(X, "_SCAN_ROWS", 100)
    got = {r["path"]: r for r in X.scan_source(files).collect()}
    assert len(got) == 598 and "a007.go" not in got and "a008.go" not in got
    assert got["a009.go"]["statements"] == got["a009.go"]["calls"] == got["a009.go"]["funcs"] == []
    one, found = got["a599.go"], scan(text, X._wanted)
    assert [tuple(s) for s in one["statements"]] == found["statements"] and [tuple(c) for c in one["calls"]] == found["calls"]
    assert [tuple(f) for f in one["funcs"]] == found["funcs"] and one["package"] == "p"


def test_a_types_text_is_made_once(spark):
    types = ["Part", "*Part", " []http.Part\t", "...*a.B", "chan", "*func", "struct", "[4]int", "map[ string ] []T", "map[K]chan int",
             "interface { F() }", "Page[T]", "", "a.b.c", "func(x int)", "[][]byte", "[]map[string]*q.T", None]
    df = spark.createDataFrame([(t,) for t in types], "t string").coalesce(1)
    assert [r[0] for r in df.select(G.type_text("t")).collect()] == [
        "Part", "*Part", "[]http.Part", "...*a.B", "unknown", "*unknown", "unknown", "[]int", "map[string][]T", "map[K]unknown",
        "interface{}", "unknown", "unknown", "a.b.c", "unknown", "[][]byte", "[]map[string]*q.T", None]
    text = df.select(F.transform(F.array("t"), G.type_text).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert text.count("interface ?") <= 2  # was written out for each use of its result


def test_calls_share_a_thread_for_each_client(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(300)], "id int, prompt string").coalesce(1)

    def make():
        seen = set()

        def client(system, prompt):
            seen.add(threading.get_ident())
            if prompt in ("p5", "p6"):
                time.sleep(1.5)
            return str(len(seen))
        return client

    got = {r["id"]: r for r in GEN.batch_infer(prompts, make, max_retries=1, sleep=lambda _: None, timeout_seconds=0.5).collect()}
    assert {r["response"] for r in got.values() if r["id"] not in (5, 6)} == {"1"}  # a thread for every call before
    assert all(got[i]["response"] is None and "no answer in 0.5 s" in got[i]["error"] and got[i]["attempts"] == 2 for i in (5, 6))


def test_the_matchings_registry_is_stored_once(spark, tmp_path):
    _part(spark, str(tmp_path), 20)
    _, _, _, _, eps, routes = q_generate._corpus_flow(spark, str(tmp_path), matched=True)
    for df in (eps, routes):  # each read of the routes joined and numbered the registry anew before
        text = _plan(df)
        assert "Window" not in text and "Scan parquet" in text and "Broadcast" not in text
    assert eps.count() == sum(1 for k in range(20) if k % 50 % 7 > 1) * 3


def test_a_scan_returns_what_its_reader_needs(spark):
    text = ("package p\n\ntype (\n\tA struct {\n\t\tX, Y int `json:\"x\"`\n\t\tB\n\t}\n\tID string\n)\n\nfunc F(c C) {\n\ttype L struct {\n\t\tZ int\n\t}\n"
            "\tv := A{}\n\tr.Route(\"/v\", func(r R) {\n\t\tr.Get(\"/a\", h.A)\n\t})\n}\n")
    files = spark.createDataFrame([("r", "a.go", text), ("r", "b.go", "package q\nfunc g() {\n"), ("r", "c.go", "package q\n")],
                                  "repo string, path string, content string").coalesce(1)
    every, types, calls = (X.scan_source(files, k).checkpoint() for k in ("all", "types", "calls"))
    assert types.columns == ["repo", "path", "package", "statements"] and calls.columns == ["repo", "path", "package", "calls"]
    assert {r["path"] for r in types.collect()} == {r["path"] for r in calls.collect()} == {"a.go", "c.go"}
    rows = lambda df: sorted(map(str, df.collect()))
    for generics in (False, True):
        assert rows(X.extract_struct_fields(types, generics)) == rows(X.extract_struct_fields(every, generics)) != []
    assert rows(X.named_types(types)) == rows(X.named_types(every)) != []
    assert rows(X.extract_routes(calls, groups=True)) == rows(X.extract_routes(every, groups=True)) != []
    assert all("v :=" not in s["text"] for r in types.collect() for s in r["statements"])


def test_a_text_without_block_comments_is_not_cut_in_pieces(spark):
    texts = ["package p // c\n", "a := \"//x\" // \"y\n", "b := `// raw\n//` // z", "r := '\"' // q\n", "x := \"\\\"//\" + '\\'' // e", "type (\n\tA struct {\n\t\tB int\n\t}\n)\n",
             "type T struct {\n\tN struct {\n\t\tA int // c\n\t} `json:\"n\"`\n}\n", "/* a\n// b */ c // d", "\"/*\" // x", "a\r\n// b\r\nc", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    assert [r[0] for r in df.orderBy("i").select(X.clean_source(F.col("t"))).collect()] == [
        "package p \n", "a := \"//x\" \n", "b := `// raw\n//` ", "r := '\"' \n", "x := \"\\\"//\" + '\\'' ", "\ntype A struct {\n\tB int\n}\n\n",
        "type T struct {\n\tN struct{} `json:\"n\"`\n\n\n}\n", "\n c ", "\"/*\" ", "a\n\nc", "", None]
    plain = df.select(F.transform(F.array("t"), lambda t: X._count_breaks(t)).alias("n"))
    assert [r[0][0] for r in plain.collect()] == [None if t is None else t.count("\n") for t in texts]


def test_templates_come_with_the_endpoint(spark):
    """One join on the endpoint for each miss; it was one for its struct and another for the struct's template."""
    fields = spark.createDataFrame([("r", "a", "p", "T", "x", 0, 0, "x", "string", None, None), ("r", "a", "p", "U", "n", 0, 0, "n", "integer", None, None)],
                                   "repo string, root_dir string, root_package string, root string, field_path string, depth int, pos int, json_key string, "
                                   "json_type string, format string, item_type string")
    ends = spark.createDataFrame([("d", 0, "r", "a", "p", "T", "object"), ("d", 1, "r", "a", "p", "U", "array"), ("e", 0, "r", None, None, None, "object")],
                                 "dependency string, ord int, repo string, response_dir string, response_package string, response_type string, body_type string")
    misses = spark.createDataFrame([(i, f"k{i}", *at) for i, at in enumerate([("d", 0), ("d", 1), ("e", 0), ("d", 7), (None, 0)])],
                                   "request_id int, request_key string, dependency string, endpoint_ord int").withColumn(
        "path_params", F.array().cast("array<struct<key:string,value:string>>"))
    got = GEN.generate_responses(misses, fields, ends)
    plan = _plan(got).split("Initial Plan")[0]
    assert plan.count("Join") == 1 and "Broadcast" not in plan
    old = misses.join(ends.withColumnRenamed("ord", "endpoint_ord"), ["dependency", "endpoint_ord"], "left").select(*got.columns[:-1])
    rows = lambda df: sorted(map(str, df.select(*got.columns).collect()))
    assert rows(got) == rows(GEN.generate_responses(old, fields)) and got.where("body = '{}'").count() == 3


def test_keys_are_counted_by_number_first(spark, monkeypatch):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, ("hot" if i % 3 else f"k{i}") if i % 50 else None, t0 + dt.timedelta(seconds=7 * i)) for i in range(600)],
                               "request_id long, key string, ts timestamp")
    want = {s: sorted(map(str, ttl.ttl_dedup(df, "key", ttl_seconds=30, strategy=s).collect())) for s in ("auto", "jump")}
    assert want["auto"] == want["jump"]
    seen = []
    monkeypatch.setattr(F, "xxhash64", lambda *c: seen.append(c) or F.lit(1).cast("long"))  # all keys share one number
    monkeypatch.setattr(ttl, "FOLD_ROWS", 100)
    assert sorted(map(str, ttl.ttl_dedup(df, "key", ttl_seconds=30).collect())) == want["auto"] and seen


def test_a_stored_step_frees_what_it_shuffled(spark, monkeypatch):
    from trafficlens.session import stored
    df = spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()
    got, path = stored(df, "test")
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    left = store.shuffleStatuses().size()
    for _ in range(3):
        stored(df, "test")
        time.sleep(0.5)
    assert store.shuffleStatuses().size() <= left + 2 and got.count() == 10  # three runs' shuffles stayed before
