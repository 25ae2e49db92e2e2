"""Scanning a corpus again: only what changed is extracted, and the result is that of a full scan."""
from pyspark.sql import functions as F

from trafficlens.operators import extract as X
from trafficlens.operators import registry as R
from trafficlens.session import list_names, shared_path

CODE = "package p\n\ntype T struct {{ A int }}\n\nfunc (h *H) Do(w http.ResponseWriter) {{\n\tenc.Encode(T{{}})\n}}\n\nfunc r() {{\n\tr.Get(\"/{0}\", h.Do)\n}}\n"


def _files(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, content string")


def _full(files):
    s = X.scan_source(files)
    e = R.build_registry(X.extract_routes(s), X.collect_handler_calls(s), X.extract_struct_fields(s))
    return sorted(map(str, e.collect()))


def test_rescan_equals_a_full_scan(spark):
    path = shared_path(spark, "rescan-test")
    rows = {(f"r{i}", f"d{k}/a.go"): CODE.format(f"x{i}{k}") for i in range(6) for k in range(3)}
    rows["r1", "bad.go"] = "package p\nfunc ("

    def run():
        files = _files(spark, [(*k, v) for k, v in rows.items()])
        got, n = R.rescan(spark, files, path, buckets=5)
        assert sorted(map(str, got.select(*[c for c in got.columns]).collect())) == _full(files)
        return n

    def written():
        return {b: list_names(spark, f"{path}/scan/{b}") for b in list_names(spark, f"{path}/scan") if b.startswith("bucket=")}

    assert run() == 19 and run() == 0
    before = written()
    rows["r2", "d0/a.go"] = CODE.format("new")
    rows["r2", "e/a.go"] = CODE.format("more")
    del rows["r2", "d1/a.go"]
    assert run() == 2
    after = written()
    assert sum(before[b] != after[b] for b in before) == 1  # one repo's bucket
    for k in [k for k in rows if k[0] in ("r0", "r3")]:
        del rows[k]
    assert run() == 0 and list_names(spark, f"{path}/_pending") == []
    for k in list(rows):
        del rows[k]
    rows["z", "a.txt"] = "package p\n"
    assert run() == 1
    got, n = R.rescan(spark, _files(spark, []), path, buckets=5)
    assert got.count() == 0 and n == 0


def test_an_interrupted_rescan_is_repaired(spark):
    path = shared_path(spark, "rescan-test")
    files = _files(spark, [("r", "a.go", CODE.format("a")), ("q", "a.go", CODE.format("b"))])
    got, _ = R.rescan(spark, files, path, buckets=3)
    # as if the run ended after the scan was written and before the endpoints were
    bucket = f"b{spark.sql('SELECT pmod(xxhash64(\"r\"), 3)').first()[0]}"
    spark.createDataFrame([(bucket,)], "b string").withColumn("x", F.lit(1)).write.partitionBy("b").parquet(f"{path}/_pending")
    R.delete(spark, f"{path}/endpoints/bucket={bucket}")
    again, n = R.rescan(spark, files, path, buckets=3)
    assert n == 0 and sorted(map(str, again.collect())) == _full(files)


def test_a_rescan_broadcasts_no_files(spark, monkeypatch):
    """What is written was joined by way of the driver before: its files' finds were taken for as small as their keys."""
    path, plans, write = shared_path(spark, "rescan-test"), [], R._overwrite

    def spy(spark, rows, *args):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(spark, rows, *args)

    monkeypatch.setattr(R, "_overwrite", spy)
    for name in ("a", "b"):
        files = _files(spark, [("r", "a.go", CODE.format(name)), ("q", "a.go", CODE.format("c"))])
        got, n = R.rescan(spark, files, path, buckets=3)
    assert n == 1 and len(plans) == 4 and not any("Broadcast" in p for p in plans)
    assert sorted(map(str, got.collect())) == _full(files)
