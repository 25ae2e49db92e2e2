import re
import sys

import corpus_pipeline

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from odd import no_docs, odd_docs  # noqa: E402
from test_decontaminate import brute as contamination  # noqa: E402
from test_minhash import brute as groups  # noqa: E402
from test_quality_rules import brute as counts  # noqa: E402
from test_scans import brute_secrets  # noqa: E402

from trafficlens.llm.common import table  # noqa: E402
from trafficlens.session import shared_path  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = shared_path(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        before, out = rows, docs.collect()
        if k < 4:
            assert docs.columns == columns
            rows = {r["doc_id"]: r for r in out}
            assert len(rows) == len(out)
        if name == "quality_rules":
            assert all(not counts(r["text"])[-1] and r == before[i] for i, r in rows.items())
            labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
            good = [i for i, y in labels.items() if y == 1 and not counts(before[i]["text"])[-1]]
            assert sum(i in rows for i in good) >= 0.98 * len(good)
        elif name == "minhash_near_dedup":
            want = groups([(i, r["text"]) for i, r in before.items()], 5)
            assert set(rows) == {i for i, (_, c) in want.items() if c == i}
        elif name == "decontamination":
            items = table(spark, SF, "benchmark").collect()
            hits = {i: n for i, _, n, _ in contamination(before.values(), items)}
            assert set(rows) == set(before)
            for i, r in rows.items():
                assert (r["text"] == before[i]["text"]) == (hits[i] == 0)
                assert r["n_chars"] == len(r["text"])
            assert any(hits.values())
        elif name == "secret_scan":
            assert set(rows) == set(before)
            assert any(brute_secrets(r["text"]) for r in before.values())
            assert not any(re.search("[0-9a-f]{32}", r["text"]) for r in rows.values())
            assert all(rows[i] == r for i, r in before.items() if "=" not in r["text"] and not brute_secrets(r["text"]))
        else:
            assert {r["doc_id"] for r in out} == set(before)
            size = {}
            for r in out:
                size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["n_tokens"]
            assert size == {i: len(r["text"].encode().split()) for i, r in before.items()}


def test_odd_rows(spark):
    for docs in (odd_docs(spark, extra=False), odd_docs(spark), no_docs(spark)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, docs, SF)
            got.collect()
            if k < 4:
                assert got.columns == docs.columns


def test_one_of_repeated_rows_stays(spark):
    text, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [(1, text, "a")] * 5 + [(2, text, "b"), (3, text + " more", "c")] + [(4, other, "d")] * 3
    rows += [(None, text, "e")] * 2 + [(5, "", "f")] * 2 + [(1, other + " end x", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted((r["doc_id"] or 0, r["source"]) for r in got.collect()) == [
        (0, "e"), (0, "e"), (1, "a"), (1, "g"), (5, "f"), (5, "f")]


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
