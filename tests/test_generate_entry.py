"""Model calls with retries, and the driver contract."""
import time
from collections import Counter

import pytest

from trafficlens.operators.generate import batch_infer


def test_retries_then_error_row(spark):
    def _failing_factory():
        calls = {"n": 0}

        def client(system, prompt):
            calls["n"] += 1
            raise RuntimeError(f"boom {calls['n']}")
        return client

    df = spark.createDataFrame([("p",)], "prompt string").coalesce(1)
    r = batch_infer(df, _failing_factory, max_retries=1, sleep=lambda s: None).first()
    assert r["attempts"] == 2 and r["response"] is None and "boom 2" in r["error"]


def test_invalid_output_retries_at_once(spark):
    def factory():
        outs = iter(["not json", "```json\n[{\"method\":\"GET\",}]\n```"])
        return lambda s, p: next(outs)
    df = spark.createDataFrame([("p",)], "prompt string").coalesce(1)
    r = batch_infer(df, factory, max_retries=2, validate="endpoints", sleep=lambda s: None).first()
    assert r["attempts"] == 2 and r["error"] is None


def test_entry_contract(spark):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    df = E.entry(spark)
    assert df.count() >= 0 and "requests" in df.columns


@pytest.mark.parametrize("name", ["match_requests", "ttl_dedup", "repair_json", "struct_fields", "error_responses"])
def test_queries_run_on_smoke_data(spark, name):
    import __spark_entry__ as E
    assert E.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_hanging_calls_end_as_error_rows(spark):
    """One prompt never returns: its row fails in time, the others of its task are answered at the same time."""
    def factory():
        def client(system, prompt):
            time.sleep(60 if prompt == "p3" else 0.4)
            return prompt.upper()
        return client

    df = spark.createDataFrame([(f"p{i}",) for i in range(12)], "prompt string").coalesce(1)
    began = time.time()
    got = {r["prompt"]: (r["response"], r["attempts"], r["error"]) for r in
           batch_infer(df, factory, max_retries=1, sleep=lambda _: None, timeout_seconds=1.5, concurrency=12).collect()}
    assert time.time() - began < 20
    assert got.pop("p3")[1:] == (2, "failed after 2 attempts: call failed: no answer in 1.5 s")
    assert all(v == (k.upper(), 1, None) for k, v in got.items()) and len(got) == 11


def test_answers_are_kept_and_never_asked_twice(spark, tmp_path):
    from trafficlens.session import shared_path
    log, path = str(tmp_path / "calls"), shared_path(spark, "answers-test")

    def factory(fails):
        def make():
            def client(system, prompt):
                with open(log, "a") as f:
                    f.write(prompt + "\n")
                if fails and prompt == "p5":
                    raise RuntimeError("down")
                return f"<{prompt}>"
            return client
        return make

    df = spark.createDataFrame([(i, f"p{i % 40}") for i in range(90)], "id long, prompt string").repartition(3)
    run = lambda fails, rows=df: batch_infer(rows, factory(fails), max_retries=1, sleep=lambda _: None, answers_path=path).collect()
    calls = lambda: Counter(open(log).read().split())
    first = run(True)
    assert len(first) == 90 and {r["prompt"] for r in first if r["error"]} == {"p5"}
    assert calls() == Counter({f"p{i}": 2 if i == 5 else 1 for i in range(40)})
    again = run(False)
    assert all(r["response"] == f"<{r['prompt']}>" and r["error"] is None for r in again) and len(again) == 90
    assert calls()["p5"] == 3 and sum(calls().values()) == 42  # only the failed one is asked again
    run(False, df.repartition(7))
    assert sum(calls().values()) == 42
