import collections
import hashlib
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.llm.odd import no_docs, odd_docs
from trafficlens.llm import mixing as m

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _size(text):
    return len(WORDS.findall(text or ""))


def _targets(sizes, weights=m.WEIGHTS, limit=m.LIMIT):
    """Exact targets by the plain rule: share by weight, stop at the limit, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, at, rest = sum(sizes.values()), {}, set(order)
    while rest:
        left = total - sum(at.values())
        share = sum(w[s] for s in rest)
        over = {s for s in rest if Fraction(left * w[s], share) > limit * sizes[s]}
        if not over:
            return {**at, **{s: Fraction(left * w[s], share) for s in rest}}
        at.update({s: Fraction(limit * sizes[s]) for s in over})
        rest -= over
    return at


def _key(v):
    return "1" if v is None else f"0{v}"


def _brute(rows):
    """(doc_id, source, size, target, taken) of each row of (doc_id, text, source)."""
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += _size(t)
    target, seen, out = _targets(sizes), collections.Counter(), []
    for i, t, s in rows:
        n, rate = _size(t), (target[s] / sizes[s] if sizes[s] else Fraction(0))
        key = (_key(i), _key(s), "" if t is None else hashlib.md5(t.encode()).hexdigest())
        draw = hashlib.md5("|".join([*key, str(seen[key])]).encode()).hexdigest()[:13]
        seen[key] += 1
        times = rate // 1 + (int(draw, 16) / 16 ** 13 < float(rate % 1))
        out.append((i, s, n, float(target[s]), int(times) * n, int(times)))
    return out


def _sorted(rows):
    return sorted(rows, key=repr)


def _run(df):
    return _sorted(tuple(r) for r in m.repetitions(df).select("doc_id", "source", "size", "target", "taken", "copies")
                   .collect())


def _close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[4:] == w[4:] and g[3] == pytest.approx(w[3], rel=1e-12)


def test_against_brute_force(spark):
    rows = [(i, "w " * (i % 37), f"s{'é' if i % 5 == 4 else ''}{i % 5}") for i in range(600)]
    rows += [(i, "x y z", "tiny") for i in range(1000, 1003)] + [(i, "q " * 3, None) for i in range(2000, 2010)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = _run(df)
    _close(got, _sorted(_brute(rows)))
    assert got == _run(df.repartition(2))
    per = collections.defaultdict(lambda: [0, 0, 0])
    for _, s, n, target, taken, _ in got:
        assert taken <= 3 * n
        per[s] = [per[s][0] + n, target, per[s][2] + taken]
    for s, (n, target, taken) in per.items():
        assert target <= 3 * n and abs(taken - target) <= 0.35 * target
    assert sum(t for _, t, _ in per.values()) == pytest.approx(sum(n for n, _, _ in per.values()))


def test_odd_rows(spark):
    df = odd_docs(spark)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    _close(_run(df), _sorted(_brute(rows)))
    assert m.repetitions(no_docs(spark)).count() == 0 and m.mix(no_docs(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in m.repetitions(nothing).collect()] == [(0.0, 0)] * 2


def test_mix_emits_whole_rows(spark):
    df = odd_docs(spark).withColumn("num", F.lit(3)).withColumn("__size", F.lit(4)).withColumn(
        "m", F.create_map(F.lit("k"), F.lit(1)))
    want = collections.Counter()
    for r in m.repetitions(df).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    out = m.mix(df)
    assert out.columns == df.columns
    got = collections.Counter((r["doc_id"], r["source"], _size(r["text"])) for r in out.collect())
    assert got == +want
    row = out.filter("doc_id = 9").first()
    assert row is None or (row["num"], row["m"], row["score"]) == (3, {"k": 1}, "mine-score")


def test_a_row_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(m, "CHUNK", 700)
    df = (spark.range(6000).selectExpr("1L as doc_id", "'a b c' as text", "'hot' as source")
          .unionByName(spark.range(9000).selectExpr("id + 10 as doc_id", "'a b' as text", "concat('s', id % 7) as source")))
    got = m.repetitions(df).filter("doc_id = 1")
    r = got.agg(F.count("*"), F.countDistinct("occurrence"), F.sum("taken"), F.max("target")).first()
    assert r[0] == r[1] == 6000 and abs(r[2] - r[3]) < 0.05 * r[3]
    assert m.mix(df).filter("doc_id = 1").count() * 3 == r[2]


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(m, "CHUNK", 50)
    monkeypatch.setattr(m, "BROADCAST_SOURCES", 10)
    rows = [(i, "w " * (i % 11 + 1), f"s{i * 7919 % 400:03d}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _close(_run(df), _sorted(_brute(rows)))


def test_plan_is_native(spark):
    plan = m.repetitions(odd_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
