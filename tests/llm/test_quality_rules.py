import sys

import numpy as np

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from odd import DOCS, no_docs, odd_docs  # noqa: E402

from trafficlens.llm import quality_rules as q  # noqa: E402
from trafficlens.llm.common import table  # noqa: E402

SPACES = "\t\n\v\f\r "


def brute(text):
    text = text or ""
    words = "".join(" " if c in SPACES else c for c in text).split(" ")
    words = [w for w in words if w]
    lines = text.split("\n")
    dups, seen = 0, set()
    for x in lines:
        if x.strip(SPACES):
            dups += x in seen
            seen.add(x)
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i:i + 8]), []).append(i)
    inside = {p + k for ps in where.values() if len(ps) > 1 for p in ps for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(inside),
            len(words) < 20 or 100 * len(inside) > 30 * len(words))


def test_counts_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    extra = [(10_001, "a b c d e f g h " * 3 + "\x85  x   y"), (10_002, "x " * 500), (10_003, "q\n\nq\n \nq x\nq\r"),
             (10_004, None), (10_005, "")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in q.quality_rules(docs, keep=["doc_id"]).collect()}
    for r in docs.collect():
        g = got[r["doc_id"]]
        assert tuple(g[c] for c in (*q.FEATURES, "base_failed")) == brute(r["text"]), r["doc_id"]
        assert not (g["base_failed"] and g["kept"])


def test_em_finds_rule_accuracies():
    rng = np.random.default_rng(3)
    n, rules = 60_000, len(q.RULES)
    good = rng.random(n) < 0.8
    right_good, right_bad = rng.uniform(0.75, 0.97, rules), rng.uniform(0.6, 0.95, rules)
    right = rng.random((n, rules)) < np.where(good[:, None], right_good, right_bad)
    votes = np.where(right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random((n, rules)) < 0.2] = 0
    pattern = ((votes + 1) * 3 ** np.arange(rules - 1, -1, -1)).sum(1)
    keys, counts = np.unique(pattern, return_counts=True)
    assert (q._pattern_votes(pattern) == votes).all()
    model = q.estimate(keys, counts)
    assert abs(model["good"] - 0.8) < 0.02
    assert np.abs(model["on_good"] - right_good).max() < 0.03 and np.abs(model["on_bad"] - right_bad).max() < 0.05
    assert ((q.posterior(votes, model) > 0.5) == good).mean() > 0.97


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = q.op6_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    free = got[~got.base_failed]
    assert free[free.quality == 1].kept.mean() > 0.98
    assert free[free.quality == 0].kept.mean() < 0.2


def test_odd_rows(spark):
    got = q.quality_rules(odd_docs(spark)).collect()
    assert len(got) == len(DOCS) and all(r["text2"] == "mine-text2" for r in got)
    assert all(not r["kept"] and r["n_words"] == 0 for r in got if not (r["text"] or "").strip())
    assert q.quality_rules(no_docs(spark)).count() == 0
    stage = q.filter_quality(spark, odd_docs(spark), "")
    assert stage.columns == odd_docs(spark).columns
    assert q.filter_quality(spark, no_docs(spark), "").count() == 0


def test_expression_equals_posterior(spark):
    rng = np.random.default_rng(8)
    pattern = rng.integers(0, 3 ** len(q.RULES), 500)
    model = q.estimate(pattern, rng.integers(1, 50, 500))
    df = spark.createDataFrame([(int(p),) for p in pattern], "pattern long").select("pattern", q.posterior_column(model).alias("p"))
    got = {r["pattern"]: r["p"] for r in df.collect()}
    want = q.posterior(q._pattern_votes(pattern), model)
    assert np.allclose([got[p] for p in pattern.tolist()], want, atol=1e-12)
