import random
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from odd import DOCS, no_docs, odd_docs  # noqa: E402

from trafficlens.llm import common  # noqa: E402
from trafficlens.llm import minhash as m  # noqa: E402
from trafficlens.llm.common import WordHashes, table  # noqa: E402
from trafficlens.llm.components import components  # noqa: E402


def shingles(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def brute(rows, size, percent=80):
    """Component of each id by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, s in sets.items():
        near = {}
        for x in s:
            for j in where.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            where[x].append(i)
        for j, common in near.items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_tables_against_brute_force(spark, size):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = m.near_duplicates(docs, size)
    assert result(got) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], size)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def hard_rows():
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows, doc = [], 0
    for step in range(40):  # each is near the next, the ends are far apart
        rows.append((doc, " ".join(base)))
        base = base.copy()
        base[step] = f"new{step}"
        doc += 1
    shared = [f"s{i}" for i in range(60)]
    for _ in range(250):  # one large group of near copies
        w = shared.copy()
        w[rng.randrange(60)] = f"r{rng.random()}"
        rows.append((doc, " ".join(w)))
        doc += 1
    for _ in range(150):  # one passage in many documents that are no copies
        rows.append((doc, " ".join(shared[:40] + [f"o{rng.random()}" for _ in range(rng.randint(20, 60))])))
        doc += 1
    for _ in range(120):  # copies at about the threshold of each other
        w = shared.copy()
        for k in rng.sample(range(60), 4):
            w[k] = f"e{rng.random()}"
        rows.append((doc, " ".join(w)))
        doc += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,small", [(m.BLOCK, common.SMALL_ROWS), (16, 0)])
def test_chains_and_large_groups(spark, monkeypatch, block, small):
    """Also with tiny blocks, so that clusters and buckets are cut, and with the join for large inputs."""
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(common, "SMALL_ROWS", small)
    rows = hard_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(m.near_duplicates(df, 2)) == brute(rows, 2)


def test_one_id_with_two_texts_and_repeated_rows(spark):
    a, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "acd")
    near = lambda t: t.replace(t.split()[-1], "other")
    rows = [(1, a), (5, near(a)), (5, c), (9, near(c)), (5, d), (11, near(d))]
    rows += [(20, "b0 " + a.replace("a", "b"))] * 40 + [(21, near("b0 " + a.replace("a", "b")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter(map(tuple, m.drop_near_duplicates(spark, df, "").collect()))
    # every group has one document, one of repeated rows stays: 5 goes as a copy of 1, and stays for its own two groups
    assert left == Counter({(1, a): 1, (5, c): 1, (5, d): 1, rows[6]: 1})
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in m.near_duplicates(df, 5).collect()]
    assert Counter(got) == Counter({(1, 1, True): 1, (5, 1, False): 1, (5, 5, True): 2, (9, 5, False): 1,
                                    (11, 5, False): 1, (20, 20, True): 40, (21, 20, False): 1})


def test_hot_bucket_stays_linear(spark):
    """20,000 members of one bucket, 3 outside its main cluster: each meets all others, in about 20,000 rows."""
    far = {5, 777, 19_999}
    members = spark.range(20_000).selectExpr(
        "7L as key", "id as doc_id", f"if(id in ({','.join(map(str, far))}), id, 0L) as component").checkpoint()
    keys = m.bucket_keys(members)
    assert [(r["n"], r["main"], r["sides"], r["blocks"]) for r in keys.collect()] == [(20_000, 0, 1, 20)]
    rows = m.bucket_rows(members, keys, 20_000).collect()
    assert len(rows) == 20_000 + 3 * 20
    left = {(r["i"], r["j"], r["doc_id"]) for r in rows if r["far"]}
    right = {(r["i"], r["j"]) for r in rows if not r["far"]}
    assert {x for *_, x in left} == far and right == {(i, j) for i, j, _ in left}


def test_estimate():
    rng = np.random.default_rng(1)
    for target in (0.3, 0.8, 0.95):
        est = []
        for _ in range(60):
            n = 400
            common = int(round(2 * n * target / (1 + target)))
            x = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            a, b = x[:n], x[n - common:2 * n - common]
            sig = m.pack(np.stack([m.minima(a), m.minima(b)]))
            est.append(m.similarity(m.matches(sig[:1], sig[1:]))[0])
        assert abs(np.mean(est) - target) < 0.03


def test_sets():
    h = WordHashes(limit=3)
    assert len(m.shingle_set(b"a b a b a", h, 2)) == 2
    assert len(m.shingle_set(b"A", h, 2)) == 1 and len(m.shingle_set(b" \n", h, 2)) == 0
    assert (m.shingle_set(b"x y z", h, 2) == m.shingle_set(b"X  Y\nZ", h, 2)).all()
    assert not set(m.shingle_set(b"a b", h, 5)) & set(m.shingle_set(b"a b c", h, 5))


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


def test_odd_rows(spark):
    rows = m.near_duplicates(odd_docs(spark)).collect()
    assert len(rows) == len(DOCS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["component_id"], r["kept"]))
    assert by[1] == [(1, True)] * 2 and by[2] == [(1, False)]
    assert by[7] == [(7, True)] and by[8] == [(7, False)]
    assert by[3] == [(3, True)] and by[4] == [(4, True)] and by[5] == [(5, True)]
    assert by[None] == [(None, True)] * 2
    assert m.near_duplicates(no_docs(spark)).count() == 0
    stage = m.drop_near_duplicates(spark, odd_docs(spark), "")
    assert stage.columns == odd_docs(spark).columns
    assert sorted(r["doc_id"] for r in stage.collect() if r["doc_id"]) == [1, 3, 4, 5, 6, 7, 9]
