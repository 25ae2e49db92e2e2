import hashlib
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from odd import DOCS, no_docs, odd_docs  # noqa: E402

from trafficlens.llm import decontaminate as d  # noqa: E402
from trafficlens.llm.common import table  # noqa: E402
from trafficlens.llm.fm_index import FMIndex, Wavelet, suffix_array  # noqa: E402

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.mark.parametrize("n,sigma", [(1, 1), (2, 1), (70, 2), (400, 3), (3000, 60), (500, 1)])
def test_fm_index_against_brute_force(n, sigma):
    rng = np.random.default_rng(n)
    x = rng.integers(0, sigma, n)
    text = x.tolist()
    assert suffix_array(x).tolist() == sorted(range(n), key=lambda i: text[i:])
    w = Wavelet(x, int(sigma).bit_length())
    at = rng.integers(0, n, 30)
    assert w.access_rank(at)[0].tolist() == x[at].tolist()
    assert w.rank(x[at], at).tolist() == [text[:i].count(text[i]) for i in at]
    index = FMIndex(x, sigma)
    for m in (1, 2, 5):
        phrases = rng.integers(0, sigma, (25, m))
        for p, lo, hi in zip(phrases.tolist(), *index.ranges(phrases)):
            want = [i for i in range(n - m + 1) if text[i:i + m] == p]
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def brute(docs, items, window=10):
    wins = {}
    for r in items:
        w = words(r["text"])
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i:i + window]), set()).add(r["item_id"])
    sizes = {len(k) for k in wins}
    out = []
    for r in docs:
        w = words(r["text"])
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                k = tuple(w[i:i + m])
                if k in wins:
                    hit.update(range(i, i + m))
                    found |= wins[k]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((r["doc_id"], len(w), len(hit), hashlib.sha256(names.encode()).hexdigest()))
    return sorted(out, key=repr)


def as_rows(got):
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]),
                    hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest())
                   for r in got.collect()), key=repr)


def test_contamination_against_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").limit(300)
    items = table(spark, SF, "benchmark")
    item = items.orderBy("item_id").first()["text"]
    planted = spark.createDataFrame([
        (90_001, "x " * 2000 + item + " y z"), (90_002, item.upper() + " " + item), (90_003, None),
        (90_004, " ".join(words(item)[:9])), (90_005, " ".join(words(item)[:10])), (None, item),
        (90_006, "short  ITEM, here"), (90_007, "it is an item here short item"), (90_008, "solo solo, no")],
        "doc_id long, text string")
    docs = docs.unionByName(planted)
    items = items.unionByName(spark.createDataFrame(
        [(901, "Short item!"), (902, "solo"), (903, None), (904, "..."), (None, "an item"), (905, "short item")],
        "item_id long, text string"))
    want = brute(docs.collect(), items.collect())
    assert as_rows(d.find_contamination(docs, items, keep=["doc_id"])) == want
    # small shards cut long texts, and blocks of the benchmark add up
    assert as_rows(d.find_contamination(docs, items, keep=["doc_id"], shard_symbols=50)) == want
    assert as_rows(d.find_contamination(docs, items, keep=["doc_id"], block_bytes=3000)) == want


def test_query_counts(spark):
    rows = {r["doc_id"]: r for r in d.op9_decontaminate(spark, SF).collect()}
    want = brute(table(spark, SF, "documents").collect(), table(spark, SF, "benchmark").collect())
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"]) for r in rows.values()), key=repr) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) == (r["n_items"] > 0) for r in rows.values())


def test_removal():
    text = "One two, three FOUR é five; six".encode()
    assert d.cut_words(text, [(1, 3), (5, 6)]).decode() == "One  FOUR é ; six"
    assert d.cut_words(text, [(0, 7)]) == b"" and d.cut_words(text, []) == text


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "nine ten one two three four five six seven eight"), (2, None)],
                                  "item_id long, text string")
    got = d.find_contamination(odd_docs(spark), items).collect()
    assert len(got) == len(DOCS) and all(r["text2"] == "mine-text2" for r in got)
    long = next(r for r in got if r["doc_id"] == 6)
    assert [tuple(s) for s in long["spans"]] == [(8, 299_998)] and long["items"] == [1]
    assert all(not r["spans"] for r in got if r["doc_id"] != 6)
    assert d.find_contamination(no_docs(spark), items).count() == 0
    assert all(not r["spans"] for r in d.find_contamination(odd_docs(spark), items.limit(0)).collect())


def test_text_ids_repeated_items_and_many_blocks(spark):
    """Ids that are texts stay in the list; equal texts under many ids spread over blocks; repeated rows count once."""
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = [(f"q-{i}", text) for i in range(40)] + [("one", "mu nu xi")] * 500 + [(None, "omicron pi")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, f"so {text} end"), (2, "mu nu xi omicron pi"), (3, "nothing here")], "doc_id long, text string")
    want = None
    for block_bytes in (1 << 20, 100):
        got = {r["doc_id"]: (r["items"], [(s["start"], s["end"]) for s in r["spans"]])
               for r in d.find_contamination(docs, bench, block_bytes=block_bytes).collect()}
        want = want or got
        assert got == want
    assert want == {1: (sorted(f"q-{i}" for i in range(40)), [(1, 12)]), 2: (["one"], [(0, 5)]), 3: ([], [])}
