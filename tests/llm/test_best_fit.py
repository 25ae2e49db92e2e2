import random
import sys

import numpy as np

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from odd import no_docs, odd_docs  # noqa: E402

from trafficlens.llm import best_fit as b  # noqa: E402
from trafficlens.llm.common import table  # noqa: E402


def brute(size, source, cluster, capacity):
    """Best fit by looking at every open bin."""
    bins, out = [], []
    for n, s, c in zip(size, source, cluster):
        fit = [(left, k) for k, (left, ss, cc) in enumerate(bins)
               if left >= n and (s is None or s not in ss) and (c is None or c not in cc)]
        if fit:
            left, k = min(fit)
        else:
            bins.append([capacity, set(), set()])
            left, k = capacity, len(bins) - 1
        out.append((k, capacity - left))
        bins[k][0] -= n
        bins[k][1].add(s)
        bins[k][2].add(c)
    return out


def test_shard_against_brute_force():
    rng = random.Random(2)
    for sources, clusters, n in ((3, 5, 60), (200, 90, 900), (1, 1, 30), (70, 2, 700)):
        size = sorted((rng.randint(0, 100) for _ in range(n)), reverse=True)
        source = [rng.choice([None, *range(sources)]) for _ in range(n)]
        cluster = [rng.choice([None, *range(clusters), *range(1000, 3000)]) for _ in range(n)]
        got = b.pack_shard(np.array(size), source, cluster, 100)
        assert list(zip(*(x.tolist() for x in got))) == brute(size, source, cluster, 100)


def test_bins_keep_the_rules(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = b.best_fit_packing(docs, capacity=500, shard_rows=128).toPandas()
    texts = {r["doc_id"]: r for r in docs.collect()}
    for doc, pieces in got.groupby("doc_id"):
        assert pieces.n_tokens.sum() == len(texts[doc]["text"].encode().split())
        assert sorted(pieces.piece) == list(range(len(pieces)))
    assert len(texts) == got.doc_id.nunique()
    for (shard, _), rows in got.groupby(["shard", "bin"]):
        rows = rows.sort_values(["offset", "n_tokens"])
        assert rows.n_tokens.sum() <= 500
        assert list(rows.offset) == [0, *rows.n_tokens.cumsum()[:-1]]
        if shard >= 0:
            assert rows.source.nunique() == len(rows)
            assert len({" ".join(texts[x]["text"].lower().split()) for x in rows.doc_id}) == len(rows)
        else:
            assert len(rows) == 1 and rows.n_tokens.iloc[0] == 500
    packed = got[got.shard >= 0]
    assert packed.n_tokens.sum() / (500 * packed.groupby(["shard", "bin"]).ngroups) > 0.85


def test_repeated_long_rows(spark):
    """Every bin, those of full pieces too, holds at most its capacity; repeated rows spread over the shards."""
    rows = [(1, "w " * 5000, "a")] * 2 + [(None, "v " * 4100, None)] * 3 + [(2, "x " * 7, "a")] * 3000
    got = b.best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_rows=100).toPandas()
    assert len(got) == 2 * 3 + 3 * 3 + 3000
    assert (got.groupby(["shard", "bin"]).n_tokens.sum() <= 2048).all()
    assert (got[got.shard < 0].groupby(["shard", "bin"]).size() == 1).all() and (got.shard < 0).sum() == 2 * 2 + 3 * 2
    assert got[got.shard >= 0].groupby("shard").size().max() < 300


def test_odd_rows(spark):
    got = b.best_fit_packing(odd_docs(spark)).toPandas()
    assert got[got.piece == 0].shape[0] == 12 and got[got.doc_id == 6].n_tokens.sum() == 300_000
    assert got[got.doc_id == 1].bin.nunique() == 2  # copies never share a bin
    assert b.best_fit_packing(no_docs(spark)).count() == 0
