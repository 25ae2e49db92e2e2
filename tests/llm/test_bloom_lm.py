import math
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from odd import DOCS, no_docs, odd_docs  # noqa: E402

from trafficlens.llm import bloom_lm as b  # noqa: E402
from trafficlens.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.01"


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def exact(docs, train):
    """Base and model scores with exact bigram counts, quantised as the filter does."""
    words, pairs = Counter(), Counter()
    for t in train:
        w = tokens(t)
        words.update(w)
        pairs.update(zip([b"\n", *w], w))
    n, v = sum(words.values()), len(words)

    def least(c):
        return 2 ** (c.bit_length() - 1) if c else 0

    out = {}
    for i, t in docs:
        w = tokens(t)
        base = score = 0
        for prev, x in zip([b"\n", *w], w):
            p = (words[x] + 1) / (n + v + 1)
            past = words[prev] if prev != b"\n" else max(1, words[prev])
            ratio = min(1, least(pairs[prev, x]) / past) if past else 0
            base += math.log10(p)
            score += math.log10(0.4 * ratio + 0.6 * p)
        out[i] = (len(w), sum(words[x] > 0 for x in w), base, score)
    return out, n


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    return rows, exact(rows, train)


def test_query_against_exact_counts(spark, tables):
    rows, (want, n) = tables
    got = {r["doc_id"]: r for r in b.op8_bloom_lm(spark, SF).collect()}
    assert len(got) == len(rows)
    raised = 0
    for i, _ in rows:
        r, w = got[i], want[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (w[0], w[1], n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r["base_score"], w[2], rel_tol=1e-9)
        # false positives can only raise a probability, and rarely do
        assert r["score"] >= w[3] - 1e-6
        raised += (r["score"] - w[3]) / -w[3]
    assert raised / len(rows) < 0.01
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_words_beyond_the_table_are_counted(spark, tables):
    rows, (want, _) = tables
    docs = table(spark, SF, "documents").select("doc_id", "text")
    got, model = b.language_model_scores(docs, docs.filter(f"NOT ({b.HELD_OUT})"), ["doc_id"], table_words=500)
    assert not model.whole and model.n_tokens > 0 and len(model.table.words) <= 500
    for r in got.collect():
        w = want[r["doc_id"]]
        assert r["n_known"] == w[1] and math.isclose(r["base_score"], w[2], rel_tol=1e-9)


def test_more_segments_for_more_text(spark, tables, monkeypatch):
    rows, (want, _) = tables
    assert b.segments_for(1) == 1024 and b.segments_for(200 << 30) == 4096
    monkeypatch.setattr(b, "BYTES_PER_SEGMENT", 500)
    docs = table(spark, SF, "documents").select("doc_id", "text")
    got, model = b.language_model_scores(docs, docs.filter(f"NOT ({b.HELD_OUT})"), ["doc_id"])
    assert len(model.filter.bits) == 8192
    assert all(r["score"] >= want[r["doc_id"]][3] - 1e-6 for r in got.collect())


def true_scores(docs, train):
    """Scores with the true bigram counts, singles too, quantised as the filter does."""
    words, pairs = Counter(), Counter()
    for t in train:
        w = tokens(t)
        words.update(w)
        pairs.update(zip([b"\n", *w], w))
    n, v = sum(words.values()), len(words)
    out = {}
    for i, t in docs:
        w = tokens(t)
        score = 0
        for prev, x in zip([b"\n", *w], w):
            c, past = pairs[prev, x], max(words[prev], prev == b"\n")
            least = 2 ** (c.bit_length() - 1) if c else 0
            score += math.log10(0.4 * (min(1, least / past) if past else 0) + 0.6 * (words[x] + 1) / (n + v + 1))
        out[i] = score
    return out


def test_bigrams_seen_once_count(spark, tables):
    rows, _ = tables
    want = true_scores(rows, [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    got = {r["doc_id"]: r["score"] for r in b.op8_bloom_lm(spark, SF).collect()}
    assert all(got[i] >= want[i] - 1e-6 for i in want)  # none is missing
    assert sum((got[i] - want[i]) / -want[i] for i in want) / len(want) < 0.01
    once = np.arange(2_000, dtype=np.uint64)
    n = b.LogFrequencyFilter.of([b.build_segment(b.fingerprint(once)), *[b""] * 1023]).levels(once)
    assert (n >= 1).all()


def test_filter_above_one_block_keeps_its_error_rate(spark, tables, monkeypatch):
    rows, _ = tables
    want = true_scores(rows, [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    docs = table(spark, SF, "documents").select("doc_id", "text")
    train = docs.filter(f"NOT ({b.HELD_OUT})")
    whole = {r["doc_id"]: r for r in b.language_model_scores(docs, train, ["doc_id"])[0].collect()}
    monkeypatch.setattr(b, "FILTER_BITS", 1 << 17)
    got, model = b.language_model_scores(docs, train, ["doc_id"])
    got = {r["doc_id"]: r for r in got.collect()}
    assert len(model.blocks.parts) > 2 and got == whole
    assert sum((got[i]["score"] - want[i]) / -want[i] for i, _ in rows) / len(rows) < 0.01
    # the same with words beyond the table
    for r in b.language_model_scores(docs, train, ["doc_id"], table_words=500)[0].collect():
        assert math.isclose(r["score"], whole[r["doc_id"]]["score"], rel_tol=1e-9)


def test_error_rate_does_not_depend_on_the_entries():
    rng = np.random.default_rng(5)
    for n in (1_000, 100_000):
        low = rng.choice(1 << 32, 2 * n, replace=False).astype(np.uint32)
        bits = b.build_segment(np.repeat(low[:n], 2))
        f = b.LogFrequencyFilter(np.frombuffer(bits, np.uint8), np.array([8 * len(bits)]))
        at = b.places(low[n:], np.ones(n, np.int64), 8 * len(bits))
        wrong = ((f.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1).mean()
        assert wrong < 0.03


def test_probabilities_after_a_word_add_up_to_at_most_one():
    # texts of one word, so each follows the end token
    for times in ([2] * 40, [3] * 40, [1, 2, 3, 7, 15, 31] * 5):
        count = np.array([*times, sum(times)])
        word = np.sort(np.concatenate([np.arange(1, len(times) + 1, dtype=np.uint64), [b.END_HASH]]))
        assert word[-1] == b.END_HASH
        unknown = np.uint64(len(times) + 5)
        h = np.concatenate([word, [unknown]])
        found = b.level(np.concatenate([times, [0, 0]]))  # neither the end nor the unknown word was seen first
        sizes = np.ones(len(h), np.int64)
        parts = (b.WordTable(word, count), int(count.sum()), len(count))
        total = (10 ** b._sums(parts, h, sizes, found)[3]).sum()
        assert 1 - b.WEIGHT / 2 < total <= 1 + 1e-12


def test_full_segment_ends():
    pair = np.arange(100, dtype=np.uint64)
    full = b.LogFrequencyFilter(np.full(8, 255, np.uint8), np.array([64]), np.array([3]), 0, 1 << 10)
    assert (full.levels(pair) == 3).all()


def test_filter_levels():
    rng = np.random.default_rng(4)
    pair = rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2)
    count = np.minimum(rng.geometric(0.3, len(pair)), 40)
    every = np.repeat(pair, count)
    n = b.LEAST_SEGMENTS
    segments = [b.build_segment(b.fingerprint(every[b.segment_of(every, n) == s])) for s in range(n)]
    got = b.LogFrequencyFilter.of(segments).levels(pair)
    true = b.level(count)
    assert (got >= true).all() and (got > true).mean() < 0.03
    assert b.level(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]
    full = b.build_segment(np.repeat(np.arange(1000, dtype=np.uint32), 2), max_bits=128)
    assert len(full) == 16  # the size stays bounded


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got, _ = b.language_model_scores(docs, docs, docs.columns)
    got = got.collect()
    assert len(got) == len(DOCS) and all(r["text2"] == "mine-text2" for r in got)
    assert all(r["n_tokens"] == 1 for r in got if not (r["text"] or "").strip())
    assert next(r for r in got if r["doc_id"] == 6)["n_tokens"] == 300_001
    assert b.language_model_scores(no_docs(spark), no_docs(spark), ["doc_id"])[0].count() == 0
    nothing = b.language_model_scores(docs, no_docs(spark), ["doc_id"])[0].agg(F.min("base_score"), F.max("n_known"))
    assert tuple(nothing.first()) == (0.0, 0)
