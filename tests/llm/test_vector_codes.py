import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import vector_codes as v

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def _nearest(entries, q):
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, e)) for e in entries] for x in q]
    return [min(range(len(entries)), key=lambda i: (r[i], i)) for r in d], [min(r) for r in d]


@pytest.mark.parametrize("kind", ["spread", "ties", "equal", "clusters", "huge", "few"])
def test_tree_against_all_entries(kind):
    rng = np.random.default_rng(len(kind))
    dim = 6
    entries = {"spread": rng.integers(-200, 200, (256, dim)), "ties": rng.integers(0, 2, (256, dim)),
               "equal": np.zeros((256, dim), np.int64), "few": rng.integers(-9, 9, (5, dim)),
               "clusters": np.repeat(rng.integers(-5000, 5000, (12, dim)), 20, axis=0) + rng.integers(-9, 9, (240, dim)),
               "huge": rng.integers(-v.bound(dim), v.bound(dim), (100, dim))}[kind].astype(np.int64)
    q = np.concatenate([entries[::3] + rng.integers(-3, 4, entries[::3].shape), rng.integers(-2, 3, (60, dim)), entries[:20]])
    q = np.clip(q, -v.bound(dim), v.bound(dim)).astype(np.int64)
    who, best = v.nearest(v.Gnat(entries), q)
    assert (who.tolist(), best.tolist()) == _nearest(entries, q)


def test_subtrees_are_dropped():
    rng = np.random.default_rng(1)
    centres = rng.integers(-50_000, 50_000, (16, 8))
    entries = np.repeat(centres, 16, axis=0) + rng.integers(-50, 50, (256, 8))
    q = np.repeat(centres, 10, axis=0) + rng.integers(-50, 50, (160, 8))
    best, who = np.full(160, 1 << 62), np.full(160, 1 << 62)
    assert v.Gnat(entries).search(q, best, who) < 0.25 * len(q) * len(entries)


def _kept(rows):
    good = [(i, e, lab) for i, e, lab in rows
            if e is not None and all(c is not None and math.isfinite(c) for c in e) and len(e) % v.PARTS == 0]
    sizes = collections.Counter(len(e) for _, e, _ in good)
    dim = max(sizes, key=lambda n: (sizes[n], n), default=None)
    return [(i, [math.floor(v.SCALE * float(np.float32(c))) for c in e], lab) for i, e, lab in good if len(e) == dim], dim


def _brute(rows):
    kept, dim = _kept(rows)
    w = dim // v.PARTS
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:v.ENTRIES]
    books = [[r[1][p * w:p * w + w] for r in first] for p in range(v.PARTS)]
    for turn in range(v.ROUNDS + 1):
        found = [_nearest(books[p], [r[1][p * w:p * w + w] for r in kept]) for p in range(v.PARTS)]
        if turn < v.ROUNDS:
            for p in range(v.PARTS):
                for e in range(len(books[p])):
                    mine = [r[1][p * w:p * w + w] for r, who in zip(kept, found[p][0]) if who == e]
                    if mine:
                        books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    code = ["".join(f"{found[p][0][k]:02x}" for p in range(v.PARTS)) for k in range(len(kept))]
    error = [sum(found[p][1][k] for p in range(v.PARTS)) for k in range(len(kept))]
    per = collections.Counter()
    for r, e in zip(kept, error):
        per[r[2]] += e
    return sorted(((r[0], r[2], c, e, per[r[2]], sha) for r, c, e in zip(kept, code, error)), key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(c) for c in rng.normal(0, 0.2, 8)], int(i % 3)) for i in rng.permutation(300)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], None), (None, rows[3][1], None), (900, None, 1), (901, [], 1),
             (902, [0.1] * 7 + [None], 1), (903, [0.1] * 7 + [NAN], 1), (904, [INF] * 8, 1), (905, [0.5] * 4, 2),
             (906, [-0.0] * 8, 2), (907, [3e38] * 4 + [0.0] * 4, 2)]
    rows[-1] = (907, [500.0] * 4 + [-500.0] * 4, 2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for c in ("code", "error", "part", "n", "s", "x", "label_error"):
        df = df.withColumn(c, F.lit("mine"))
    got = v.compress(df).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute(rows)


def test_components_beyond_the_bound(spark):
    rows = [(i, [3e38, -3e38, 0.0, 1.0], 0) for i in range(3)] + [(5, [0.0, 0.0, 0.0, 0.0], 0)]
    got = {r["vec_id"]: (r["code"], r["error"]) for r in v.compress(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == got[2] == ("00000000", 0) and got[5] == ("03030003", 0)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 2), (2, [], None)], [(1, [1.0], 1)]])
def test_nothing_to_code(spark, rows):
    got = v.compress(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert [(r["code"], r["error"]) for r in got.collect()] == [("00000000", 0)] * sum(r[1] == [] for r in rows)
