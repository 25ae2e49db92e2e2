"""Vector code compression: product codes by Lloyd rounds, nearest entries found by GNAT trees over the codebooks.

Each vector is cut into ``PARTS`` equal parts; each part position has a
codebook of at most ``ENTRIES`` whole-number entries, broadcast to the tasks
(entries x dimension numbers, whatever the table's size).  A task builds a
tree per codebook once and searches it for batches of rows.

The tree (geometric near-neighbour access tree) picks split points, hands
every other entry to its nearest split point, and keeps for each split point
and each child the least and greatest distance between the point and the
child's entries.  A query measures its distance to the split points; where
that leaves no way for a child's entry to be as near as the best one found,
the whole child is dropped.  Distances of the ranges are roots, so they are
rounded away from the decision and only a strictly greater bound drops a
child; what remains is compared by exact whole-number squared distances, ties
to the lower index.

A round sums each entry's parts exactly: tasks emit one row per used entry,
and only the sums of all tasks reach the driver.

Defined cases: vectors that are null, hold null or non-finite components, or
have another length than the table's (see vectors.py; only lengths that are a
multiple of ``PARTS`` count) are dropped.  With fewer rows than ``ENTRIES``
the codebook has as many entries as rows.  Of rows with equal vec_id the one
with the smaller components comes first; a null vec_id comes last.  Components
beyond what keeps squared distances in a long are held at that bound (about
2^28 for 64 dimensions).  Repeated rows stay, extra columns too where
``encode`` is asked for them; no rows: no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.llm.common import ROW, attach, prepare, table
from trafficlens.llm.registry import register
from trafficlens.llm.vectors import dimension, matrix, regrouped, scaled
from trafficlens.session import stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024

#: Split points per node, and entries up to which a node is searched one by one.
SPLITS = 16
LEAF = 16
#: Relative error allowed for a root of a whole number and a difference of two.
SLACK = 1e-12


def bound(dim: int) -> int:
    """The largest component for which squared distances over ``dim`` components stay below 2^62."""
    return math.isqrt((1 << 62) // max(1, dim)) // 2


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of a by rows of b)."""
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if top * top * max(1, a.shape[1]) < 1 << 50:  # all sums are whole numbers that doubles hold
        x, y = a.astype(np.float64), b.astype(np.float64)
        d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
        return d.astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    for j in range(len(b)):
        out[:, j] = ((a - b[j]) ** 2).sum(1)
    return out


class Gnat:
    """A tree over the rows of ``entries``; ``ids`` are their indexes in the codebook."""

    def __init__(self, entries: np.ndarray, ids: np.ndarray | None = None):
        ids = np.arange(len(entries)) if ids is None else ids
        self.points, self.ids, self.children = entries, ids, []
        if len(entries) <= LEAF:
            return
        # split points: each the entry farthest from those before it
        chosen, far = [0], squared(entries, entries[:1])[:, 0]
        while len(chosen) < SPLITS and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, squared(entries, entries[chosen[-1:]])[:, 0])
        rest = np.setdiff1d(np.arange(len(entries)), chosen)
        if len(chosen) == 1:  # all equal: the lowest index wins every tie
            first = int(ids.argmin())
            self.points, self.ids = entries[first:first + 1], ids[first:first + 1]
            return
        to = squared(entries[rest], entries[chosen])
        self.points, self.ids = entries[chosen], ids[chosen]
        self.near, self.far = np.empty((len(chosen), 0)), np.empty((len(chosen), 0))
        low, high, self.at = [], [], []
        for j in range(len(chosen)):
            mine = to.argmin(1) == j
            if mine.any():
                roots = np.sqrt(to[mine].astype(np.float64))
                low.append(roots.min(0) * (1 - SLACK))
                high.append(roots.max(0) * (1 + SLACK))
                self.at.append(j)
                self.children.append(Gnat(entries[rest[mine]], ids[rest[mine]]))
        if low:
            self.near, self.far = np.stack(low, 1), np.stack(high, 1)

    def search(self, q: np.ndarray, best: np.ndarray, who: np.ndarray) -> int:
        """Lowers ``best`` (squared distance) and ``who`` (index) per row of q; how many distances were measured."""
        d = squared(q, self.points)
        for j, i in enumerate(self.ids.tolist()):
            better = (d[:, j] < best) | ((d[:, j] == best) & (i < who))
            best[better], who[better] = d[better, j], i
        measured = d.size
        if not self.children:
            return measured
        roots = np.sqrt(d.astype(np.float64))
        under, over = roots * (1 - SLACK), roots * (1 + SLACK)
        # no entry of child c can be nearer than least[:, c]
        least = np.full((len(q), len(self.children)), -np.inf)
        for p in range(len(self.ids)):
            np.maximum(least, under[:, p, None] - self.far[p][None, :], out=least)
            np.maximum(least, self.near[p][None, :] - over[:, p, None], out=least)
        # a difference of two roots is wrong by the larger one's error at most
        least -= SLACK * (over.max(1, keepdims=True) + self.far.max())
        order = np.argsort(d[:, self.at], axis=1, kind="stable")  # the nearest child first
        for turn in range(len(self.children)):
            reach = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
            for c, child in enumerate(self.children):
                rows = np.flatnonzero((order[:, turn] == c) & ~(least[:, c] > reach))
                if len(rows):
                    b, w = best[rows], who[rows]
                    measured += child.search(q[rows], b, w)
                    best[rows], who[rows] = b, w
        return measured


def nearest(tree: Gnat, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, exact squared distance) of the nearest entry of each row of q, ties to the lower index."""
    best, who = np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), np.iinfo(np.int64).max)
    tree.search(q, best, who)
    return who, best


class Codebooks:
    """``entries``: per part position, a matrix of whole numbers (one row per entry)."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self._trees: list[Gnat] | None = None

    def __getstate__(self):
        return self.entries

    def __setstate__(self, entries):
        self.__init__(entries)

    @property
    def trees(self) -> list[Gnat]:
        if self._trees is None:
            self._trees = [Gnat(e) for e in self.entries]
        return self._trees

    @property
    def dim(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def assign(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per part position: the parts, their entries' indexes and squared distances."""
        for tree, part in zip(self.trees, np.split(x, len(self.entries), axis=1)):
            yield (part, *nearest(tree, part))

    def sha256(self) -> str:
        said = (str(v) for book in self.entries for v in book.reshape(-1).tolist())
        return hashlib.sha256(",".join(said).encode()).hexdigest()


def _first(df: DataFrame, dim: int, n: int) -> np.ndarray:
    """The vectors of the n smallest vec_ids, as whole numbers."""
    most = bound(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regrouped(batches):
            ok, found = matrix(b.column(1), dim)
            x = scaled(found, SCALE, most)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim),
                                            pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), flat], ["vec_id", "x"])

    kind = df.schema["vec_id"].dataType.simpleString()
    rows = (df.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, x array<bigint>")
            .orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(n).collect())
    return np.array([r["x"] for r in rows], np.int64).reshape(len(rows), dim)


def _round(df: DataFrame, books: Codebooks) -> Codebooks:
    """Assigns every part, and replaces each used entry by the floor of its parts' mean."""
    shared = df.sparkSession.sparkContext.broadcast(books)
    dim, most = books.dim, bound(books.dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        sums = [np.zeros_like(e) for e in books.entries]
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        for b in regrouped(batches):
            x = scaled(matrix(b.column(0), dim)[1], SCALE, most)
            for p, (part, who, _) in enumerate(books.assign(x)):
                np.add.at(sums[p], who, part)
                counts[p] += np.bincount(who, minlength=len(counts[p]))
        rows = [(p, i, int(n[i]), sums[p][i].tolist()) for p, n in enumerate(counts) for i in np.flatnonzero(n).tolist()]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "n", "s"), r)) for r in rows], schema=pa.schema(
            [("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))

    width = dim // len(books.entries)
    sums = [F.sum(F.col("s")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    got = (df.select("embedding").mapInArrow(run, "part int, entry int, n long, s array<bigint>")
           .groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect())
    entries = [e.copy() for e in books.entries]
    for r in got:  # at most parts x entries rows
        entries[r["part"]][r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return Codebooks(entries)


def fit(df: DataFrame, n_entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> Codebooks | None:
    """Codebooks of the rows (vec_id, embedding); None without any vector."""
    dim = dimension(df, "embedding", parts)
    if dim is None:
        return None
    books = Codebooks([e.copy() for e in np.split(_first(df, dim, n_entries), parts, axis=1)])
    for _ in range(rounds):
        books = _round(df, books)
    return books


def encode(df: DataFrame, books: Codebooks, keep: list[str]) -> DataFrame:
    """``code`` (two hex digits per part) and ``error`` of every vector, with the columns ``keep``."""
    shared = df.sparkSession.sparkContext.broadcast(books)
    dim, most = books.dim, bound(books.dim)
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias(ROW), F.col("embedding").alias("__vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for b in regrouped(batches):
            ok, found = matrix(b.column(1), dim)
            error, codes = np.zeros(len(found), np.int64), np.zeros((len(found), len(books.entries)), np.uint8)
            for p, (_, who, d) in enumerate(books.assign(scaled(found, SCALE, most))):
                error += d
                codes[:, p] = who
            code = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(code, pa.string()),
                                              pa.array(error)], [ROW, "__code", "__error"])

    got = src.mapInArrow(run, T.StructType([src.schema[ROW], T.StructField("__code", T.StringType()),
                                            T.StructField("__error", T.LongType())]))
    return got.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in keep if c not in ("code", "error")],
                      F.col("__code").alias("code"), F.col("__error").alias("error"))


def compress(df: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every kept row."""
    books = fit(df)
    if books is None:
        books, df = Codebooks([np.zeros((0, 0), np.int64)] * PARTS), df.limit(0)
    label = F.when(F.col("label").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("label").cast("string")))
    rows, _ = stored(encode(df, books, ["vec_id", "label"]).withColumn("__label", label), "vector-codes")
    per, _ = stored(rows.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n")),
                    "vector-labels")
    got = attach(rows, per, "__label", "__n", rows.count(), "inner")
    return got.drop("__label").withColumn("codebooks_sha256", F.lit(books.sha256()))


def _oracle() -> str:
    """The rounds as a chain of CTEs: nearest by (squared distance, index), then floored means."""
    near = ("SELECT p.r, p.part, arg_min(b.e, {{'d': {d}, 'e': b.e}}) AS e, min({d})::BIGINT AS d "
            "FROM p JOIN b{k} b USING (part) GROUP BY p.r, p.part").format
    dist = "(p.nn + b.nn - 2 * list_inner_product(p.x, b.x))"
    ctes = [f"""
v AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, x, list_inner_product(x, x) AS nn FROM (SELECT r, part, list_transform(
        embedding[(part * len(embedding) // {PARTS} + 1):((part + 1) * len(embedding) // {PARTS})],
        lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM v, range({PARTS}) t(part))),
b0 AS (SELECT part, r - 1 AS e, x, nn FROM p WHERE r <= {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        ctes.append(f"a{k} AS MATERIALIZED ({near(d=dist, k=k)})")
        if k < ROUNDS:
            ctes.append(f"""
m{k} AS (SELECT part, e, list(m ORDER BY i) AS x FROM (
      SELECT part, e, i, floor(sum(x[i + 1]) / count(*)) AS m FROM a{k} JOIN p USING (r, part),
             range((SELECT max(len(x)) FROM p)) t(i) GROUP BY part, e, i) GROUP BY part, e),
b{k + 1} AS MATERIALIZED (SELECT part, e, x, list_inner_product(x, x) AS nn FROM (
      SELECT part, e, coalesce(m{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN m{k} USING (part, e)))""")
    return f"""WITH {','.join(ctes)},
h AS (SELECT sha256(string_agg(list_aggregate(list_transform(x, lambda y: (y::BIGINT)::VARCHAR), 'string_agg', ','), ','
        ORDER BY part, e)) AS codebooks_sha256 FROM b{ROUNDS}),
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM c JOIN v USING (r), h"""


@register("op12_vector_codes", _oracle())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings, their errors, and the codebooks' digest."""
    prepare(spark)
    return compress(table(spark, sf_dir, "embeddings"))
