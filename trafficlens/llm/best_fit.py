"""Best-fit packing of documents into training sequences, under conflicts.

A bin holds at most ``capacity`` tokens (words), at most one piece per source
and at most one per duplicate cluster.  Pieces come in decreasing size; open
bins are ordered by what is left in them and carry bitmaps of the sources and
clusters inside.  The search starts at the smallest sufficient residual and
goes on to the next larger one until a compatible bin is found: the tightest
one.  Where none is, a bin is opened.

A document longer than a bin is cut: full pieces fill bins of their own, the
rest is packed like any other.  A duplicate cluster is the documents of equal
lower-cased words.

Packing runs in shards: Spark deals the pieces (ids and sizes, never texts)
by a hash of the row's number over shards of about ``shard_rows`` pieces, so
hot sources, large clusters and rows repeated very often spread evenly and a
task's memory is bounded at any input size.  Bins never cross shards; each shard leaves at most a few bins that a
global search could have filled better.

A null source conflicts with nothing, nor does a null text's cluster; null
and empty texts have no words and take part with size 0 (they lie in any
compatible bin).  Repeated rows are packed as often as they occur and belong
to one cluster.  Ties go to the smaller doc_id, nulls first, then to the
smaller row hash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.common import map_rows, prepare, table, utf8
from trafficlens.llm.registry import register

CAPACITY = 2048
SHARD_ROWS = 4096


class Bins:
    """Open bins of one shard, by residual (ascending; ties: the older bin first)."""

    def __init__(self, sources: int, clusters: int):
        self.n = 0
        self.left = np.empty(256, np.int64)
        self.id = np.empty(256, np.int64)
        self.marks = [np.zeros((256, -(-max(1, k) // 64)), np.uint64) for k in (sources, clusters)]

    def _grow(self) -> None:
        if self.n == len(self.left):
            self.left, self.id = np.resize(self.left, 2 * self.n), np.resize(self.id, 2 * self.n)
            self.marks = [np.resize(m, (2 * self.n, m.shape[1])) for m in self.marks]

    def _take(self, at: int) -> tuple:
        row = (int(self.left[at]), int(self.id[at]), [m[at].copy() for m in self.marks])
        for a in (self.left, self.id, *self.marks):
            a[at:self.n - 1] = a[at + 1:self.n]
        self.n -= 1
        return row

    def _put(self, left: int, bin_id: int, marks: list[np.ndarray]) -> None:
        self._grow()
        at = int(np.searchsorted(self.left[:self.n], left, "left"))
        while at < self.n and self.left[at] == left and self.id[at] < bin_id:
            at += 1
        for a, v in zip((self.left, self.id, *self.marks), (left, bin_id, *marks)):
            a[at + 1:self.n + 1] = a[at:self.n]
            a[at] = v
        self.n += 1

    def place(self, size: int, keys: tuple[int, int], new_id: int, capacity: int) -> tuple[int, int]:
        """(bin, offset) for a piece with its source and cluster numbers (-1: none); ``new_id`` if a bin is opened."""
        start = int(np.searchsorted(self.left[:self.n], size, "left"))
        step = 64
        found = -1
        while start < self.n:  # successors, in growing blocks
            end = min(self.n, start + step)
            free = np.ones(end - start, bool)
            for m, k in zip(self.marks, keys):
                if k >= 0:
                    free &= (m[start:end, k >> 6] >> np.uint64(k & 63)) & np.uint64(1) == 0
            if free.any():
                found = start + int(free.argmax())
                break
            start, step = end, step * 4
        if found >= 0:
            left, bin_id, marks = self._take(found)
        else:
            left, bin_id, marks = capacity, new_id, [np.zeros(m.shape[1], np.uint64) for m in self.marks]
        for m, k in zip(marks, keys):
            if k >= 0:
                m[k >> 6] |= np.uint64(1) << np.uint64(k & 63)
        self._put(left - size, bin_id, marks)
        return bin_id, capacity - left


def pack_shard(size: np.ndarray, source: list, cluster: list, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces must come in the order they are to be placed."""
    names = {s: i for i, s in enumerate(dict.fromkeys(x for x in source if x is not None))}
    counts: dict = {}
    for c in cluster:
        if c is not None:
            counts[c] = counts.get(c, 0) + 1
    twice = {c: i for i, c in enumerate(c for c, k in counts.items() if k > 1)}
    bins = Bins(len(names), len(twice))
    out_bin, out_at = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    opened = 0
    for i, n in enumerate(size.tolist()):
        out_bin[i], out_at[i] = bins.place(n, (names.get(source[i], -1), twice.get(cluster[i], -1)), opened, capacity)
        opened = max(opened, int(out_bin[i]) + 1)
    return out_bin, out_at


def _measure(batches: Iterator[dict]) -> Iterator[dict]:
    for cols in batches:
        n, h = [], []
        for t, ok in zip(utf8(cols["text"]), cols["text"].is_valid().to_pylist()):
            words = t.lower().split()
            n.append(len(words))
            h.append(xxhash.xxh3_128_digest(b" ".join(words)) if ok else None)
        yield {"n_tokens": pa.array(n, pa.int64()), "cluster": pa.array(h, pa.binary())}


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, source, shard, bin (within its shard) and offset in the bin.

    Full pieces of a long row have a shard of their own, numbered below 0.
    docs: doc_id, text, source.
    """
    prepare(docs.sparkSession)
    sized = map_rows(docs, {"text": "text"}, _measure, "n_tokens long, cluster binary", keep=["doc_id", "source"])
    # ids, sizes and clusters only; stored, as the number of shards follows from the count and a row keeps its number
    sized = sized.checkpoint().withColumn("row", F.monotonically_increasing_id())
    pieces = sized.select(
        "doc_id", "source", "cluster", "row", F.col("n_tokens").alias("doc_tokens"),
        F.explode(F.sequence(F.lit(0).cast("long"),
                             F.greatest(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {capacity}")))).alias("piece"))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(capacity).cast("long"),
                                                   F.col("doc_tokens") - F.col("piece") * capacity))
    full = pieces.filter((F.col("n_tokens") == capacity) & (F.col("doc_tokens") > capacity))
    rest = pieces.filter((F.col("n_tokens") < capacity) | (F.col("doc_tokens") <= capacity))
    shards = max(1, -(-sized.count() // shard_rows))
    rest = (rest.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(10)), F.lit(shards)))
            .withColumn("place", F.xxhash64("doc_id", "source", "cluster"))
            .repartition(shards, "shard")
            .sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "place"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held)
            out_bin, at = pack_shard(t["n_tokens"].to_numpy(), t["source"].to_pylist(), t["cluster"].to_pylist(), capacity)
            t = t.select(["doc_id", "piece", "n_tokens", "source", "shard"])
            t = t.append_column("bin", pa.array(out_bin)).append_column("offset", pa.array(at))
            held.clear()
            return t.to_batches()

        for b in batches:
            while b.num_rows:  # a batch may hold the end of one shard and the start of the next
                shard = b["shard"].to_numpy()
                if held and held[-1]["shard"][0].as_py() != shard[0]:
                    yield from flush()
                n = int(np.searchsorted(shard, shard[0], "right"))
                held.append(b.slice(0, n))
                b = b.slice(n)
        if held:
            yield from flush()

    kinds = {f.name: f.dataType.simpleString() for f in rest.schema}
    packed = rest.select("doc_id", "piece", "n_tokens", "source", "cluster", "shard").mapInArrow(
        pack, f"doc_id {kinds['doc_id']}, piece long, n_tokens long, source {kinds['source']}, shard long, "
              "bin long, offset long")
    alone = full.select("doc_id", "piece", "n_tokens", "source", (-1 - F.col("row")).alias("shard"),
                        F.col("piece").alias("bin"),
                        F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


@register("op10_best_fit")
def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): where each kept document's pieces lie."""
    return best_fit_packing(docs)
