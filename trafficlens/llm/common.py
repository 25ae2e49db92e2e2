"""Shared helpers of the training-data operators.

Python work runs in ``mapInArrow`` over column batches: texts reach the
functions as UTF-8 ``bytes`` (no decoding where none is needed), and the
caller's own columns travel in one struct, so extra columns, whatever their
names, neither clash with an operator's columns nor get lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.session import ensure_checkpoint_dir, ship_package

ROW = "__row"
BATCH_ROWS = 1000
HEAVY_SHARE = 1000
SMALL_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package on the executors, and small Arrow batches (texts can be long)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    n = int(spark.conf.get(key, "10000"))
    if n <= 0 or n > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_rows(df: DataFrame, needs: dict[str, str], fn: Callable, schema: str,
             keep: list[str] | None = None) -> DataFrame:
    """``df`` with the columns that ``fn`` makes.

    needs: what ``fn`` reads, by name, as SQL expressions over ``df``.  fn:
    takes an iterator of ``dict[str, pa.Array]`` (the needs) and yields one
    dict of result columns per input batch, row for row.  keep: the columns
    of ``df`` that stay (all, if None); a column that ``fn`` makes replaces a
    kept one of its name.
    """
    kept = df.columns if keep is None else keep
    made = T._parse_datatype_string(schema)
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(True).alias("_")]).alias(ROW),
                    *[F.expr(e).alias(f"__in_{k}") for k, e in needs.items()])
    out = T.StructType([T.StructField(ROW, src.schema[ROW].dataType)]
                       + [T.StructField(f"__out_{f.name}", f.dataType) for f in made])
    names, made_names = list(needs), [f.name for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []

        def feed():
            for b in batches:
                if b.num_rows:
                    rows.append(b.column(0))
                    yield {k: b.column(i + 1) for i, k in enumerate(names)}

        for cols in fn(feed()):
            row = rows.pop(0)
            yield pa.RecordBatch.from_arrays([row, *[cols[k] for k in made_names]],
                                             [ROW, *[f"__out_{k}" for k in made_names]])

    got = src.mapInArrow(run, out)
    return got.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in kept if c not in made_names],
                      *[F.col(f"__out_{c}").alias(c) for c in made_names])


def utf8(col: pa.Array) -> list[bytes]:
    """A text column's values as bytes; null counts as empty."""
    return [b or b"" for b in col.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit xxh3, remembered; forgets everything at ``limit`` words, so memory is bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from one flat array and the length of each row's part."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def attach(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """Left (or inner) join on ``key``; ``right`` has one row per key and how many rows of ``left`` have it (``count``).

    total: the rows of ``left``.  Up to SMALL_ROWS of them ``right`` is
    broadcast, as it has no more rows.  Beyond, keys with at least 1/1000 of
    the rows are at most 1000, so they are broadcast; the rest is shuffled,
    and none of those keys is large.  Both frames are read twice: pass
    checkpointed or stored ones.
    """
    if total <= SMALL_ROWS:
        return left.join(F.broadcast(right.drop(count)), key, how)
    bar = total // HEAVY_SHARE
    heavy, light = right.filter(F.col(count) >= bar).drop(count), right.filter(F.col(count) < bar).drop(count)
    keys = [bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in heavy.select(key).collect()]
    if not keys:
        return left.join(light, key, how)
    hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    some = left.filter(hot).join(F.broadcast(heavy), key, "inner")
    return some.unionByName(left.filter(~hot).join(light, key, how).select(*some.columns))
