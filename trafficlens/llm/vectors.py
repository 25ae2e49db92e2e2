"""Rows of vectors as matrices inside Spark tasks: what counts as a vector, and how many rows come at once.

A vector is kept if it is not null, none of its components is null or not
finite, and it has the table's dimension: the commonest length among such
vectors (of equally common ones the largest).  All else is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATRIX_ROWS = 8192


def regrouped(batches: Iterator[pa.RecordBatch], rows: int = MATRIX_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield from _joined(held)
            held, n = [], 0
    yield from _joined(held)


def _joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept (mask), and their vectors as doubles, a row each."""
    lengths = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    ok = lengths == dim
    flat = col.filter(pa.array(ok)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    found = flat.reshape(int(ok.sum()), dim)
    finite = np.isfinite(found).all(axis=1)
    ok[np.flatnonzero(ok)[~finite]] = False
    return ok, found[finite]


def dimension(df: DataFrame, column: str, multiple: int = 1) -> int | None:
    """The table's dimension, among lengths that are a multiple of ``multiple``; None without any vector."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in regrouped(batches):
            col = b.column(0)
            lengths = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths[lengths >= 0]).tolist():
                if n % multiple == 0:
                    seen[n] = seen.get(n, 0) + int(matrix(col, n)[0].sum())
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(seen), pa.int64()),
                                          "rows": pa.array(list(seen.values()), pa.int64())})

    got = (df.select(F.col(f"`{column}`").alias("v")).mapInArrow(count, "dim long, rows long")
           .groupBy("dim").agg(F.sum("rows").alias("rows")).filter("rows > 0")
           .orderBy(F.desc("rows"), F.desc("dim")).first())
    return got["dim"] if got else None


def scaled(found: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) as whole numbers, held within -most..most."""
    return np.clip(np.floor(found * scale), -most, most).astype(np.int64)
