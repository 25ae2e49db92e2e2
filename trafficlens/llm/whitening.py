"""Embedding whitening by shifted CholeskyQR: Gram passes, triangular solves, and the SVD of the composed R.

The fit list holds every distinct vector once, as whole numbers floor(256*c);
it is written to the shared folder and read by each pass.  A pass centres the
rows, solves them through the triangular factors found so far, and sums the
Gram matrix of what comes out; its Cholesky factor is the next R.  The first
factor (and any for which Cholesky fails) takes a small shift, so the rows
need not be of full rank.  Once the rows are orthogonal to double precision,
the product of the factors has the singular values and right vectors of the
centred rows: no covariance is formed whose small eigenvalues would drown.

Tasks send sums only (dimension squared numbers, added up by Spark before
they reach the driver); the driver works on dimension x dimension matrices.

Defined cases: vectors that are null, hold null or non-finite components, or
have another length than the table's commonest (see vectors.py) are dropped.
Components whose variance is zero to double precision are not returned (one
distinct vector has none).  Components beyond 2^53 are held there.
``deviation`` is null where it does not fit a long.  Repeated rows stay, a
null vec_id too; no rows: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.llm.common import ROW, prepare, table
from trafficlens.llm.registry import register
from trafficlens.llm.vectors import dimension, matrix, regrouped, scaled
from trafficlens.session import stored

SCALE = 256
COMPONENTS = 4
MOST = 1 << 53
#: Gram passes at most; three are enough unless the rows are short of rank.
PASSES = 5
#: The shift grows with the rows up to here: sums taken by batches err no more than so many single steps.
SHIFT_ROWS = 10 ** 6
EPS = float(np.finfo(np.float64).eps) / 2


def pack(x: np.ndarray) -> list[bytes]:
    """A row as bytes: four per number where all of its numbers fit, else eight."""
    small = np.abs(x).max(axis=1, initial=0) < 1 << 31
    return [r.astype("<i4").tobytes() if s else r.astype("<i8").tobytes() for r, s in zip(x, small)]


def unpack(col: pa.Array, dim: int) -> np.ndarray:
    packed = col.to_pylist()
    if all(len(p) == 4 * dim for p in packed):
        return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), dim).astype(np.int64)
    return np.array([np.frombuffer(p, "<i4" if len(p) == 4 * dim else "<i8") for p in packed], np.int64)


@dataclass
class Centre:
    """The fit list's size and its exact sums per dimension."""
    n: int
    sums: list[int]

    def of(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the whole part of the mean goes first, without rounding."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - part

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2, exact; None beyond a long."""
        far = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if far * far * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = (sum((self.n * int(c) - s) ** 2 for c, s in zip(r, self.sums)) for r in x)
        return [d if d < 1 << 63 else None for d in exact]


def solve(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverses of the upper triangular ``factors``, one after the other, by substitution."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(r.shape[0]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


class FitList:
    """The distinct vectors, stored; sums over them."""

    def __init__(self, df: DataFrame, dim: int):
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in regrouped(batches):
                yield pa.RecordBatch.from_arrays([pa.array(pack(scaled(matrix(b.column(0), dim)[1], SCALE, MOST)),
                                                           pa.binary())], ["x"])

        self.dim = dim
        self.rows, _ = stored(df.select("embedding").mapInArrow(packed, "x binary").distinct(), "whitening-fit")
        self.centre = self._centre()

    def _centre(self) -> Centre:
        dim = self.dim

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
            for b in regrouped(batches):
                x = unpack(b.column(0), dim)
                n += len(x)
                high += (x >> 26).sum(0)
                low += (x & ((1 << 26) - 1)).sum(0)
            yield pa.RecordBatch.from_pydict({"at": np.arange(-1, dim, dtype=np.int32),
                                              "high": np.append(np.int64(0), high), "low": np.append(np.int64(n), low)})

        got = {r["at"]: (int(r["high"]) << 26) + int(r["low"]) for r in
               self.rows.mapInArrow(sums, "at int, high long, low long").groupBy("at")
               .agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect()}
        return Centre(got[-1], [got[j] for j in range(dim)])

    def _summed(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all rows of ``of(centred rows)``, an array of any shape."""
        dim, centre = self.dim, self.centre

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in regrouped(batches):
                part = of(centre.of(unpack(b.column(0), dim)))
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size, dtype=np.int64),
                                                  "v": total.reshape(-1)})

        shape = of(np.zeros((0, dim))).shape
        out = np.zeros(int(np.prod(shape)))
        for r in self.rows.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
            out[r["cell"]] = r["v"]
        return out.reshape(shape)

    def gram(self, factors: list[np.ndarray], scale: float) -> np.ndarray:
        def of(rows: np.ndarray) -> np.ndarray:
            q = solve(rows / scale, factors)
            return q.T @ q

        return self._summed(of)


def _factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix, shifted on request or where it has none otherwise."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * EPS * max(float(np.linalg.norm(g, 2)), np.finfo(float).tiny)
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 16


@dataclass
class Whitening:
    """``components``: dimension x k; ``values``: their k variances, falling; ``total``: the covariance's trace."""
    centre: Centre
    components: np.ndarray
    values: np.ndarray
    total: float
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.of(x) @ self.components / np.sqrt(self.values)


def fit(df: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Whitens the column ``embedding`` to its first k components; None without any vector."""
    dim = dimension(df, "embedding")
    if not dim:
        return None
    fitted = FitList(df, dim)
    n = fitted.centre.n
    # rows are divided by their norm (a power of two), so that squares neither overflow nor vanish
    size = np.sqrt(float(fitted._summed(lambda rows: np.array([(rows * rows).sum()]))[0]))
    scale = float(2.0 ** np.floor(np.log2(size))) if size > 0 else 1.0
    factors: list[np.ndarray] = []
    composed = np.eye(dim)
    for turn in range(PASSES):
        g = fitted.gram(factors, scale)
        if turn == PASSES - 1 or turn and np.abs(g - np.eye(dim)).max() < dim * 1e-14:
            break
        factors.append(_factor(g, min(n, SHIFT_ROWS), shifted=turn == 0))
        composed = factors[-1] @ composed
    # rows = Q R and g = Q'Q: near one, or short of rank, where the root of g stands for Q
    w, u = np.linalg.eigh(g)
    _, s, vt = np.linalg.svd(np.sqrt(np.maximum(w, 0))[:, None] * (u.T @ composed))
    kept = min(k, int((s > s.max(initial=0) * 32 * dim * EPS).sum()))
    values = (s * scale) ** 2 / n
    white = Whitening(fitted.centre, vt[:kept].T.copy(), values[:kept], float(values.sum()))
    if kept:
        white.identity_error = _identity_error(fitted, white)
    return white


def _identity_error(fitted: FitList, white: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured over the fit list."""
    turn = white.components / np.sqrt(white.values)
    mean = fitted._summed(lambda rows: (rows @ turn).sum(0)) / white.centre.n

    def of(rows: np.ndarray) -> np.ndarray:
        w = rows @ turn - mean
        return w.T @ w

    return float(np.abs(fitted._summed(of) / white.centre.n - np.eye(len(mean))).max())


def whiten(df: DataFrame, k: int = COMPONENTS, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """One row per kept row and component: the columns ``keep``, component (from 1), n, deviation, whitened,
    explained and identity_error."""
    white = fit(df, k)
    if white is None:
        white, df = Whitening(Centre(1, []), np.zeros((0, 0)), np.zeros(0), 1.0), df.limit(0)
    shared = df.sparkSession.sparkContext.broadcast(white)
    dim = len(white.centre.sums)
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias(ROW), F.col("embedding").alias("__vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = shared.value
        for b in regrouped(batches):
            ok, found = matrix(b.column(1), dim)
            x = scaled(found, SCALE, MOST)
            w = white.apply(x)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]),
                                            pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)),
                                              pa.array(white.centre.deviation(x), pa.int64()), rows],
                                             [ROW, "__deviation", "__whitened"])

    got = src.mapInArrow(run, T.StructType([src.schema[ROW], T.StructField("__deviation", T.LongType()),
                                            T.StructField("__whitened", T.ArrayType(T.DoubleType()))]))
    explained = F.array(*[F.lit(float(e / white.total)) for e in white.values]).cast("array<double>")
    got = got.select("*", F.posexplode("__whitened").alias("__at", "__w"))
    return got.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in keep], (F.col("__at") + 1).alias("component"),
                      F.lit(white.centre.n).cast("long").alias("n"), F.col("__deviation").alias("deviation"),
                      F.col("__w").alias("whitened"), F.get(explained, F.col("__at")).alias("explained"),
                      F.lit(white.identity_error).alias("identity_error"))


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first four whitening components."""
    prepare(spark)
    return whiten(table(spark, sf_dir, "embeddings"))
