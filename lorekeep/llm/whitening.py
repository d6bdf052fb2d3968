"""Whitening of embedding vectors by the singular values of the centred rows.

Each entry c becomes the integer x = floor(64 c) + 1000000. One pass sums x exactly by dimension, one
the exact squared deviations, from which the total variance comes; MLlib's ``RowMatrix.computeSVD``
takes the centred rows as a distributed matrix (its rows are made by column expressions in the JVM),
and its singular values s, with divisor n, are the variances s^2 / n along its right vectors. Rows are
then projected where they lie. What comes to the driver is bounded by the dimensions: sums, a square
matrix, never rows.

Defined results: rows whose vector is null, or holds null, NaN or infinite entries, are left out, as
is an empty vector, which has no dimension; vectors of another length are rows of another fit, each
length on its own; null and repeated ids are kept, each row apart; where fewer components have a
variance above 10^-12 of the first one's (few rows, equal rows, a constant dimension), only those are
returned, so one row or equal rows alone give none; an entry beyond 2^53 / 64 in size counts as that
size; a deviation beyond a long's range is null; an empty table gives no rows; other columns are left
out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Of the first singular value: those below count as zero.
LEAST_SHARE = 1e-6
_MOST = float(1 << 53)
_LIMBS = 32


def _numbers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The integers of a batch's vectors, a row each."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(flat * SCALE), -_MOST, _MOST).astype(np.int64).reshape(-1, dims) + SHIFT


class _Fit:
    """n, the sums S by dimension, the whole part of S / n and what is left of S."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.left = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.left / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exactly, for each row: the sum over dimensions of (n x - S)^2."""
        near = x - self.whole
        reach = self.n * (float(np.abs(near).max(initial=0)) + 1)
        if reach * reach * x.shape[1] < 2.0**62:
            d = near * self.n - self.left
            return (d * d).sum(1).tolist()
        return [sum((self.n * a - b) ** 2 for a, b in zip(row, self.left.tolist(), strict=True)) for row in near.tolist()]


def _sum_exactly(rows: DataFrame, dims: int, of_batch) -> dict[int, int]:
    """Sums of whole numbers of any size, by key: each partition adds its own, and they travel as parts of 32 bits."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            for k, v in of_batch(_numbers(batch, dims)):
                sums[k] = sums.get(k, 0) + v
        found = [(k, i, abs(v) >> _LIMBS * i & (1 << _LIMBS) - 1, -1 if v < 0 else 1) for k, v in sums.items() for i in range(-(-abs(v).bit_length() // _LIMBS) or 1)]
        columns = [[x[0] for x in found], [x[1] for x in found], [x[2] * x[3] for x in found]]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["k", "limb", "v"])

    total: dict[int, int] = {}
    for r in rows.select("vector").mapInArrow(run, "k long, limb int, v long").groupBy("k", "limb").agg(F.sum("v").alias("v")).toLocalIterator():
        total[r.k] = total.get(r.k, 0) + (r.v << _LIMBS * r.limb)
    return total


def _by_dimension(x: np.ndarray) -> list[tuple[int, int]]:
    # the number of rows, and the sums of the upper and lower halves, none of which can leave 64 bits
    high, low = (x >> _LIMBS).sum(0).tolist(), (x & (1 << _LIMBS) - 1).sum(0).tolist()
    return [(-1, len(x)), *((k, (h << _LIMBS) + v) for k, (h, v) in enumerate(zip(high, low, strict=True)))]


def _directions(rows: DataFrame, fit: _Fit, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit right vectors of the centred rows, as columns, and their variances, largest first."""
    dims = len(fit.sums)
    whole, left = F.lit(fit.whole.tolist()), F.lit((fit.left / fit.n).tolist())
    entry = lambda c: F.least(F.greatest(F.floor(c * float(SCALE)).cast("double"), F.lit(-_MOST)), F.lit(_MOST)) + float(SHIFT)
    centred = F.zip_with(F.zip_with(F.transform("vector", entry), whole, lambda x, w: x - w), left, lambda x, m: x - m)
    matrix = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("row")), "row")
    svd = RowMatrix(matrix, fit.n, dims).computeSVD(min(components, dims), computeU=False, rCond=LEAST_SHARE)
    s = svd.s.toArray()
    return svd.V.toArray()[:, : len(s)], s * s / fit.n


def _identity_error(rows: DataFrame, fit: _Fit, turn: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    dims, k = turn.shape

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = fit.centred(_numbers(batch, dims)) @ turn
            sums += w.sum(0)
            products += w.T @ w
        cells = np.concatenate([sums, products.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "v"])

    found = np.zeros(k + k * k)
    for r in rows.select("vector").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toLocalIterator():
        found[r.cell] = r.v
    mean = found[:k] / fit.n
    return float(np.abs(found[k:].reshape(k, k) / fit.n - np.outer(mean, mean) - np.eye(k)).max())


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors(vec_id, vector) -> a row for each vector and component, as in ``_RESULT``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & sound & (F.size("vector") > 0))
    found = rows.sparkSession.createDataFrame([], _RESULT)
    for of_length in rows.groupBy(F.size("vector").alias("dims")).count().orderBy("dims").toLocalIterator():
        found = found.unionByName(_of_length(rows.where(F.size("vector") == of_length.dims), of_length.dims, components))
    return found


def _of_length(rows: DataFrame, dims: int, components: int) -> DataFrame:
    sums = _sum_exactly(rows, dims, _by_dimension)
    fit = _Fit(sums.pop(-1), [sums.get(k, 0) for k in range(dims)])
    total = _sum_exactly(rows, dims, lambda x: [(0, sum(fit.deviations(x)))]).get(0, 0)
    if total == 0:
        return rows.sparkSession.createDataFrame([], _RESULT)
    directions, variances = _directions(rows, fit, components)
    turn, k = directions / np.sqrt(variances), len(variances)
    explained, error = variances / (total / fit.n**3), _identity_error(rows, fit, turn)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _numbers(batch, dims)
            m = len(x)
            at = np.repeat(np.arange(m), k)
            deviation = pa.array([v if v < 1 << 63 else None for v in fit.deviations(x)], pa.int64())
            columns = [
                batch.column("vec_id").take(pa.array(at)), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, fit.n), deviation.take(pa.array(at)),
                (fit.centred(x) @ turn).ravel(), np.tile(explained, m), np.full(m * k, error),
            ]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in _RESULT.split(", ")])

    return rows.select("vec_id", "vector").mapInArrow(run, _RESULT)


def op13_whitening_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector"))
