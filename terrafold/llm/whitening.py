"""Operator 11: embedding whitening from bit-sliced exact moments.

Every entry becomes an integer. The integers of a batch are shifted to start at 0 and cut into bit planes, each packed
across the rows into 64-bit words; AND and popcount of two planes, weighted by their bits, add up to the exact sums of
products. Moments are centred as integers before the eigendecomposition, so no digit is lost to the offset.

Rules for odd input: a row whose vector is null, or holds a null, NaN, infinite entry or one of absolute value 2^40 and
more, is left out; so is a vector whose length isn't ``dims`` (by default the most common length, the longer on a tie).
Ids may be null or repeat, every remaining row is whitened. Repeated vectors count once in the fit. Components without
variance (an eigenvalue of at most 1e-11 of the first) don't exist, so fewer than asked may come; none from an empty
table or one distinct vector. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import materialize

LARGEST = float(1 << 40)
#: Rows whose planes are held at a time.
BLOCK_ROWS = 1 << 16
#: Eigenvalues below this share of the first are rounding noise.
NOISE = 1e-11


def quantised(vector: Column, *, scale: int = 64, offset: int = 1_000_000) -> Column:
    """The entries as integers: floor(scale * entry) + offset."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite and of bounded size."""
    return (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))


def integer_rows(df: DataFrame, vector: str, dims: int | None = None, **scaling: int) -> DataFrame:
    """All columns but ``vector`` of the usable rows, and ``x``, their integers."""
    rows = df.where(usable(F.col(vector)))
    if dims is None:
        most = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dims = most["d"] if most else 0
    others = [F.col(f"`{c}`") for c in df.columns if c != vector]
    return rows.where(F.size(vector) == dims).select(*others, quantised(F.col(vector), **scaling).alias("x"))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), np.int64)


def bit_planes(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of the non-negative columns of ``z``, packed across rows (a row of 64-bit words each); column and bit of each plane."""
    column = np.concatenate([np.full(int(m).bit_length(), j) for j, m in enumerate(z.max(0))]).astype(np.int64)
    bit = np.concatenate([np.arange(int(m).bit_length()) for m in z.max(0)]).astype(np.int64)
    words = -(-len(z) // 64)
    packed = np.zeros((len(column), words * 8), np.uint8)
    for p, (j, b) in enumerate(zip(column.tolist(), bit.tolist(), strict=True)):
        bits = np.packbits(((z[:, j] >> b) & 1).astype(np.uint8))
        packed[p, : len(bits)] = bits
    return packed.view(np.uint64), column, bit


def products(z: np.ndarray) -> np.ndarray:
    """Exact sums over rows of the products of any two columns of non-negative integers, as Python integers."""
    d = z.shape[1]
    out = np.full((d, d), 0, object)
    planes, column, bit = bit_planes(z)
    if not len(column):
        return out
    common = np.zeros((len(column), len(column)), np.int64)
    for p in range(len(column)):
        common[p, p:] = np.bitwise_count(planes[p] & planes[p:]).sum(1, dtype=np.int64)
    common = np.triu(common) + np.triu(common, 1).T
    if 2 * int(bit.max()) + len(z).bit_length() + 2 * len(column).bit_length() > 62:
        common, weight = common.astype(object), np.array([1 << int(b) for b in bit], object)
    else:
        weight = np.int64(1) << bit
    first = np.flatnonzero(np.concatenate([[True], np.diff(column) > 0]))
    summed = np.add.reduceat(np.add.reduceat(common * weight * weight[:, None], first, axis=0), first, axis=1)
    out[np.ix_(column[first], column[first])] = summed.astype(object)
    return out


def batch_moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and sums of products of integer rows: planes of x less its minimum, then moved back exactly."""
    low = x.min(0)
    z = x - low
    low = low.astype(object)
    own = z.sum(0).astype(object) if int(z.max()) * len(z) < 1 << 62 else z.astype(object).sum(0)
    cross = products(z) + np.outer(low, own) + np.outer(own, low) + len(z) * np.outer(low, low)
    return len(z), own + len(z) * low, cross


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` distinct vectors: their sums, the trace, and unit eigenvectors (columns) with falling eigenvalues."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact."""
        middle = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s - self.n * int(m) for s, m in zip(self.sums, middle, strict=True)]
        near = x - middle
        if (int(np.abs(near).max(initial=0)) + 1) * self.n < 1 << 62:
            return near * self.n - np.array(rest, np.int64)
        return near.astype(object) * self.n - np.array(rest, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened components of ``centred`` rows."""
        return (centred.astype(np.float64) / self.n) @ (self.vectors / np.sqrt(self.values))


MOMENTS = "i int, j int, v decimal(38,0)"


def moments(fit: DataFrame) -> dict[tuple[int, int], int]:
    """Exact moments of the rows ``x``: (-1, -1) their number, (i, -1) sums, (i, j) with i <= j sums of products.

    A task adds up its batches and gives one row for each of these numbers; the driver gets them once, however many rows
    there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, own, cross = 0, None, None
        for batch in batches:
            x = matrix(batch)
            for at in range(0, len(x), BLOCK_ROWS):
                m, s, c = batch_moments(x[at : at + BLOCK_ROWS])
                n, own, cross = (m, s, c) if own is None else (n + m, own + s, cross + c)
        if own is not None:
            i, j = np.triu_indices(len(own))
            d = np.arange(len(own))
            values = [Decimal(int(v)) for v in [n, *own, *cross[i, j]]]
            columns = [pa.array(np.concatenate([[-1], d, i]), pa.int32()), pa.array(np.concatenate([[-1], d * 0 - 1, j]), pa.int32()), pa.array(values, pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "v"])

    found = fit.select("x").mapInArrow(run, MOMENTS).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): int(r["v"]) for r in found.collect()}


def fit(distinct: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the rows ``x``, each counted once; None if there are none or all are equal."""
    found = moments(distinct)
    n = found.get((-1, -1), 0)
    d = sum(j == -1 and i >= 0 for i, j in found)
    sums = tuple(found[i, -1] for i in range(d))
    scaled = np.zeros((d, d))
    trace = 0
    for i in range(d):
        for j in range(i, d):
            centred = n * found[i, j] - sums[i] * sums[j]  # n^2 times the covariance
            scaled[i, j] = scaled[j, i] = centred / (n * n)
            trace += centred * (i == j)
    if not trace:
        return None
    values, vectors = np.linalg.eigh(scaled)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    there = values > NOISE * values[0]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0) < 0, -1, 1)
    return Whitening(n, sums, trace / (n * n), values[there], vectors[:, there])


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit rows' covariance less the identity, measured over all of them."""
    k = len(model.values)
    a, b = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                y = model.project(model.centred(matrix(batch)))
                total, mean = total + y.T @ y, mean + y.sum(0)
        columns = [pa.array(np.concatenate([a, np.arange(k)]), pa.int32()), pa.array(np.concatenate([b, np.full(k, -1)]), pa.int32()), pa.array(np.concatenate([total[a, b], mean]))]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "v"])

    found = {(r["i"], r["j"]): r["v"] / model.n for r in distinct.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    return max(abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i, j in zip(a.tolist(), b.tolist(), strict=True))


def whiten(df: DataFrame, *, row_id: str = "vec_id", vector: str = "embedding", components: int = 16, dims: int | None = None) -> DataFrame:
    """A row for each usable row and component: ``row_id``, ``component`` (from 1), ``n`` (distinct vectors fitted),
    ``deviation`` (exact sum of squares of n*x-S), ``whitened``, ``explained`` (share of the variance) and ``identity_error``.
    """
    kind = df.schema[row_id].dataType.simpleString()
    rows = integer_rows(df.select(F.col(row_id).alias("row_id"), F.col(vector).alias("v")), "v", dims)
    distinct = materialize(rows.select("x").distinct())  # equal vectors are merged before they are shuffled
    model = fit(distinct, components)
    names = f"row_id {kind}, deviation decimal(38,0), y array<double>"
    out = ("row_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    if model is None:
        empty = df.sparkSession.createDataFrame([], f"row_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
        return empty.withColumnRenamed("row_id", row_id)
    error = identity_error(distinct, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = model.centred(matrix(batch))
                small = u.dtype != object and int(np.abs(u).max()) ** 2 * u.shape[1] < 1 << 62
                squares = (u * u).sum(1) if small else (u.astype(object) ** 2).sum(1)
                y = model.project(u)
                deviation = pa.array([Decimal(int(v)) for v in squares], pa.decimal128(38, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), deviation, lists], names=["row_id", "deviation", "y"])

    share = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    each = rows.select("row_id", "x").mapInArrow(run, names).select("row_id", "deviation", F.posexplode("y").alias("at", "whitened"))
    done = each.withColumns({"component": F.col("at") + 1, "n": F.lit(model.n).cast("long"), "explained": F.get(share, F.col("at")), "identity_error": F.lit(error)})
    return done.select(*out).withColumnRenamed("row_id", row_id)
