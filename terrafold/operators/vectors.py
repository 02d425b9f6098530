"""Cosine top-k of a query set, exact in parts, or through an inverted file of cells.

The index puts every row into the cell of its nearest centre. Centres are fitted on a bounded sample (``SAMPLE`` rows by
hash), everything else covers all rows. A query looks into its nearest cells, as many as reached the wanted recall on the
sample. ``exact`` goes on from there: a cell is only left out if no vector of it can be as near as the k-th found so far,
by the angles of query and centre and of the centre and its farthest vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.operators.storage import materialize

#: Rows of a part of vectors and of queries; two parts meet in one task, ``STEP`` queries at a time.
PART, ASKED, STEP = 8192, 4096, 256
#: Rows that centres are fitted on, and most cells.
SAMPLE, CELLS = 20_000, 4096
FOUND = "id long, other long, similarity double"


def unit(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a column of lists of the same length."""
    if not len(vectors):
        return np.zeros((0, 0))
    lists = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (``id``, ``v``) with an id and a vector of numbers."""
    return vectors.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))


def parts_of(n: int, size: int) -> int:
    return max(1, -(-n // size))


def dealt(column: str, parts: int) -> Column:
    """Which of ``parts`` a row is in, by the hash of a column."""
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def first_k(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best ``k`` entries of each ``row``; ties go to the smallest id."""
    order = np.lexsort((ids, -np.round(scores, 9), row))
    return order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]


def nearest_in(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position of the query, id and similarity of the best ``k`` of each query; a row isn't its own neighbour."""
    found = []
    for at in range(0, len(q), STEP):
        scores = q[at : at + STEP] @ v.T
        scores[q_ids[at : at + STEP, None] == v_ids[None]] = -2
        rounded = np.round(scores, 9)
        least = np.partition(rounded, -k, axis=1)[:, [-k]] if len(v) > k else -2
        row, col = np.nonzero((rounded >= least) & (scores > -2))
        score = scores[row, col]
        kept = first_k(row, v_ids[col], score, k)
        found.append((row[kept] + at, v_ids[col[kept]], score[kept]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "other"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def top_similar(queries: DataFrame, vectors: DataFrame, k: int = 10, part: int = PART) -> DataFrame:
    """Exact cosine top-k of a stated query set (``id, v``) against all vectors, in parts.

    Both sides are dealt into parts of bounded size and every two parts meet in one task, as columns of numbers. What
    leaves a task is k rows for each of its queries, and the best of those are taken by query.
    """
    queries, vectors = usable(queries).select("id", "v"), usable(vectors).select("id", "v")
    nq, nv = parts_of(queries.count(), ASKED), parts_of(vectors.count(), part)
    # the right side's columns have names of their own, since both sides may come from one table
    copies = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    asked = queries.select("id", "v", dealt("id", nq).alias("q_part"), copies("v_part", nv))
    rows = vectors.select(F.col("id").alias("other"), F.col("v").alias("w"), dealt("id", nv).alias("v_part"), copies("q_part", nq))

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        (q_ids,), (v_ids,) = columns(q, "id"), columns(v, "other")
        row, other, score = nearest_in(q_ids, unit(q.column("v")), v_ids, unit(v.column("w")), k)
        return pa.table({"id": q_ids[row], "other": other, "similarity": score})

    by = ["q_part", "v_part"]
    return best(asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(run, FOUND), k)


def centres_of(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of unit vectors by spherical k-means, from rows spread over the sample; an empty cell keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(np.int64)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells for which queries from the sample find ``recall`` of their best k in it."""
    queries = x[:: max(1, len(x) // 200)]
    scores = queries @ x.T
    scores[scores > 1 - 1e-12] = -2
    near = np.argsort(-scores, axis=1)[:, :k]
    order = np.argsort(np.argsort(-(queries @ centres.T), axis=1), axis=1)
    rank = np.take_along_axis(order, (x @ centres.T).argmax(1)[near], axis=1)
    return int(np.quantile(rank.ravel(), recall, method="higher")) + 1


class VectorIndex(NamedTuple):
    """``rows`` has ``cell``, ``bundle``, ``id`` and ``v``; ``spread`` is the largest angle of a cell's vectors to its centre.

    A bundle is some small cells or a part of a large one. Cell ``c`` is in the bundles from ``bundles[c, 0]`` on,
    ``bundles[c, 1]`` of them.
    """

    rows: DataFrame
    centres: np.ndarray
    spread: np.ndarray
    probes: int
    bundles: np.ndarray

    @classmethod
    def fit(cls, vectors: DataFrame, *, k: int = 10, recall: float = 0.95, sample: int = SAMPLE, cells: int | None = None, part: int = PART) -> VectorIndex:
        """Index every usable row (``id, v``) of the most common length. Cells are about the root of the rows unless given."""
        rows = usable(vectors)
        most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dims, total = (most["d"], most["count"]) if most else (0, 0)
        rows = rows.where(F.size("v") == dims)
        x = unit(rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v"))  # bounded by ``sample``
        if not len(x):
            nothing = rows.select(F.lit(0).alias("cell"), F.lit(0).alias("bundle"), "id", "v")
            return cls(nothing, x, np.zeros(0), 0, np.zeros((0, 2), np.int64))
        centres = centres_of(x, cells or min(CELLS, max(1, round(total**0.5))))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, STEP):
                    batch = whole.slice(at, STEP)
                    scores = unit(batch.column("v")) @ centres.T
                    own = scores.argmax(1)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(scores[np.arange(len(own)), own]), *batch.columns], names=["cell", "score", "id", "v"])

        kind = rows.schema["v"].dataType.simpleString()
        placed = materialize(rows.select("id", "v").mapInArrow(assign, f"cell int, score double, id long, v {kind}"))
        spread, bundles, filled, last = np.zeros(len(centres)), np.zeros((len(centres), 2), np.int64), 0, 0
        for r in placed.groupBy("cell").agg(F.min("score").alias("far"), F.count("*").alias("n")).collect():  # a row for each cell
            if filled and filled + r["n"] > part:
                last, filled = last + 1, 0
            spread[r["cell"]], bundles[r["cell"]] = np.arccos(min(1.0, r["far"])), (last, parts_of(r["n"], part))
            if r["n"] > part:
                last += parts_of(r["n"], part)
            else:
                filled += r["n"]
        of_cell = lambda j: F.element_at(F.array(*(F.lit(int(b)) for b in bundles[:, j])), F.col("cell") + 1)
        bundle = of_cell(0) + F.pmod(F.xxhash64("id"), F.greatest(of_cell(1), F.lit(1))).cast("int")
        return cls(placed.drop("score").withColumn("bundle", bundle), centres, spread, min(len(centres), probes_for(x, centres, k, recall)), bundles)

    def _looked_up(self, queries: DataFrame, bundles: DataFrame, k: int) -> DataFrame:
        """Best k of each query in the cells it asks for in a bundle (``id, v, bundle, cells``)."""
        nq = parts_of(queries.count(), ASKED)
        asked = bundles.withColumn("q_part", dealt("id", nq))
        rows = self.rows.select("bundle", "cell", "id", "v", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q_part"))

        def run(q: pa.Table, v: pa.Table) -> pa.Table:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            q_ids = np.zeros(0, np.int64)
            if q.num_rows and v.num_rows:
                (q_ids,), (cells, v_ids) = columns(q, "id"), columns(v, "cell", "id")
                wanted = pa.concat_arrays(q.column("cells").chunks)
                who, cell = np.repeat(np.arange(len(q_ids)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
                qs, vs = unit(q.column("v")), unit(v.column("v"))
                for c in np.unique(cells):
                    asking, mine = who[cell == c], np.nonzero(cells == c)[0]
                    if len(asking):
                        row, other, score = nearest_in(q_ids[asking], qs[asking], v_ids[mine], vs[mine], k)
                        found.append((asking[row], other, score))
            row, other, score = (np.concatenate(x) for x in zip(*found, strict=True))
            kept = first_k(row, other, score, k)
            return pa.table({"id": q_ids[row[kept]].astype(np.int64), "other": other[kept].astype(np.int64), "similarity": score[kept]})

        by = ["bundle", "q_part"]
        return asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(run, FOUND)

    def _cells(self, queries: DataFrame, first: bool) -> DataFrame:
        """Each query (``id, v``) once for each bundle, with the nearest ``cells`` in it, or (by ``kth``) the others that can hold something as near."""
        centres, spread, probes, bundles = self.centres, self.spread, self.probes, self.bundles
        kind = queries.schema["v"].dataType.simpleString()

        def asked(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = unit(batch.column("v")) @ centres.T
            order = np.argsort(-scores, axis=1, kind="stable")
            if first:
                may = np.zeros(scores.shape, bool)
                np.put_along_axis(may, order[:, :probes], True, axis=1)
            else:
                bound = np.cos(np.maximum(0, np.arccos(np.clip(scores, -1, 1)) - spread))
                may = bound >= batch.column("kth").to_numpy(zero_copy_only=False)[:, None] - 1e-9
                np.put_along_axis(may, order[:, :probes], False, axis=1)
            row, cell = np.nonzero(may)
            copies = bundles[cell, 1]
            step = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            row, cell, bundle = np.repeat(row, copies), np.repeat(cell, copies), np.repeat(bundles[cell, 0], copies) + step
            by = np.lexsort((cell, bundle, row))
            row, cell, bundle = row[by], cell[by], bundle[by]
            starts = np.nonzero(np.r_[True, (np.diff(row) > 0) | (np.diff(bundle) > 0)])[0] if len(row) else np.zeros(0, np.int64)
            at, lists = pa.array(row[starts]), pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), pa.array(cell, pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(bundle[starts], pa.int32()), lists], names=["id", "v", "bundle", "cells"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, STEP):
                    yield asked(batch.slice(at, STEP))

        return queries.mapInArrow(run, f"id long, v {kind}, bundle int, cells array<int>")

    def search(self, queries: DataFrame, k: int = 10, *, exact: bool = False) -> DataFrame:
        """``id``, ``other``, ``similarity``, ``place`` of the best k of each query (``id, v``)."""
        asked = usable(queries).where(F.size("v") == (self.centres.shape[1] if self.spread.size else 0)).select("id", "v")
        found = self._looked_up(asked, self._cells(asked, True), k)
        if not exact:
            return best(found, k)
        found = materialize(best(found, k))
        last = found.where(F.col("place") == k).select("id", F.col("similarity").alias("kth"))
        open_queries = materialize(asked.join(last, "id", "left").select("id", "v", F.coalesce("kth", F.lit(-2.0)).alias("kth")))
        more = self._looked_up(open_queries, self._cells(open_queries, False), k)
        return best(found.drop("place").unionByName(more), k)
