r"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each \n-split line is good or bad. Its potential comes from features of the line and of both neighbours, and
neighbouring labels are tied by a transition table. Forward-backward gives each line's marginal of being
good; the document's score is their mean weighted by line length. Labels are known by document, so in
training each line carries its document's label and each document weighs the same.

Rules for odd input: null text counts as empty, which is one empty line and gets a score as any other; rows
with a null label teach nothing; without two labels in the training rows every score is the share of label 1
(1.0 with no rows at all); repeated rows are judged each on its own; input columns named like the added ones
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.common import materialize, owner, pieces, texts, words
from terrafold.llm.divergence import CLASSES, class_counts

BASE = ("bias", "empty", "length", "words", "word_length", "upper", "digit", "punctuation", "symbol", "other", "wide", "common", "distinct", "stop", "capital", "repeat")


def lines_of(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    split = pc.split_pattern(text, "\n")
    at = split.offsets.to_numpy().astype(np.int64)
    return at - at[0], split.flatten()


def own_features(text: pa.Array, common: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line offsets of each text, the features of each line by itself, and line weights."""
    offsets, lines = lines_of(text)
    counts = class_counts(lines).astype(np.float64)
    size = counts.sum(axis=1)
    at, flat = words(lines)
    n, of = np.diff(at).astype(np.float64), owner(at)
    share = lambda *names: counts[:, [CLASSES.index(x) for x in names]].sum(axis=1) / np.maximum(size, 1)
    known = pc.is_in(flat, pa.array(common, pa.large_string())).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    codes, width = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    distinct = np.bincount(np.unique(of * width + codes) // width, minlength=len(n)) if len(of) else np.zeros(len(n))
    lined = lines.dictionary_encode()
    line_codes, lines_width = lined.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(lined.dictionary))
    key = owner(offsets) * lines_width + line_codes
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    trimmed = pc.ascii_trim_whitespace(lines)
    own = np.stack([
        np.ones(len(n)), n == 0, np.log1p(size) / 4, np.log1p(n) / 3, np.minimum(size / np.maximum(n, 1), 40) / 10,
        share("upper"), share("digit") * 3, share("punctuation") * 5, share("symbol") * 5, share("other") * 5, share("wide"),
        np.bincount(of[known], minlength=len(n)) / np.maximum(n, 1), distinct / np.maximum(n, 1),
        pc.match_substring_regex(trimmed, r"[.!?]\z").to_numpy(zero_copy_only=False), pc.match_substring_regex(trimmed, r"^\p{Lu}").to_numpy(zero_copy_only=False), ~first & (n > 0),
    ], axis=1).astype(np.float64)
    return offsets, own, size + 1


def with_neighbours(offsets: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The features of each line, then those of the line before and after it in its text (0 where there is none)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[offsets[:-1]] = 0
    after[offsets[1:] - 1] = 0
    return np.concatenate([own, before, after], axis=1)


def features(text: pa.Array, common: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line offsets of each text, the features of each line with those of its neighbours, and line weights."""
    offsets, own, weight = own_features(text, common)
    return offsets, with_neighbours(offsets, own), weight


def marginals(offsets: np.ndarray, logit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, the expected label pairs and the log partition of each text, by scaled forward-backward over all texts at once."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    n, start = n[order], offsets[:-1][order]
    good = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    u, m = np.stack([1 - good, good], axis=1), np.exp(trans)
    alpha, beta, scale = np.zeros_like(u), np.ones_like(u), np.ones(len(u))
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(steps), "left")
    for t in range(steps):
        at = start[: active[t]] + t
        a = u[at] * (alpha[at - 1] @ m if t else 0.5)
        scale[at] = c = a.sum(axis=1)
        alpha[at] = a / c[:, None]
    pairs = np.zeros((len(n), 2, 2))
    for t in range(steps - 2, -1, -1):
        at = start[: active[t + 1]] + t
        ahead = u[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = ahead @ m.T
        pairs[: len(at)] += alpha[at][:, :, None] * m * ahead[:, None, :]
    post = alpha * beta
    back = np.empty_like(pairs)
    back[order] = pairs
    log_z = np.add.reduceat(np.log(scale), offsets[:-1]) if len(n) else np.zeros(0)
    return post[:, 1] / post.sum(axis=1), back, log_z


@dataclass(frozen=True)
class LineModel:
    common: tuple[str, ...]
    weights: np.ndarray
    trans: np.ndarray
    prior: float | None = None

    def scores(self, text: pa.Array) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(text), self.prior)
        if not len(text):
            return np.zeros(0)
        offsets, x, weight = features(text, self.common)
        good, *_ = marginals(offsets, x @ self.weights, self.trans)
        total = np.add.reduceat(weight, offsets[:-1])
        return np.clip(np.add.reduceat(good * weight, offsets[:-1]) / total, 0, 1)


def sample_labels(labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", rows: int = 4000) -> DataFrame:
    """``doc_id`` and ``label`` of the ``rows`` labelled rows with the smallest hash of their id: the only bound on what the classifier learns from."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias(label)).where(F.col(label).isin(0, 1))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(rows)


def likelihood_of(offsets: np.ndarray, own: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Sum over texts of the log likelihood by line and its gradient (52 numbers and more: value, weights, transitions); a text weighs 1 whatever its length."""
    x, n = with_neighbours(offsets, own), np.diff(offsets)
    w, trans = theta[:-4], theta[-4:].reshape(2, 2)
    logit = x @ w
    good, pairs, log_z = marginals(offsets, logit, trans)
    label = np.repeat(y, n)
    path = -np.logaddexp(0, np.where(label == 1, -1, 1) * np.clip(logit, -40, 40))
    tied = np.zeros((len(n), 2, 2))
    tied[np.arange(len(n)), y, y] = n - 1
    value = (np.add.reduceat(path, offsets[:-1]) + (n - 1) * trans[y, y] + np.log(0.5) - log_z) / n
    return np.concatenate([[value.sum()], (np.repeat(1 / n, n) * (label - good)) @ x, ((tied - pairs) / n[:, None, None]).sum(axis=0).ravel()])


def ascend(gain, theta: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Maximise ``gain`` (value and gradient of theta) by limited-memory BFGS with halved steps; each call of ``gain`` is one pass over the data."""
    value, grad = gain(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    rate = 1.0
    for _ in range(steps - 1):
        if np.abs(grad).max() < 1e-6:
            break
        q, alphas = grad.copy(), []
        for s, g in reversed(past):
            alphas.append(a := (s @ q) / (s @ g))
            q -= a * g
        if past:
            s, g = past[-1]
            q *= (s @ g) / (g @ g)
        for (s, g), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - (g @ q) / (s @ g))
        move = q if past else q / max(1.0, np.abs(q).max())
        to = theta + rate * move
        new, new_grad = gain(to)
        if new < value:
            rate /= 4
            continue
        s, g = to - theta, grad - new_grad
        if s @ g > 1e-12:
            past = [*past[1 - memory :], (s, g)]
        theta, value, grad, rate = to, new, new_grad, 1.0
    return theta


def fit(
    labelled: DataFrame, *, text: str = "text", label: str = "quality", common_words: int = 100, steps: int = 50,
    ridge: float = 1e-4, tie: float = 0.01, tasks: int = 16,
) -> LineModel:
    """Fit on every row of ``labelled`` (bound it with ``sample_labels``), whole texts of any length.

    Features are made once and written; each of at most ``steps`` passes sums likelihood and gradient in ``tasks``
    tasks, so the driver holds a few hundred bytes for each.
    """
    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            found = pc.value_counts(words(texts(table))[1])
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])

    rows = materialize(rows.repartition(tasks))
    have = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(have) < 2:
        return LineModel((), np.zeros(3 * len(BASE)), np.zeros((2, 2)), float(next(iter(have), 1)))
    top = rows.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(common_words)
    common = tuple(r["word"] for r in top.collect())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            offsets, own, _ = own_features(texts(table), common)
            made = (np.diff(offsets).astype("<i4"), table.column("y").to_numpy().astype("<i4"), own.astype("<f4"))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in made], names=["n", "y", "own"])

    described = materialize(rows.mapInArrow(describe, "n binary, y binary, own binary"))
    width, total = 3 * len(BASE), sum(have.values())

    def gain(theta: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(1 + width + 4)
            for batch in batches:
                for n, y, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(n, "<i4"))]).astype(np.int64)
                    out += likelihood_of(offsets, np.frombuffer(own, "<f4").reshape(-1, len(BASE)).astype(np.float64), np.frombuffer(y, "<i4"), theta)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        parts = described.mapInArrow(run, "sums binary").collect()  # a row for each task
        sums = np.sum([np.frombuffer(r["sums"]) for r in parts], axis=0) / total
        lean = np.concatenate([np.full(width, ridge), np.full(4, tie)])
        return float(sums[0] - (lean * theta * theta).sum() / 2), sums[1:] - lean * theta

    theta = ascend(gain, np.zeros(width + 4), steps)
    return LineModel(common, theta[:width], theta[width:].reshape(2, 2))


def score(docs: DataFrame, model: LineModel, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold, else 0)."""
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, text):
            s = model.scores(texts(table, text))
            yield from table.append_column("score", pa.array(s)).append_column("predicted", pa.array((s >= threshold).astype(np.int32))).combine_chunks().to_batches()

    return docs.mapInArrow(run, schema)


def label_lines(docs: DataFrame, model: LineModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: ``doc_id``, ``line`` (from 0), ``good`` (marginal), ``label`` (good or bad)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("line long, good double, label string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            offsets, x, _ = features(texts(table), model.common)
            good, *_ = marginals(offsets, x @ model.weights, model.trans)
            of = owner(offsets)
            label = pa.array(np.where(good >= 0.5, "good", "bad").tolist(), pa.string())
            ids = table.column("doc_id").combine_chunks().take(pa.array(of))
            yield from pa.Table.from_arrays([ids, pa.array(np.arange(len(of)) - offsets[:-1][of]), pa.array(good), label], names=["doc_id", "line", "good", "label"]).to_batches()

    return rows.mapInArrow(run, schema)
