"""Hidden Markov language model over words, trained by Baum-Welch on the whole training corpus.

The model emits classes: the most frequent words are classes of their own, other words fall into classes by their
ending, and the end of a text is a class. Within an ending class a word has probability
(c + 1) / (N_class + V_class + 1), c being its training count. Each round of Baum-Welch reads every training
document; a task sums its expected counts and Spark adds them up by class. The likelihood of a text is exact, by the scaled
forward recursion over all of its words.

Word counts of the corpus grow with it and are never broadcast whole: the ``head`` most frequent words are (bounded
in number and bytes), and the counts of all other words reach the documents by a join.

Rules for odd input: null text counts as empty, that is just an end; rows of equal id and text are scored each;
with no training rows N and V are 0, and the score is the base score; other columns are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import PIECE_BYTES, head_rows, materialize, owner, pieces, shared_dir, texts, words

ENDINGS = 64
#: Parts of the corpus in the first round of training.
SLICES = 8
#: Words kept in tasks are no longer than this many bytes.
HEAD_BYTES = 64


def ending_class(words_: pa.Array) -> np.ndarray:
    """The class of each word's last two characters; each distinct ending is hashed once."""
    ends = pc.utf8_slice_codeunits(words_, -2).dictionary_encode()
    kinds = np.fromiter((zlib.crc32(w.encode()) % ENDINGS for w in ends.dictionary.to_pylist()), np.int64, len(ends.dictionary))
    return kinds[ends.indices.to_numpy(zero_copy_only=False)]


@dataclass(frozen=True)
class Lexicon:
    """Frequent words with their counts, class sizes, and totals of the training tokens (ends included)."""

    head: tuple[str, ...]
    head_counts: np.ndarray
    own: int
    class_tokens: np.ndarray
    class_types: np.ndarray
    tokens: int
    types: int
    texts: int

    @property
    def classes(self) -> int:
        return self.own + ENDINGS + 1

    @property
    def end(self) -> int:
        return self.own + ENDINGS

    def unigram(self) -> np.ndarray:
        """Smoothed share of each class."""
        n = np.concatenate([self.head_counts[: self.own], self.class_tokens, [self.texts]]).astype(np.float64) + 1
        return n / n.sum()


def word_counts(train: DataFrame) -> DataFrame:
    """``word`` and its count ``c`` over all rows of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            counted = pc.value_counts(words(texts(table))[1])
            yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.string()), counted.field("counts")], names=["word", "c"])

    return materialize(train.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))


def lexicon(counts: DataFrame, n_texts: int, *, head: int = 1 << 17, own: int = 1 << 13) -> Lexicon:
    """The bounded part of the counts: at most ``head`` words of at most HEAD_BYTES bytes, of which ``own`` are classes."""
    top = head_rows(counts.where(F.octet_length("word") <= HEAD_BYTES), "c", head).orderBy(F.desc("c"), "word").toArrow()
    names, n = top.column("word").to_pylist(), top.column("c").to_numpy()
    own = min(own, len(names))
    session = counts.sparkSession
    own_words = F.broadcast(session.createDataFrame([(w,) for w in names[:own]], "word string"))
    ending = (F.crc32(F.encode(F.substring("word", -2, 2), "UTF-8")) % ENDINGS).cast("int")
    rest = counts.join(own_words, "word", "left_anti").groupBy(ending.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    tokens, types = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in rest:
        tokens[r["k"]], types[r["k"]] = r["n"], r["v"]
    total = int(n[:own].sum()) + int(tokens.sum())
    return Lexicon(tuple(names), np.array(n, np.int64), own, tokens, types, total + n_texts, own + int(types.sum()) + (n_texts > 0), n_texts)


def observed(text: pa.Array, lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Offsets and classes (with ends) of each text; then word offsets, codes, distinct words, and their place in the head or -1."""
    offsets, flat = words(text)
    coded = flat.dictionary_encode()
    distinct, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place = pc.fill_null(pc.index_in(distinct, pa.array(lex.head, pa.large_string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    kind = np.where((place >= 0) & (place < lex.own), place, lex.own + ending_class(distinct))
    full = offsets + np.arange(len(offsets))
    classes = np.full(full[-1], lex.end, np.int32)
    classes[np.arange(len(codes)) + owner(offsets)] = kind[codes]
    return full, classes, offsets, codes, distinct, place


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray  # classes x states

    @classmethod
    def first(cls, lex: Lexicon, states: int) -> Hmm:
        random = np.random.default_rng(11)
        emit = lex.unigram()[:, None] * (0.5 + random.random((lex.classes, states)))
        trans = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), trans, emit / emit.sum(axis=0))


def groups(offsets: np.ndarray, room: int = 300_000) -> Iterator[np.ndarray]:
    """Rows by falling length, in groups of about ``room`` values."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    cut = np.cumsum(n[order]) // room
    yield from np.split(order, np.flatnonzero(np.diff(cut)) + 1) if len(order) else []


def forward(model: Hmm, offsets: np.ndarray, obs: np.ndarray, rows: np.ndarray, kind: type = np.float64) -> tuple[np.ndarray, ...]:
    """Scaled forward recursion of the rows (by falling length) at once: natural log likelihoods, and what the way back needs.

    Values lie by step, then by row, so each step reads and writes one block.
    """
    n = np.diff(offsets)[rows]
    steps = int(n[0])
    active = np.searchsorted(-n, -np.arange(steps + 1), "left")
    base = np.concatenate([[0], np.cumsum(active[:-1])]).astype(np.int64)
    row, step = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    seen = np.empty(len(row), obs.dtype)
    seen[base[step] + row] = obs[np.repeat(offsets[:-1][rows], n) + step]
    emitted = model.emit.astype(kind)[seen]
    alpha, scale, trans = np.empty_like(emitted), np.empty(len(seen), kind), model.trans.astype(kind)
    before = model.start.astype(kind)[None]
    for t in range(steps):
        a = alpha[base[t] : base[t + 1]]
        np.multiply(before[: len(a)] @ trans if t else before, emitted[base[t] : base[t + 1]], out=a)
        c = a.sum(axis=1)
        scale[base[t] : base[t + 1]] = c
        a /= c[:, None]
        before = a
    total = np.bincount(np.arange(len(seen)) - np.repeat(base[:-1], active[:-1]), weights=np.log(scale.astype(np.float64)), minlength=len(n))
    return total, seen, emitted, alpha, scale, base


def likelihoods(model: Hmm, offsets: np.ndarray, obs: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each row's classes (each row has one at least)."""
    out = np.zeros(len(offsets) - 1)
    for rows in groups(offsets):
        out[rows] = forward(model, offsets, obs, rows)[0]
    return out


def expected(model: Hmm, offsets: np.ndarray, obs: np.ndarray, start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> None:
    """Add the expected counts of all rows to the three tables (each recursion in single precision, sums in double)."""
    for rows in groups(offsets):
        _, seen, emitted, alpha, scale, base = forward(model, offsets, obs, rows, np.float32)
        back = model.trans.T.astype(np.float32)
        emitted /= scale[:, None]
        beta, pairs = np.ones_like(alpha), np.zeros_like(trans)
        for t in range(len(base) - 3, -1, -1):
            n = base[t + 2] - base[t + 1]
            ahead = emitted[base[t + 1] : base[t + 2]] * beta[base[t + 1] : base[t + 2]]
            np.matmul(ahead, back, out=beta[base[t] : base[t] + n])
            pairs += alpha[base[t] : base[t] + n].T @ ahead
        trans += pairs * model.trans
        beta *= alpha
        start += beta[: base[1]].sum(axis=0)
        for k in range(beta.shape[1]):
            emit[:, k] += np.bincount(seen, weights=beta[:, k], minlength=len(emit))


def updated(lex: Lexicon, start: np.ndarray, trans: np.ndarray, emit: np.ndarray, weight: float = 200.0) -> Hmm:
    """The next model; emissions lean on the unigram shares by ``weight`` tokens."""
    emit = emit + weight * lex.unigram()[:, None]
    return Hmm((start + 1) / (start + 1).sum(), (trans + 1) / (trans + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def encode(docs: DataFrame, lex: Lexicon, *, doc_id: str = "doc_id", text: str = "text", train: Column | None = None, slices: int = SLICES) -> DataFrame:
    """What training and scoring need of each row, written once, so that no text is cut again.

    ``row`` numbers the rows. ``classes`` are packed as little-endian 32-bit numbers. ``known``, ``logs`` and ``inner`` are the
    sums over words of the head: tokens, log10 of their counts + 1, and log10 of the shares within their classes; ``rare``
    has all other words with their numbers. ``slice`` comes from the hash of the text, -1 where ``train`` isn't true.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    part = F.pmod(F.xxhash64(text), F.lit(slices)).cast("int")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (part if train is None else F.when(train, part).otherwise(-1)).alias("slice"))
    lexicon_ = spark.sparkContext.broadcast(lex)  # bounded by head * HEAD_BYTES
    schema = f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, classes binary, known long, logs double, inner double, rare array<struct<word: string, n: long>>, slice int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon_.value
        share = np.concatenate([np.zeros(lex.own), np.log10(lex.class_tokens + lex.class_types + 1), [0.0]])
        for table in pieces(batches, most=PIECE_BYTES // 2):
            offsets, obs, at, codes, distinct, place = observed(texts(table), lex)
            of, n, known = owner(at), table.num_rows, place >= 0
            log_count = np.zeros(len(place))
            log_count[known] = np.log10(lex.head_counts[place[known]] + 1)
            within = np.where(place >= lex.own, log_count, 0)  # within an ending class
            total = lambda x: np.bincount(of, weights=x[codes], minlength=n).astype(np.float64)
            rare, count = np.unique(of[~known[codes]] * max(1, len(distinct)) + codes[~known[codes]], return_counts=True)
            row, word = np.divmod(rare, max(1, len(distinct)))
            words_ = pa.StructArray.from_arrays([distinct.take(pa.array(word)).cast(pa.string()), pa.array(count.astype(np.int64))], names=["word", "n"])
            columns = {
                "row": table.column("row"), "doc_id": table.column("doc_id"),
                "classes": pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets * 4), pa.py_buffer(obs.astype("<i4"))]).cast(pa.binary()),
                "known": pa.array(total(known.astype(np.float64)).astype(np.int64)), "logs": pa.array(total(log_count)),
                "inner": pa.array(total(within) - np.add.reduceat(share[obs], offsets[:-1])),
                "rare": pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), words_), "slice": table.column("slice"),
            }
            yield from pa.table(columns).to_batches(max_chunksize=2000)

    rows.mapInArrow(run, schema).write.partitionBy("slice").parquet(path)
    return spark.read.schema(schema).parquet(path)


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of the column ``classes``."""
    packed = table.column("classes").combine_chunks().cast(pa.large_binary())
    lengths = pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    first = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset] // 4
    return offsets, np.frombuffer(packed.buffers()[2], "<i4")[first : first + offsets[-1]]


def baum_welch(train: DataFrame, lex: Lexicon, *, states: int = 10, slices: int = SLICES, passes: int = 2, power: float = 0.6) -> Hmm:
    """``fit`` over all texts of ``train``."""
    return fit(encode(train.select("text", F.lit(0).alias("doc_id")), lex, slices=slices), lex, states=states, slices=slices, passes=passes, power=power)


def fit(encoded: DataFrame, lex: Lexicon, *, states: int = 10, slices: int = SLICES, passes: int = 2, power: float = 0.6) -> Hmm:
    """Baum-Welch over all training rows of ``encoded``, every step in tasks.

    A first round takes the corpus in ``slices`` by the hash of the text, one for each step; the counts so far fade by
    (step + 2) ** -power, so all slices shape the start. Then come ``passes`` steps over the whole corpus at once.
    """
    model, classes = Hmm.first(lex, states), lex.classes
    columns = [f"s{k}" for k in range(states)]
    schema = "kind int, " + ", ".join(f"{c} double" for c in columns)

    def summed(rows: DataFrame, model: Hmm) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, trans, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
            for table in pieces(batches, "classes", PIECE_BYTES // 2):
                expected(model, *unpacked(table), start, trans, emit)
            some = np.flatnonzero(emit.sum(axis=1))
            table = np.concatenate([start[None], trans, emit[some]])
            kinds = np.concatenate([[-1], -2 - np.arange(states), some]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(table[:, k]) for k in range(states))], names=["kind", *columns])

        found = rows.select("classes").mapInArrow(run, schema).groupBy("kind").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
        kinds, table = found.column("kind").to_numpy(), np.stack([found.column(c).to_numpy() for c in columns], axis=1)
        start, trans, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
        start += table[kinds == -1].sum(axis=0)
        trans[-2 - kinds[kinds < -1]] = table[kinds < -1]
        emit[kinds[kinds >= 0]] = table[kinds >= 0]
        return [start, trans, emit]

    held: list[np.ndarray] | None = None
    for k in range(slices):
        new = summed(encoded.where(F.col("slice") == k), model)
        share = (k + 2) ** -power
        held = new if held is None else [(1 - share) * x + share * y for x, y in zip(held, new, strict=True)]
        model = updated(lex, *(slices * x for x in held))
    for _ in range(passes):
        model = updated(lex, *summed(encoded.where("slice >= 0"), model))
    return model


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, model: Hmm, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``score_encoded`` of all rows of ``docs``."""
    return score_encoded(encode(docs, lex, doc_id=doc_id, text=text), counts, lex, model)


def score_encoded(encoded: DataFrame, counts: DataFrame, lex: Lexicon, model: Hmm) -> DataFrame:
    """Per row ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10 probabilities)."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)  # bounded by classes * states
    kept = ["row", "doc_id", "known", "logs"]
    ids = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "classes", PIECE_BYTES // 2):
            offsets, obs = unpacked(table)
            hmm = likelihoods(shared.value, offsets, obs) / np.log(10) + table.column("inner").to_numpy()
            yield from table.select(kept).append_column("n_tokens", pa.array(np.diff(offsets))).append_column("hmm", pa.array(hmm)).to_batches()

    by_row = encoded.select(*kept, "inner", "classes").mapInArrow(run, f"row long, doc_id {ids}, known long, logs double, n_tokens long, hmm double")
    rare = encoded.select("row", F.inline("rare")).hint("merge").join(counts, "word")  # Spark splits frequent words
    sums = rare.groupBy("row").agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_logs"))
    joined = by_row.join(sums, "row", "left")
    tail_logs, tail_known = F.coalesce("tail_logs", F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    log_all, ends = float(np.log10(lex.tokens + lex.types + 1)), int(lex.texts > 0)
    base = F.col("logs") + tail_logs + F.lit(float(np.log10(lex.texts + 1))) - F.col("n_tokens") * log_all
    return joined.select("doc_id", "n_tokens", (F.col("known") + tail_known + ends).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("hmm") + tail_logs if lex.texts else base).alias("score"))
