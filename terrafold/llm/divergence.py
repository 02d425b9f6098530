"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with the references of each
language (learned from all documents of that language) by Jensen-Shannon distance; the nearest language
counts. Distances are only judged beyond minimum lengths, so short texts are not punished for sparse counts.

Rules for odd input: null text counts as empty (no words: fails the base rule); rows with a null language
teach nothing; without any reference every distance is 0; repeated rows are judged each on its own; input
columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.common import hashed, materialize, mix, owner, pieces, rolled, texts, words

SYMBOLS = b"#*$%&|<>"
#: Character classes: by byte; UTF-8 continuation bytes count with their first byte.
CLASSES = ("lower", "upper", "digit", "space", "newline", "blank", "punctuation", "symbol", "other", "wide")
WINDOW = 8


def _class_of_bytes() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"))
    for name, members in (
        ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", b" "), ("newline", b"\n"),
        ("blank", b"\t\v\f\r"), ("punctuation", b".,;:!?'\"()-"), ("symbol", SYMBOLS), ("wide", range(192, 256)),
    ):
        table[list(members)] = CLASSES.index(name)
    table[128:192] = len(CLASSES)
    return table.astype(np.uint8)


CLASS_OF_BYTE = _class_of_bytes()


def class_counts(text: pa.Array) -> np.ndarray:
    """Code points of each text by character class."""
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    kinds = CLASS_OF_BYTE[raw[at[0] : at[-1]]]
    at = at - at[0]
    out = np.zeros((len(text), len(CLASSES) + 1), np.int64)
    for k in range(len(text)):
        out[k] = np.bincount(kinds[at[k] : at[k + 1]], minlength=len(CLASSES) + 1)
    return out[:, : len(CLASSES)]


def repeated_words(offsets: np.ndarray, flat: pa.Array) -> np.ndarray:
    """Per text the words inside 8-word windows that the text holds at least twice."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.int64)
    h, codes, _ = hashed(flat)
    if len(h) < WINDOW:
        return out
    text = owner(offsets)
    whole = np.flatnonzero(np.arange(len(h)) + WINDOW <= offsets[1:][text])
    key = mix(rolled(h, WINDOW)[whole] ^ mix(text[whole].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key, start = key[order], whole[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    a, b = start[same], start[same + 1]
    true = text[a] == text[b]
    for k in range(WINDOW):
        true &= codes[a + k] == codes[b + k]
    covered = np.zeros(len(h) + 1, np.int64)
    if true.all():
        hit = np.zeros(len(whole), bool)
        hit[same] = hit[same + 1] = True
        hit = start[hit]
    else:  # a clash of hashes: compare the windows themselves
        seen: dict[tuple, list[int]] = {}
        for s in np.unique(np.concatenate([a, b])):
            seen.setdefault((text[s], *codes[s : s + WINDOW]), []).append(s)
        hit = np.array([s for x in seen.values() if len(x) > 1 for s in x], np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + WINDOW, -1)
    return np.bincount(text[np.cumsum(covered[:-1]) > 0], minlength=len(n)).astype(np.int64)


def repeated_lines(text: pa.Array) -> np.ndarray:
    r"""Per text the \n-split lines that hold a word and equal an earlier line."""
    split = pc.split_pattern(text, "\n")
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets, flat = offsets - offsets[0], split.flatten()
    coded = flat.dictionary_encode()
    real = pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)).to_numpy(zero_copy_only=False) > 0
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(codes):
        return np.zeros(len(text), np.int64)
    line, codes = owner(offsets)[real[codes]], codes[real[codes]]
    first = np.unique(line * max(1, len(real)) + codes) // max(1, len(real))
    return np.bincount(line, minlength=len(text)) - np.bincount(first, minlength=len(text))


@dataclass(frozen=True)
class References:
    """Per language the shares of character classes, and of the common words of all languages (last: any other word)."""

    languages: tuple[str, ...]
    vocabulary: tuple[str, ...]
    characters: np.ndarray
    common: np.ndarray


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", common_words: int = 64) -> References:
    """References from every document of a known language; the result has at most ``common_words`` words of each language, however many languages there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text"):
            langs = table.column("lang").combine_chunks().dictionary_encode()
            langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
            of, names, column = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), langs.dictionary.to_pylist(), texts(table)
            chars = class_counts(column)
            offsets, flat = words(column)
            flat_codes = flat.dictionary_encode()
            codes, vocabulary = flat_codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat_codes.dictionary
            owners = of[owner(offsets)]
            for k, name in enumerate(names):
                sums = chars[of == k].sum(axis=0)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(CLASSES)), "kind": pa.array(["c"] * len(CLASSES)), "word": pa.array(list(CLASSES)), "n": pa.array(sums, pa.int64())})
                n = np.bincount(codes[owners == k], minlength=len(vocabulary))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(some), pa.string()), "kind": pa.array(["w"] * len(some), pa.string()), "word": vocabulary.take(pa.array(some)).cast(pa.string()), "n": pa.array(n[some], pa.int64())})

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null")
    counts = rows.mapInArrow(count, "lang string, kind string, word string, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rn", F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.desc("n"), "word")))
    total = counts.where("kind = 'w'").groupBy("lang").agg(F.sum("n").alias("n"))
    limit = max(common_words, len(CLASSES))
    kept = materialize(ranked.where(f"rn <= {limit}").select("lang", "kind", "word", "n").unionByName(total.select("lang", F.lit("t").alias("kind"), F.lit("").alias("word"), "n")))
    found = kept.collect()
    names = tuple(sorted({r["lang"] for r in found}))
    vocabulary = tuple(sorted({r["word"] for r in found if r["kind"] == "w"}))
    at, place = {x: k for k, x in enumerate(names)}, {x: k for k, x in enumerate(vocabulary)}
    characters, common = np.zeros((len(names), len(CLASSES))), np.zeros((len(names), len(vocabulary) + 1))
    for r in found:
        if r["kind"] == "c":
            characters[at[r["lang"]], CLASSES.index(r["word"])] = r["n"]
        elif r["kind"] == "w":
            common[at[r["lang"]], place[r["word"]]] = r["n"]
        else:
            common[at[r["lang"]], -1] += r["n"]
    common[:, -1] -= common[:, :-1].sum(axis=1)
    share = lambda x: x / np.maximum(x.sum(axis=1, keepdims=True), 1)
    return References(names, vocabulary, share(characters), share(common))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of p to each row of q; rows sum to 1, or are all 0 (then 0)."""
    out = np.zeros((len(p), len(q)))
    for k, ref in enumerate(q):
        m = (p + ref) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
            b = np.where(ref > 0, ref * np.log2(ref / m), 0).sum(axis=1)
        out[:, k] = np.where(p.sum(axis=1) > 0, np.sqrt(np.clip((a + b) / 2, 0, 1)), 0)
    return out


ADDED = (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
    ("nearest", T.StringType()), ("char_distance", T.DoubleType()), ("word_distance", T.DoubleType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()),
)


def judge(
    docs: DataFrame, references: References, *, text: str = "text", max_char_distance: float = 0.25,
    max_word_distance: float = 0.385, min_chars: int = 400, min_words: int = 100,
) -> DataFrame:
    """Add the base counts, the nearest language with both distances, ``base_failed`` and ``kept``.

    Characters are judged from ``min_chars`` code points on, words from ``min_words`` words on.
    """
    docs = docs.drop(*(n for n, _ in ADDED))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in ADDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(references.vocabulary, pa.large_string())
        width = len(references.vocabulary) + 1
        for table in pieces(batches, text):
            column = texts(table, text)
            chars = class_counts(column)
            offsets, flat = words(column)
            n = np.diff(offsets)
            blank = [CLASSES.index(x) for x in ("space", "newline", "blank")]
            repeats = repeated_words(offsets, flat)
            codes = pc.fill_null(pc.index_in(flat, vocabulary), width - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            nearest, far_c, far_w = np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
            step = max(1, min(512, (1 << 22) // width))  # bounds the dense histograms
            for lo in range(0, len(n), step):
                hi = min(lo + step, len(n))
                hist = np.bincount(np.repeat(np.arange(hi - lo), n[lo:hi]) * width + codes[offsets[lo] : offsets[hi]], minlength=(hi - lo) * width).reshape(hi - lo, width)
                if not references.languages:
                    continue
                dc = distance(chars[lo:hi] / np.maximum(chars[lo:hi].sum(axis=1, keepdims=True), 1), references.characters)
                dw = distance(hist / np.maximum(n[lo:hi, None], 1), references.common)
                nearest[lo:hi] = best = np.argmin(dc + dw, axis=1)
                far_c[lo:hi], far_w[lo:hi] = dc[np.arange(hi - lo), best], dw[np.arange(hi - lo), best]
            total = chars.sum(axis=1)
            failed = (n < 20) | (100 * repeats > 30 * n)
            odd = ((total >= min_chars) & (far_c > max_char_distance)) | ((n >= min_words) & (far_w > max_word_distance))
            names = [references.languages[k] for k in nearest] if references.languages else [None] * len(n)
            made = (n, total - chars[:, blank].sum(axis=1), chars[:, CLASSES.index("symbol")], repeated_lines(column), repeats, names, far_c, far_w, failed, ~failed & ~odd)
            kinds = (pa.int64(),) * 5 + (pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_())
            for (name, _), values, kind in zip(ADDED, made, kinds, strict=True):
                table = table.append_column(name, pa.array(values, kind))
            yield from table.combine_chunks().to_batches()

    return docs.mapInArrow(run, schema)
