"""Operator 13: source divergence audit by chunk factorization.

A document's text is cut at ASCII whitespace, and its chunks are counted. Chunks are brought together by their hash, and
every chunk that is distinct over the whole corpus is cut into terms once; the terms take over the chunk's occurrences
and documents and are brought together by their own hash, where both are added up. Sources of a language are then
compared with each other and with the language by smoothed shares, in whole numbers.

A term may be spelled by several chunks of one document, so numbers of documents can't just be added. A count of
documents goes up to three, and while it is below three its documents are known (the least and the largest number), so
unions are exact; that is why ``min_docs`` is three at most.

Rules for odd input: null text, language and source are read as ''. A document is a row; repeated rows are documents of
their own. A group of a language and a source counts if any row has it, also one without terms. A chunk without a term
counts nothing. Ties of values go to the item that is smaller in UTF-8. An empty table gives an empty table. Other
columns are ignored. Documents are numbered as they are read, so ``docs`` should come from a table, whose tasks read the
same rows when they run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.llm.common import hashed, materialize, owner, pieces, texts, words

NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SHARE = 1_000_000_000
#: Entries that a task of the first step merges before it gives them away, and numbers that one of a later step holds.
HELD = 1 << 19
#: Most groups (a language and a source); the result has a row for each two of a language.
MAX_GROUPS = 1 << 20
FULL = 3


class Entries(NamedTuple):
    """Keys (chunks or terms) and, of each key and group in the order of keys, occurrences and documents."""

    keys: pa.Array
    key: np.ndarray
    group: np.ndarray
    occurrences: np.ndarray
    documents: np.ndarray  # up to FULL
    low: np.ndarray  # the documents' numbers, if there are fewer
    high: np.ndarray


def merged(e: Entries, groups: int) -> Entries:
    """One entry for each key and group; documents are united."""
    cell = e.key * groups + e.group
    order = np.argsort(cell, kind="stable")
    cell, occurrences, documents, low, high = (x[order] for x in (cell, *e[3:]))
    new = np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)]
    first = np.flatnonzero(new)
    if len(first) == len(cell):
        return Entries(e.keys, cell // groups, cell % groups, occurrences, documents, low, high)
    least, most, back = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.cumsum(new) - 1
    between = ((low > least[back]) & (low < most[back])) | ((high > least[back]) & (high < most[back]))
    full = np.logical_or.reduceat(between | (documents >= FULL), first)
    documents = np.where(full, FULL, 1 + (most > least))
    return Entries(e.keys, cell[first] // groups, cell[first] % groups, np.add.reduceat(occurrences, first), documents, np.where(full, 0, least), np.where(full, 0, most))


def joined(parts: list[Entries], groups: int) -> Entries:
    """Several tables of entries as one, merged."""
    if not parts:
        return Entries(pa.array([], pa.large_string()), *(np.zeros(0, np.int64) for _ in range(6)))
    if len(parts) == 1:
        return merged(parts[0], groups)
    coded = pa.concat_arrays([p.keys for p in parts]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum([len(p.keys) for p in parts])])
    key = code[np.concatenate([p.key + a for p, a in zip(parts, at, strict=False)])]
    return merged(Entries(coded.dictionary, key, *(np.concatenate([p[k] for p in parts]) for k in range(2, 7))), groups)


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte planes, which compress well where numbers are small."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    end = at + 8 * n
    return np.ascontiguousarray(np.frombuffer(data[at:end], np.uint8).reshape(8, n).T).view("<u8").ravel().astype(np.int64), end


def packed(e: Entries, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The entries of each bucket of keys, as bytes. Entries must be in the order of keys."""
    bucket = (hashed(e.keys)[0] % np.uint64(buckets)).astype(np.int64) if len(e.keys) else np.zeros(0, np.int64)
    order = np.argsort(bucket, kind="stable")
    keys = e.keys.take(pa.array(order))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rows = np.argsort(place[e.key], kind="stable")
    columns = [x[rows] for x in e[2:]]
    per_key = np.bincount(place[e.key], minlength=len(order))
    key_at, row_at = np.searchsorted(bucket[order], np.arange(buckets + 1)), None
    row_at = np.concatenate([[0], np.cumsum(per_key)])[key_at]
    offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1] if len(keys) else np.zeros(1, np.int64)
    body = keys.buffers()[2]
    press = zstandard.ZstdCompressor(level=1)
    for b in np.flatnonzero(np.diff(key_at)).tolist():
        k, m, r, s = int(key_at[b]), int(key_at[b + 1]), int(row_at[b]), int(row_at[b + 1])
        head = np.array([m - k, s - r], "<u8").tobytes()
        text = body[int(offsets[k]) : int(offsets[m])].to_pybytes() if body is not None else b""
        yield b, press.compress(b"".join([head, _planes(np.diff(offsets[k : m + 1])), _planes(per_key[k:m]), *(_planes(c[r:s]) for c in columns), text]))


def unpacked(data: bytes) -> Entries:
    data = zstandard.ZstdDecompressor().decompress(data)
    n, m = (int(x) for x in np.frombuffer(data[:16], "<u8"))
    lengths, at = _numbers(data, n, 16)
    per_key, at = _numbers(data, n, at)
    columns = []
    for _ in range(5):
        column, at = _numbers(data, m, at)
        columns.append(column)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    keys = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data[at:]))
    return Entries(keys, np.repeat(np.arange(n), per_key), *columns)


PACKED = "bucket int, entries binary"


def _rows(parts: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for b, data in parts:
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "entries"])


class Collected:
    """Entries of a task, merged each time that they have doubled."""

    def __init__(self, groups: int) -> None:
        self.groups, self.parts, self.size, self.limit = groups, [], 0, HELD

    def add(self, e: Entries) -> None:
        self.parts.append(e)
        self.size += len(e.key)
        if self.size > self.limit and len(self.parts) > 1:
            self.parts = [joined(self.parts, self.groups)]
            self.size = len(self.parts[0].key)
            self.limit = max(HELD, 2 * self.size)

    def take(self) -> Entries:
        out = joined(self.parts, self.groups)
        self.parts, self.size, self.limit = [], 0, HELD
        return out


def piece_chunks(table: pa.Table, group: np.ndarray, first: int) -> Entries:
    """Chunks of a piece's documents, which have the numbers from ``first`` on, counted by document and then by group."""
    offsets, flat = words(texts(table), lower=False)
    coded = flat.dictionary_encode()
    n = max(1, table.num_rows)
    pair, times = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + owner(offsets), return_counts=True)
    doc = pair % n
    one = np.ones(len(pair), np.int64)
    return Entries(coded.dictionary.cast(pa.large_string()), pair // n, group[doc] if len(group) else doc, times.astype(np.int64), one, doc + first, doc + first)


def chunk_terms(e: Entries) -> Entries:
    """Every distinct chunk cut into its terms, which take over its entries."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(e.keys), NO_TERM, " ")
    at, terms = words(spaced, lower=False)
    coded = terms.dictionary_encode()
    code, many = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at)[e.key]
    row = np.repeat(np.arange(len(e.key)), many)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return Entries(coded.dictionary.cast(pa.large_string()), code[at[e.key][row] + inside], *(x[row] for x in e[2:]))


class Groups(NamedTuple):
    """All groups in order of language and source, the number of each's language, and where each language begins."""

    names: list[tuple[str, str]]
    lang: np.ndarray
    begins: np.ndarray

    @classmethod
    def of(cls, docs: DataFrame) -> Groups:
        found = docs.select("lang", "source").distinct()
        names = sorted((r["lang"], r["source"]) for r in found.limit(MAX_GROUPS + 1).collect())
        if len(names) > MAX_GROUPS:
            raise ValueError(f"more than {MAX_GROUPS} groups of a language and a source")
        langs = sorted({n[0] for n in names})
        number = {x: k for k, x in enumerate(langs)}
        lang = np.array([number[n[0]] for n in names], np.int64)
        return cls(names, lang, np.searchsorted(lang, np.arange(len(langs) + 1)))


TERMS = "lang int, term string, groups array<int>, counts array<long>, in_lang long"


def term_counts(docs: DataFrame, groups: Groups, min_docs: int) -> DataFrame:
    """From ``text, lang, source`` (no nulls): a row for each language and term in at least ``min_docs`` of its documents, with the groups that have it."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, n_groups = 4 * parts, max(1, len(groups.names))
    number = {name: k for k, name in enumerate(groups.names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = TaskContext.get().partitionId() << 40, Collected(n_groups)
        for table in pieces(batches):
            named = zip(table.column("lang").to_pylist(), table.column("source").to_pylist(), strict=True)
            held.add(merged(piece_chunks(table, np.array([number[x] for x in named], np.int64), first), n_groups))
            first += table.num_rows
            if held.size > HELD:
                yield from _rows(packed(held.take(), buckets))
        if held.parts:
            yield from _rows(packed(held.take(), buckets))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Collected(n_groups)
        for batch in batches:
            for data in batch.column("entries"):
                held.add(unpacked(data.as_py()))
        if held.parts:
            yield from _rows(packed(merged(chunk_terms(held.take()), n_groups), buckets))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Collected(n_groups)
        for batch in batches:
            for data in batch.column("entries"):
                held.add(unpacked(data.as_py()))
        if held.parts:
            yield from kept_terms(held.take(), groups, min_docs)

    chunks = docs.mapInArrow(count, PACKED).repartition(parts, "bucket")
    return chunks.mapInArrow(cut, PACKED).repartition(parts, "bucket").mapInArrow(gather, TERMS)


def kept_terms(e: Entries, groups: Groups, min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows of the languages' terms with enough documents; each document is of one group, so counts of groups add up."""
    if not len(e.key):
        return
    cell = e.key * (int(groups.lang.max()) + 1) + groups.lang[e.group]  # entries are in order of key and group, so of this too
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    keep = np.add.reduceat(e.documents, first) >= min_docs
    total = np.add.reduceat(e.occurrences, first)
    length = np.diff(np.concatenate([first, [len(cell)]]))
    rows = np.repeat(keep, length)
    group, count = e.group[rows], e.occurrences[rows]
    first, length, total = first[keep], length[keep], total[keep]
    at = np.concatenate([[0], np.cumsum(length)])
    for lo in range(0, len(first), 50_000):
        hi = min(len(first), lo + 50_000)
        ends = pa.array(at[lo : hi + 1] - at[lo], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[at[lo] : at[hi]], kind)) for x, kind in ((group, pa.int32()), (count, pa.int64()))]
        columns = [pa.array(groups.lang[e.group[first[lo:hi]]], pa.int32()), e.keys.take(pa.array(e.key[first[lo:hi]])).cast(pa.string()), *lists, pa.array(total[lo:hi], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "groups", "counts", "in_lang"])


class Sizes(NamedTuple):
    """Occurrences of kept terms by group and by language, and kept terms by language."""

    group: np.ndarray
    lang: np.ndarray
    kept: np.ndarray

    @classmethod
    def of(cls, terms: DataFrame, groups: Groups) -> Sizes:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, v = np.zeros(len(groups.names), np.int64), np.zeros(len(groups.begins) - 1, np.int64)
            for batch in batches:
                np.add.at(n, batch.column("groups").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
                np.add.at(v, batch.column("lang").to_numpy(), 1)
            columns = [pa.array(np.concatenate([np.zeros(len(n)), np.ones(len(v))]), pa.int32()), pa.array(np.concatenate([np.arange(len(n)), np.arange(len(v))]), pa.int32()), pa.array(np.concatenate([n, v]), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "at", "n"])

        n, v = np.zeros(len(groups.names), np.int64), np.zeros(len(groups.begins) - 1, np.int64)
        for r in terms.mapInArrow(run, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
            (v if r["kind"] else n)[r["at"]] = r["n"]
        lang = np.zeros(len(v), np.int64)
        np.add.at(lang, groups.lang, n)
        return cls(n, lang, v)


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / whole), exact; ``whole`` is occurrences and kept terms."""
    if int(count.max(initial=0)) + 1 < (1 << 63) // SHARE:
        return 1 + SHARE * (count + 1) // whole
    return (1 + SHARE * (count.astype(object) + 1) // whole.astype(object)).astype(np.int64)


def pair_sums(terms: DataFrame, groups: Groups, sizes: Sizes) -> DataFrame:
    """``own``, ``other`` (groups of a language) and the sum over its terms of floor((p-q)^2 / q); a task gives one sum for each pair."""

    def given(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))], names=["own", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_numpy()
            for lang in np.unique(langs).tolist():
                mine = batch.filter(pa.array(langs == lang))
                begin, end = int(groups.begins[lang]), int(groups.begins[lang + 1])
                whole = sizes.group[begin:end] + sizes.kept[lang]
                step = max(1, HELD // (end - begin))
                for lo in range(0, mine.num_rows, step):
                    part = mine.slice(lo, step)
                    row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("groups")).to_numpy(zero_copy_only=False))
                    table = np.zeros((part.num_rows, end - begin), np.int64)
                    table[row, part.column("groups").flatten().to_numpy() - begin] = part.column("counts").flatten().to_numpy()
                    q = shares(table, np.broadcast_to(whole, table.shape))
                    for own in range(end - begin):
                        away = q[:, own : own + 1] - q
                        sums = (away * away // q).sum(0)
                        held[begin + own] = held[begin + own] + sums if begin + own in held else sums
                        if sum(map(len, held.values())) > HELD:
                            yield given(held)
                            held = {}
        if held:
            yield given(held)

    sums = terms.mapInArrow(run, "own int, sums array<long>").select("own", F.posexplode("sums").alias("at", "value")).groupBy("own", "at").agg(F.sum("value").alias("value"))
    begins = numbered(terms.sparkSession, groups).select(F.col("number").alias("own"), "begin")
    return sums.join(begins, "own").select("own", (F.col("begin") + F.col("at")).alias("other"), "value")


def numbered(spark, groups: Groups) -> DataFrame:
    """``number``, ``lang``, ``source``, and ``begin``, the first number of the language."""
    rows = [(k, a, b, int(groups.begins[groups.lang[k]])) for k, (a, b) in enumerate(groups.names)]
    return spark.createDataFrame(rows, "number int, lang string, source string, begin int")


def leading_terms(terms: DataFrame, groups: Groups, sizes: Sizes, top: int) -> DataFrame:
    """``own``, ``item``, ``value`` of terms that a group has more of than its language; of each group the ``top`` of every task, which hold those of all."""

    def best(tables: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(tables).combine_chunks()
        t = t.take(pc.sort_indices(t, [("own", "ascending"), ("value", "descending"), ("item", "ascending")]))
        own = t.column("own").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
        place = np.arange(len(own)) - np.repeat(first, np.diff(np.concatenate([first, [len(own)]])))
        return t.filter(pa.array(place < top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            lang, in_lang = batch.column("lang").to_numpy(), batch.column("in_lang").to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("groups")).to_numpy(zero_copy_only=False))
            group, count = batch.column("groups").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            p = shares(count, sizes.group[group] + sizes.kept[lang[row]])
            q = shares(in_lang, sizes.lang[lang] + sizes.kept[lang])[row]
            more = np.flatnonzero(p > q)
            away = p[more] - q[more]
            held.append(pa.table({"own": pa.array(group[more], pa.int32()), "item": batch.column("term").take(pa.array(row[more])), "value": pa.array(away * away // q[more], pa.int64())}))
            size += len(more)
            if size > HELD:
                held = [best(held)]
                size = held[0].num_rows
        if held:
            yield from best(held).to_batches(max_chunksize=50_000)

    return terms.mapInArrow(run, "own int, item string, value long")


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how each source differs from every other of its
    language (part ``pair``), and the ``top`` terms that it has more of than the language (part ``term``).
    """
    if not 1 <= min_docs <= FULL:
        raise ValueError(f"min_docs must be 1 to {FULL}")
    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    groups = Groups.of(clean)
    known = numbered(docs.sparkSession, groups)
    terms = materialize(term_counts(clean, groups, min_docs))
    sizes = Sizes.of(terms, groups)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    a, b = known.select("lang", "source", F.col("number").alias("own")), known.select("lang", F.col("source").alias("item"), F.col("number").alias("other"))
    pairs = a.join(b, "lang").where("own <> other").join(pair_sums(terms, groups, sizes), ["own", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")).withColumn("rank", F.row_number().over(order))
    leading = leading_terms(terms, groups, sizes, top).join(a, "own").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    return pairs.unionByName(leading.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
