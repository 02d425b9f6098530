"""Token files: one concatenated id array in document order, its document ends as Elias-Fano lists.

Documents are range-partitioned and sorted by doc_id, each task encodes its range with the tokenizers library and
writes segments. A segment row holds ``part`` (place of the range in the order), ``start_in_part`` (ids of the
range before it), the ids as fixed-width little-endian integers (2 bytes if the vocabulary allows, else 4), and two
Elias-Fano lists with select structures: the ends of its documents, and their doc_ids less the first. The only table
of 64-bit offsets has one number for each range, not for each document. ``find`` looks single documents up: the first
and last doc_id of the segments, which the reader prunes by, then select on the two lists.

Rules for odd input: doc_id must be an integer column; null text counts as empty (just the end id); null doc_ids come
first, in segments of their own; equal doc_ids are ordered by the hash of their text; repeated rows are each stored; an
empty table gives an empty store; other columns are not stored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import integer_ids, pieces, texts
from terrafold.llm.pretoken import PATTERN, Pieces, Vocabulary, byte_characters, cut, take_ragged, units

#: One position is kept for so many documents; the rest of a select is a scan of at most that many ones.
SAMPLE = 128


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing list of ``size`` numbers below 2**62, fewer than 2**30: low bits packed, high bits in unary, sampled positions for select."""

    size: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values, size = values.astype(np.int64), len(values)
        if not size:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, int(np.log2(max(1, int(values[-1]) // size))))
        lows = (values[:, None] >> np.arange(low_bits)) & 1
        at = (values >> low_bits) + np.arange(size)
        bits = np.zeros(int(at[-1]) + 1, np.uint8)
        bits[at] = 1
        return cls(size, low_bits, np.packbits(lows.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes())

    def select(self, k: int) -> int:
        """The k-th number (from 0): from the nearest sampled position, by whole bytes, then by bits."""
        if not 0 <= k < self.size:
            raise IndexError(k)
        at = int(np.frombuffer(self.samples, "<u4")[k // SAMPLE])
        left, byte, skip = k % SAMPLE, at >> 3, at & 7
        bits = (self.high[byte] >> skip) << skip
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = self.high[byte]
        for _ in range(left):
            bits &= bits - 1
        high = byte * 8 + (bits & -bits).bit_length() - 1 - k
        first = k * self.low_bits
        chunk = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little") >> (first & 7)
        return high << self.low_bits | chunk & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every number, in bulk."""
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.size] - np.arange(self.size)
        lows = np.unpackbits(np.frombuffer(self.low, np.uint8), count=self.size * self.low_bits, bitorder="little").reshape(self.size, self.low_bits)
        return (high << self.low_bits) + lows.astype(np.int64) @ (1 << np.arange(self.low_bits))

    def first_at_least(self, value: int) -> int:
        """Place of the first number that isn't smaller, by bisection with select; ``size`` if all are."""
        lo, hi = 0, self.size
        while lo < hi:
            middle = (lo + hi) // 2
            if self.select(middle) < value:
                lo = middle + 1
            else:
                hi = middle
        return lo

    def bytes_used(self) -> int:
        return len(self.low) + len(self.high) + len(self.samples)


class LibraryEncoder:
    """Encodes with the tokenizers library's model; bounded tables keep the ids of units and pieces already met."""

    KEPT, KEPT_UNITS, KEPT_BYTES, LONGEST = 300_000, 600_000, 32 << 20, 64

    def __init__(self, vocabulary: Vocabulary) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(vocabulary.text).model
        self.added, self.table = vocabulary.added, dict(enumerate(byte_characters()))
        self.find, self.kept = regex.compile(PATTERN).findall, {}
        self.units, self.unit_at, self.unit_ids = pa.array([], pa.large_string()), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def piece(self, piece: str) -> bytes:
        ids = self.kept.get(piece)
        if ids is None:
            spelled = piece.replace(" ", self.table[32]) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.table)
            ids = array("i", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            if len(self.kept) < self.KEPT and len(piece) < self.LONGEST:
                self.kept[piece] = ids
        return ids

    def encode(self, text: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of each text, the end id after each."""
        whole, at, numbers, names = units(text, self.added)
        unit_at, unit_ids, place = self.of_units(names)
        flat_at, flat = take_ragged(unit_at, unit_ids, place[numbers])
        offsets = flat_at[at]
        if whole.any():
            whole_at, whole_ids = self.of_pieces(cut(text.filter(pa.array(whole)), self.added))
            place = np.where(whole, len(text) + np.cumsum(whole) - 1, np.arange(len(text)))
            offsets, flat = take_ragged(np.concatenate([offsets, offsets[-1] + whole_at[1:]]), np.concatenate([flat, whole_ids]), place)
        return offsets + np.arange(len(offsets)), np.insert(flat, offsets[1:], end_id)

    def of_units(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists of ids as offsets and flat values, and the place of each unit's list; new units are kept while there is room."""
        place = pc.index_in(names, self.units)
        new = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        place = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[new] = len(self.units) + np.arange(len(new))
        names = names.take(pa.array(new))
        letters = pc.match_substring_regex(names, "^ ?[A-Za-z]+$").to_pylist()  # a piece as it is
        spelled = [self.piece(u) if one else b"".join(map(self.piece, self.find(u))) for u, one in zip(names.to_pylist(), letters, strict=True)]
        new_at, new_ids = ragged(spelled)
        every_at, every_ids = np.concatenate([self.unit_at, self.unit_at[-1] + new_at[1:]]), np.concatenate([self.unit_ids, new_ids])
        room = self.KEPT_UNITS - len(self.units) if self.units.nbytes + self.unit_ids.nbytes < self.KEPT_BYTES else 0
        short = np.flatnonzero(pc.binary_length(names).to_numpy(zero_copy_only=False) < self.LONGEST)[:room]
        if len(short):
            short_at, short_ids = take_ragged(new_at, new_ids, short)
            self.units = pa.concat_arrays([self.units, names.take(pa.array(short))])
            self.unit_at, self.unit_ids = np.concatenate([self.unit_at, self.unit_at[-1] + short_at[1:]]), np.concatenate([self.unit_ids, short_ids])
        return every_at, every_ids, place

    def of_pieces(self, found: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of texts that are cut into pieces."""
        at, ids = ragged([self.piece(p) if a < 0 else array("i", [a]).tobytes() for p, a in zip(found.distinct, found.added.tolist(), strict=True)])
        piece_at, flat = take_ragged(at, ids, found.numbers)
        return piece_at[found.offsets], flat


def ragged(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of 32-bit numbers as offsets and flat values."""
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]).astype(np.int64) // 4
    return at, np.frombuffer(b"".join(lists), np.int32)


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder_of(vocabulary: Vocabulary) -> LibraryEncoder:
    if vocabulary.text not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.text] = LibraryEncoder(vocabulary)
    return _ENCODERS[vocabulary.text]


LIST = ("low_bits int", "low binary", "high binary", "samples binary")
SEGMENTS = "part long, start_in_part long, width int, n_docs long, n_ids long, first_doc long, last_doc long, " + ", ".join([*LIST, *(f"doc_{c}" for c in LIST)]) + ", ids binary"
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
#: Documents of a segment are nearer to the first than this.
MAX_SPAN = 1 << 62


def _list(row: dict, prefix: str = "") -> EliasFano:
    return EliasFano(row["n_docs"], *(row[f"{prefix}{c.split()[0]}"] for c in LIST))


def runs(doc_ids: list) -> Iterator[tuple[int, int]]:
    """Ranges of documents that a segment can hold together: all without a doc_id, or all near enough to the first."""
    lo = 0
    for hi in range(1, len(doc_ids) + 1):
        first, x = doc_ids[lo], doc_ids[hi] if hi < len(doc_ids) else None
        if hi == len(doc_ids) or (first is None) != (x is None) or (x is not None and x - first >= MAX_SPAN):
            yield lo, hi
            lo = hi


def write(docs: DataFrame, path: str, vocabulary_path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, segment_ids: int = 1 << 20) -> None:
    """Write the store of ``docs`` to the folder ``path``, which the cluster shares. A segment holds whole documents, and ends once it has ``segment_ids`` ids."""
    vocabulary = Vocabulary.load(vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.text)  # as large as the vocabulary
    width = 2 if max([end_id, *vocabulary.spec["model"]["vocab"].values(), *vocabulary.added.values()]) < 1 << 16 else 4
    fields = [x.split() for x in SEGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = encoder_of(Vocabulary(shared.value)), TaskContext.get().partitionId(), 0
        for table in pieces(batches):
            offsets, ids = encoder.encode(texts(table), end_id)
            doc_ids = table.column("doc_id").to_pylist()
            for lo, end in runs(doc_ids):
                while lo < end:
                    hi = min(end, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + segment_ids, "right")) - 1))
                    ends = EliasFano.of(offsets[lo + 1 : hi + 1] - offsets[lo])
                    known = doc_ids[lo] is not None
                    own = EliasFano.of(np.array(doc_ids[lo:hi], np.int64) - doc_ids[lo]) if known else EliasFano.of(np.zeros(0, np.int64))
                    n = int(offsets[hi] - offsets[lo])
                    lists = [x for e in (ends, own) for x in (e.low_bits, e.low, e.high, e.samples)]
                    row = (part, start, width, hi - lo, n, doc_ids[lo], doc_ids[hi - 1], *lists, ids[offsets[lo] : offsets[hi]].astype(f"<u{width}").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], KINDS[kind]) for v, (_, kind) in zip(row, fields, strict=True)], names=[c for c, _ in fields])
                    lo, start = hi, start + n

    rows = docs.select(integer_ids(docs, doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, SEGMENTS).write.parquet(f"{path}/segments")
    spark = docs.sparkSession
    totals = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each range
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).tolist()
    spark.createDataFrame([(r["part"], s) for r, s in zip(totals, starts, strict=False)], "part long, start long").coalesce(1).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, *, with_ids: bool = False, max_parts: int = 1 << 22) -> DataFrame:
    """One row per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``, or with ``with_ids`` the ``ids``.

    The starts of the ranges are broadcast; more than ``max_parts`` of them are joined by a shuffle instead.
    """
    parts = spark.read.schema("part long, start long").parquet(f"{path}/parts")
    parts = F.broadcast(parts) if parts.count() <= max_parts else parts
    last = "ids array<long>" if with_ids else "ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = _list(r).all()
                own = [None] * r["n_docs"] if r["first_doc"] is None else _list(r, "doc_").all() + r["first_doc"]
                first = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
                each = [ids[a:b] for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                values = pa.array([x.tolist() for x in each], pa.list_(pa.int64())) if with_ids else pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())
                columns = [pa.array(own, pa.int64()), pa.array(first + r["start"] + r["start_in_part"], pa.int64()), pa.array(ends - first, pa.int64()), values]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", last.split()[0]])

    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    return segments.join(parts, "part").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def find(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` of the named documents (a short list), each as often as it is stored.

    Only segments whose range of doc_ids holds one of them are read; in these, select gives the place of the document and
    its ends, and nothing else is unpacked.
    """
    wanted = sorted(set(doc_ids))
    near = F.exists(F.array(*map(F.lit, wanted)), lambda x: x.between(F.col("first_doc"), F.col("last_doc"))) if wanted else F.lit(False)
    low, high = (wanted[0], wanted[-1]) if wanted else (0, 0)
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").where((F.col("last_doc") >= low) & (F.col("first_doc") <= high) & near)
    parts = spark.read.schema("part long, start long").parquet(f"{path}/parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends, own, out = _list(r), _list(r, "doc_"), []
                for x in wanted:
                    k = own.first_at_least(x - r["first_doc"]) if r["first_doc"] <= x <= r["last_doc"] else own.size
                    while k < own.size and own.select(k) == x - r["first_doc"]:
                        a, b = ends.select(k - 1) if k else 0, ends.select(k)
                        ids = np.frombuffer(r["ids"], f"<u{r['width']}", b - a, a * r["width"])
                        out.append((x, a + r["start"] + r["start_in_part"], b - a, ids.astype(np.int64).tolist()))
                        k += 1
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "start", "n_tokens", "ids"])

    return segments.join(parts, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<long>")
