r"""Line dedup across documents, giving keep bitmaps instead of text.

Every long line becomes a 128-bit hash with its document and place. The hashes are range-partitioned on (hash,
document), sorted by hash, document and place, and streamed: in a run of equal hashes the first document keeps its
lines, the rows of later documents are dropped if the run has enough documents. A run that touches a partition's
border, or is very long, goes out unresolved, and its documents are counted by a distributed aggregate; so a line
that a third of the corpus holds is spread over many partitions and never buffered. The result is a compressed
bitmap for each document that loses lines.

Rules for odd input: null or empty text is one empty line; rows with a null doc_id hold no lines and keep all of
theirs; doc_id must be an integer column; rows of one doc_id count as one document, and each is cut by the bitmap of its own text; other columns
pass through ``apply_bitmaps``, those named like the added ones are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.common import integer_ids, materialize, owner, pieces, texts
from terrafold.llm.line_crf import lines_of

LINES = "h1 long, h2 long, doc_id long, text_hash long, n_lines int, pos int"
#: A run of equal hashes is held back to this many rows; the rest is counted elsewhere.
HELD_ROWS = 100_000


def keys(lines: pa.Array) -> pa.Array:
    r"""Lines without ``[\x20\x09-\x0D]`` at both ends, A-Z lower-cased."""
    return pc.ascii_lower(pc.ascii_trim_whitespace(lines))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line whose key has at least ``min_chars`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            offsets, lines = lines_of(texts(table))
            key = keys(lines)
            at = np.flatnonzero(pc.utf8_length(key).to_numpy(zero_copy_only=False) >= min_chars)
            coded = key.take(pa.array(at)).dictionary_encode()
            digests = b"".join(xxhash.xxh3_128_digest(x) for x in coded.dictionary.to_pylist())
            hashes = np.frombuffer(digests, "<i8").reshape(-1, 2)[coded.indices.to_numpy(zero_copy_only=False)]
            of = owner(offsets)[at]
            ids, text_hash = (table.column(c).combine_chunks().take(pa.array(of)) for c in ("doc_id", "text_hash"))
            columns = [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), ids, text_hash, pa.array(np.diff(offsets)[of].astype(np.int32)), pa.array((at - offsets[:-1][of]).astype(np.int32))]
            yield from pa.Table.from_arrays(columns, names=[x.split()[0] for x in LINES.split(", ")]).to_batches(max_chunksize=50_000)

    return docs.mapInArrow(run, LINES)


def streamed(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.Table]:
    """Rows to drop (``open`` false) and rows of unresolved runs (``open`` true) from one sorted partition."""
    held: pa.Table | None = None
    first = True  # the run at the partition's start may have begun before it
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        if held is not None and held.num_rows:
            table = pa.concat_tables([held, table]).combine_chunks()
        h = np.stack([table.column("h1").to_numpy(), table.column("h2").to_numpy()])
        starts = np.flatnonzero(np.concatenate([[True], (h[:, 1:] != h[:, :-1]).any(axis=0)]))
        closed_from = int(starts[1]) if first and len(starts) > 1 else 0
        if first:
            if len(starts) == 1:
                yield marked(table, True)
                held = table.slice(0, 1).slice(0, 0)
                continue
            yield marked(table.slice(0, closed_from), True)
            first = False
        yield marked(table.slice(closed_from, int(starts[-1]) - closed_from).filter(pa.array(dropped(table.slice(closed_from, int(starts[-1]) - closed_from), min_docs))), False)
        held = table.slice(int(starts[-1]))
        if held.num_rows > HELD_ROWS:
            yield marked(held, True)
            held, first = None, True
    if held is not None and held.num_rows:
        yield marked(held, True)


def marked(table: pa.Table, value: bool) -> pa.Table:
    return table.append_column("open", pa.array(np.full(table.num_rows, value)))


def dropped(table: pa.Table, min_docs: int) -> np.ndarray:
    """In whole runs: rows of other documents than the run's first, where the run has enough documents."""
    if not table.num_rows:
        return np.zeros(0, bool)
    h1, h2, doc = (table.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
    new_run = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    new_doc = new_run | np.concatenate([[True], doc[1:] != doc[:-1]])
    run = np.cumsum(new_run) - 1
    n_docs = np.bincount(run, weights=new_doc).astype(np.int64)
    return (n_docs[run] >= min_docs) & (doc != doc[new_run][run])


def keep_bitmaps(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_lines``, ``n_dropped`` and ``keep`` (zlib-compressed little-endian bits) of each document that loses lines.

    A key of at least ``min_chars`` code points that ``min_docs`` documents hold stays only in the largest doc_id.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(integer_ids(docs, doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    lines = materialize(hashed_lines(rows, min_chars))  # else the texts are cut once more for the bounds of the ranges
    order = lines.repartitionByRange("h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed(batches, min_docs):
            yield from table.to_batches()

    found = materialize(order.mapInArrow(run, f"{LINES}, open boolean"))
    open_ = found.where("open").drop("open")
    known = materialize(open_.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs))
    late = open_.hint("merge").join(known, ["h1", "h2"]).where("doc_id <> keeper")  # Spark splits a line that many documents hold
    gone = found.where("not open").select("doc_id", "text_hash", "n_lines", "pos").unionByName(late.select("doc_id", "text_hash", "n_lines", "pos"))
    by_doc = gone.groupBy("doc_id", "text_hash", "n_lines").agg(F.collect_set("pos").alias("pos"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bitmaps, counts = [], []
            for n, pos in zip(batch.column("n_lines").to_pylist(), batch.column("pos").to_pylist(), strict=True):
                bits = np.ones(n, np.uint8)
                bits[pos] = 0
                counts.append(len(pos))
                bitmaps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(bitmaps, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])

    return by_doc.mapInArrow(packed, "doc_id long, text_hash long, n_lines int, n_dropped long, keep binary")


ADDED = (("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept", T.StringType()))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    r"""Add ``n_lines``, ``n_dropped`` and ``kept``, the text of the lines that stay, joined by \n."""
    docs = docs.drop(*(n for n, _ in ADDED))
    small = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("keep").alias("_keep"))
    joined = docs.join(small, (F.col(doc_id) == F.col("_doc")) & (F.xxhash64(text) == F.col("_hash")), "left").drop("_doc", "_hash")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in ADDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, text):
            kept, lines, lost = [], [], []
            for t, keep in zip(texts(table, text).to_pylist(), table.column("_keep").to_pylist(), strict=True):
                lines.append(t.count("\n") + 1)
                if keep is None:
                    kept.append(t)
                    lost.append(0)
                    continue
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=lines[-1], bitorder="little")
                kept.append("\n".join([x for x, b in zip(t.split("\n"), bits.tolist(), strict=True) if b]))
                lost.append(lines[-1] - int(bits.sum()))
            made = table.drop_columns(["_keep"])
            for (name, _), values, kind in zip(ADDED, (lines, lost, kept), (pa.int64(), pa.int64(), pa.string()), strict=True):
                made = made.append_column(name, pa.array(values, kind))
            yield from made.combine_chunks().to_batches()

    return joined.mapInArrow(run, schema)
