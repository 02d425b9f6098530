"""Helpers shared by the text operators: materialising, Arrow batching, words, hashing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators.storage import materialize, scratch, shared_dir  # noqa: F401  the operators take them from here

#: Text bytes that a Python task works on at a time (a longer text is one piece).
PIECE_BYTES = 8 << 20


def configure(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that long texts don't make huge batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PIECE_BYTES))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables of about ``most`` bytes of ``column``; rows keep their order."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(lengths)
        while at < batch.num_rows:
            room = most - size + (total[at - 1] if at else 0)
            to = max(int(np.searchsorted(total, room, "right")), at + (not held))
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(total[to - 1] - (total[at - 1] if at else 0))
                at = to
            if at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield pa.Table.from_batches(held)


def texts(table: pa.Table, column: str = "text") -> pa.Array:
    """The column as one large_string array, null as empty."""
    col = table.column(column)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return pc.fill_null(col.cast(pa.large_string()), "")


def words(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Runs without ``[\\x20\\x09-\\x0D]``: offsets (one more than texts) into the flat array of words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat, at = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(real)]).astype(np.int64)
    return before[at], flat.filter(pa.array(real))


def hashed(values: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Per value its 64-bit hash; then the code of each value and the distinct values."""
    coded = values.dictionary_encode()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return (table[codes] if len(codes) else np.zeros(0, np.uint64)), codes, coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` values from each place on (the last width-1 places run over the end)."""
    out = np.zeros(len(h), np.uint64)
    for k in range(width):
        part = np.zeros(len(h), np.uint64)
        part[: len(h) - k] = h[k:]
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k + 1))
    return out


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each flat value the number of the row that holds it."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def integer_ids(df: DataFrame, name: str) -> Column:
    """The column as long; ids of another kind are an error, since casts would make nulls or clashes of them."""
    kind = df.select(name).schema[0].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{name} must be an integer column, not {kind}; number the documents first")
    return F.col(name).cast("long")


def fold_crc(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus


def fold_of(doc_ids: list, modulus: int) -> np.ndarray:
    """As ``fold_crc`` in Python."""
    return np.array([zlib.crc32(("null" if d is None else str(d)).encode()) % modulus for d in doc_ids], np.int64)


def head_rows(df: DataFrame, count: str, most: int) -> DataFrame:
    """Rows with the largest counts, ``most`` at most: whole sixteenths of an octave of the count, from the top.

    All of ``df`` if it has no more rows. Only a histogram of the counts is gathered, so no task sorts the table.
    """
    level = F.floor(F.log2(F.col(count).cast("double")) * 16)
    total, lowest = 0, None
    for r in df.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > most:
            break
        lowest = r["level"]
    return df.where(F.lit(False) if lowest is None else level >= lowest)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table with the named columns."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
