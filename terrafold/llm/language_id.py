"""Language ID by compression: one raw-content zstandard dictionary per language, smallest output wins.

Rules for odd input: a null, empty or letterless text is ``und`` with score 0; rows with a null language
or no letters teach nothing; with no learned language every text is ``und``; equal sizes go to the language
with more training rows, then to the smaller name; repeated rows are judged each on its own; other columns
pass through untouched, but input columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.common import pieces, texts

UNDETERMINED = "und"
#: Longer texts are compressed in parts of so many bytes, so that all of them lie within the window of the dictionary.
PART_BYTES = 1 << 18
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def normalised(text: str) -> bytes:
    """Lower-cased words of letters with single spaces around them; b'' without a letter."""
    kept = NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {kept} ".encode() if any(c.isalpha() for c in kept) else b""


def parameters(content: bytes) -> zstandard.ZstdCompressionParameters:
    """A window that holds the dictionary ``content`` and a part of a text."""
    return zstandard.ZstdCompressionParameters(
        window_log=min(27, max(19, (len(content) + PART_BYTES - 1).bit_length())), hash_log=17, chain_log=17, search_log=2, min_match=3, target_length=16,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False,
    )


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, the language with most training rows first."""

    dictionaries: tuple[tuple[str, bytes], ...]
    margin: float

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        made = []
        for lang, content in self.dictionaries:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters(content))
            made.append((lang, zstandard.ZstdCompressor(compression_params=parameters(content), dict_data=dictionary)))
        return made


def fit(
    train: DataFrame, *, text: str = "text", lang: str = "lang", margin: float = 0.02, sample_docs: int = 60,
) -> LanguageModel:
    """Learn from a bounded sample: per language the whole of the ``sample_docs`` distinct texts with the smallest hash.

    The counts by language cover all rows, and every language gets a dictionary; a task holds all of them. ``margin``: a
    text is rejected when the runner-up's size is not larger by this share.
    """
    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text rlike '\\\\p{L}'").withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("count"), "lang").collect()  # a row for each language
    if not counts:
        return LanguageModel((), margin)
    # A uniform hash below this bound leaves about twice the sample of each language before the exact pick.
    shares = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * sample_docs / max(1, r["texts"]))))])
    uniform = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = rows.where(uniform <= F.try_element_at(shares, F.col("lang"))).select("lang", "h", "text").dropDuplicates(["lang", "h"])
    best = few.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).where(f"rn <= {sample_docs}")
    found: dict[str, list[bytes]] = {}
    for r in best.orderBy("lang", "rn").collect():
        found.setdefault(r["lang"], []).append(normalised(r["text"]))
    return LanguageModel(tuple((r["lang"], b"".join(found.get(r["lang"], []))) for r in counts), margin)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` (the best learned language, or ``und``), ``score`` (0 to 1) and ``rejected`` (narrow margin or ``und``)."""
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for table in pieces(batches, text):
            out = [judged(t, compressors, model.margin) for t in texts(table, text).to_pylist()]
            for name, kind, k in (("lang_pred", pa.string(), 0), ("score", pa.float64(), 1), ("rejected", pa.bool_(), 2)):
                table = table.append_column(name, pa.array([x[k] for x in out], kind))
            yield from table.combine_chunks().to_batches()

    return docs.mapInArrow(run, schema)


def judged(text: str, compressors: list, margin: float) -> tuple[str, float, bool]:
    content = normalised(text)
    if not content or not compressors:
        return UNDETERMINED, 0.0, True
    parts = [content[k : k + PART_BYTES] for k in range(0, len(content), PART_BYTES)]
    sizes = [sum(len(c.compress(x)) for x in parts) for _, c in compressors]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    score = 1.0 / sum(math.exp(min(0.0, (sizes[best] - s) / 2)) for s in sizes)
    second = min((s for k, s in enumerate(sizes) if k != best), default=math.inf)
    return compressors[best][0], score, second <= sizes[best] * (1 + margin)
