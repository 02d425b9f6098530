"""Corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
documents; the last returns ids. ``run`` writes every stage's result to the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import decontam, jaccard_join, line_crf, line_dedup, spec_bpe
from terrafold.llm.common import configure, materialize, scratch
from terrafold.llm.queries import quality_model, vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents with a quality score below this go.
MIN_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the line classifier scores below MIN_QUALITY. It learns from labelled documents of the table itself."""
    configure(spark)
    model = quality_model(spark, sf_dir, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return line_crf.score(docs, model, threshold=MIN_QUALITY).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop long lines that five documents or more hold, save in the largest doc_id; n_chars follows."""
    configure(spark)
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that with the smallest doc_id and then text hash.

    Rows with a null doc_id stay. Rows of one doc_id with different texts are judged by their texts; rows that are
    equal in id and text are one document and stay together.
    """
    configure(spark)
    found = jaccard_join.linked(docs).where("doc_id is not null and n_shingles > 0").select("doc_id", "text_hash", "component_id").distinct()
    found = materialize(found)
    first = materialize(found.where("doc_id = component_id").groupBy("component_id").agg(F.min("text_hash").alias("first")))
    gone = found.hint("merge").join(first, "component_id", "left").where("doc_id <> component_id or text_hash <> first")
    own = (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"])
    return docs.join(gone, own, "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    hit = decontam.report(docs, items).where("contaminated").select("k1", "k2").distinct()
    keys = {"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.col("text"), F.lit("\1"), F.col("doc_id"))}
    return docs.withColumns(keys).join(hit, ["k1", "k2"], "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``ids``."""
    configure(spark)
    return spec_bpe.encode_with_digest(docs.select("doc_id", "text"), vocabulary_path()).drop("text")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("BPE encoding and decoding", tokens)]

#: The classifier and the encoder can't be put in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote on its way goes once its result is written
            result = stage(spark, docs, sf_dir)
            docs = materialize(result, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
