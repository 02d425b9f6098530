"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

A benchmark item's windows (its runs of ``window`` words, or the whole item if it is shorter) are sets of shingles,
here pairs of neighbouring words (one-word items: the word). A window occurs in a document only if all of its
shingles do, so one of them is enough to find candidates: its rarest by the counts in the documents. One pass over
the documents keeps the places of benchmark shingles; the rarest shingle of each window joins them, the place of
the shingle in the window gives the start, starts outside the document fall to the length bound, and a candidate
stands if every shingle of its window is at its place.

Rules for odd input: null or wordless text has no words and no hits; items without an id or without words are
skipped; equal items or windows count for each of their item_ids; repeated documents are each returned; other
columns are not used. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.llm.common import materialize

#: Between words: every ASCII character but digits and letters (other code points belong to words).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tables of benchmark shingles up to so many bytes are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_BYTES = 64 << 20


def word_array(text: Column) -> Column:
    """Words with A-Z lower-cased. Texts (or else words) of ASCII only take the faster lower()."""
    plain = F.octet_length(text) == F.length(text)
    ascii_words = F.split(F.lower(text), SEPARATORS)
    any_words = F.transform(F.split(text, SEPARATORS), lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))
    return F.filter(F.coalesce(F.when(plain, ascii_words).otherwise(any_words), F.array().cast("array<string>")), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """``window`` (its words, joined by blanks), ``len`` and ``item``: each window of each item once."""
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), word_array(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(window)).alias("w"))
    return each.select(F.concat_ws(" ", "w").alias("window"), F.size("w").alias("len"), "item").distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """``window``, ``len``, ``offset`` (from 0), ``shingle``, ``all_bits`` (a bit for each shingle of the window)."""
    w = F.split("window", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.col("len") - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
    parts = F.when(F.col("len") > 1, pairs).otherwise(F.array("window"))
    all_bits = F.expr("shiftleft(1L, greatest(len - 1, 1)) - 1L")
    return windows.select("window", "len", all_bits.alias("all_bits"), F.posexplode(parts).alias("offset", "shingle"))


def sized(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= MAX_BROADCAST_BYTES else df


def shingle_places(docs: DataFrame, shingles: DataFrame, size: int, singles: bool, *, doc_id: str, text: str) -> DataFrame:
    """A row with pos 0 for each document, and a row for each place (from 1) that holds a benchmark shingle.

    ``k1`` and ``k2`` identify a document's id and text together; ``n_words`` is on every row. Where the shingles are
    broadcast, places are looked up as hashes beside their document's words, and nothing is copied. Where they are joined,
    a place takes its own two words along, not its document.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.col(text), F.lit("\1"), F.col(doc_id)).alias("k2"), word_array(F.col(text)).alias("w")
    )
    n = F.size("w")
    key = F.when(F.instr("shingle", " ") > 0, F.xxhash64(F.substring_index("shingle", " ", 1), F.lit(" "), F.substring_index("shingle", " ", -1))).otherwise(F.xxhash64("shingle"))
    hashes = sized(shingles.select(key.alias("key")).distinct(), size)
    later = F.slice("w", F.lit(2), F.greatest(n, F.lit(1)))
    alone = F.col("at") > F.greatest(F.col("n_words") - 1, F.lit(0))  # single words come behind all pairs
    pos = F.when(alone, F.col("at") - F.greatest(F.col("n_words") - 1, F.lit(0))).otherwise(F.col("at"))
    if size <= MAX_BROADCAST_BYTES:
        pairs = F.slice(F.zip_with("w", later, lambda a, b: F.xxhash64(a, F.lit(" "), b)), F.lit(1), F.greatest(n - 1, F.lit(0)))
        tokens = F.concat(pairs, F.transform("w", lambda a: F.xxhash64(a))) if singles else pairs
        every = rows.select("doc_id", "k1", "k2", "w", n.alias("n_words"), F.posexplode(F.concat(F.array(F.lit(None).cast("long")), tokens)).alias("at", "h"))
        said = F.when(alone, F.get("w", pos - 1)).otherwise(F.concat_ws(" ", F.get("w", pos - 1), F.get("w", pos)))
    else:
        none = F.lit(None).cast("string")
        both = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(n - 1, F.lit(0))), later, both)
        tokens = F.concat(pairs, F.transform("w", lambda a: both(a, none))) if singles else pairs
        every = rows.select("doc_id", "k1", "k2", n.alias("n_words"), F.posexplode(F.concat(F.array(both(none, none)), tokens)).alias("at", "t"))
        hashed = F.when(F.col("t.b").isNull(), F.xxhash64("t.a")).otherwise(F.xxhash64("t.a", F.lit(" "), "t.b"))
        every = every.withColumn("h", F.when(F.col("at") > 0, hashed))
        said = F.concat_ws(" ", "t.a", "t.b")
    met = every.join(hashes, F.col("h") == F.col("key"), "left").where("at = 0 or key is not null")
    return met.select("doc_id", "k1", "k2", "n_words", F.when(F.col("at") == 0, 0).otherwise(pos).alias("pos"), F.when(F.col("at") > 0, said).alias("shingle"))


def find(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents (``doc_id, k1, k2, n_words``), the occurrences of windows in them (``k1, k2, start, len, window``), and the ``item`` of each ``window``."""
    items = materialize(benchmark_windows(benchmark, item_id=item_id, text=item_text, window=window))
    shingles = materialize(window_shingles(items.select("window", "len").distinct()))
    seen = shingles.agg(F.sum(F.octet_length("window") + F.octet_length("shingle") + 64), F.count_if(F.col("len") == 1)).first()
    size = seen[0] or 0
    places = materialize(shingle_places(docs, shingles, size, seen[1] > 0, doc_id=doc_id, text=text))
    hits = places.where("pos > 0")
    counts = hits.groupBy("shingle").agg(F.count("*").alias("n"))
    rarity = shingles.join(sized(counts, size), "shingle", "left")
    prefix = rarity.groupBy("window", "len", "all_bits").agg(F.min_by(F.struct("shingle", "offset"), F.struct(F.coalesce("n", F.lit(0)), "shingle", "offset")).alias("p"), F.min(F.coalesce("n", F.lit(0))).alias("least")).where("least > 0")
    prefix = prefix.select("window", "len", "all_bits", "p.shingle", "p.offset")
    found = hits.join(sized(prefix, size), "shingle").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 1 and start + len - 1 <= n_words")
    found = found.select("k1", "k2", "start", "window", "len", "all_bits")
    wanted = found.join(sized(shingles.select("window", "offset", "shingle"), size), "window").withColumn("pos", F.col("start") + F.col("offset"))
    there = wanted.join(hits.select("k1", "k2", "pos", "shingle"), ["k1", "k2", "pos", "shingle"])
    proven = there.groupBy("k1", "k2", "start", "window", "len", "all_bits").agg(F.expr("bit_or(shiftleft(1L, offset))").alias("bits")).where("bits = all_bits")
    return places.where("pos = 0").select("doc_id", "k1", "k2", "n_words"), proven.select("k1", "k2", "start", "len", "window"), items.select("window", "item")


def hit_words(spans: DataFrame) -> DataFrame:
    """``k1``, ``k2`` and ``n_hit``, the words inside any span: each span adds what reaches beyond all before it in its document."""
    order = W.partitionBy("k1", "k2").orderBy("start", "len")
    before = F.max(F.col("start") + F.col("len")).over(order.rowsBetween(W.unboundedPreceding, -1))
    more = F.col("start") + F.col("len") - F.greatest(F.coalesce("before", F.lit(0)), F.col("start"))
    ends = spans.groupBy("k1", "k2", "start").agg(F.max("len").alias("len")).withColumn("before", before)
    return ends.groupBy("k1", "k2").agg(F.sum(F.greatest(more, F.lit(0))).alias("n_hit"))


def report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_hit`` (words inside occurrences), ``items`` (sorted as strings), ``contaminated``."""
    all_docs, spans, items = find(docs, benchmark, **names)
    spans = materialize(spans)
    held = spans.select("k1", "k2", "window").distinct().join(items, "window").groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    joined = all_docs.join(hit_words(spans), ["k1", "k2"], "left").join(held, ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"), "k1", "k2")
