"""N-gram Jaccard join: documents whose sets of word shingles have a similarity of at least 80 %.

Equal sets are one node. Tokens (64-bit shingle hashes) have one global order: rare ones first, then by their count,
from a table of the most frequent tokens. Two similar sets share a token among the first ``size - ceil(0.8 size) + 1``
of each, and c + 1 tokens if each prefix is c longer. The rare tokens of a prefix are indexed alone. The frequent ones
are dealt into c classes by hash, so two sets that share no rare token there share two of one class, and every pair of
tokens within a class is indexed. c follows the length of the prefix (about CLASS tokens in a class), so the number of
combinations is proportional to it at every size. Sets whose sizes differ by a fifth may have different c: a set is
indexed with the c of its own size and with that of the largest set it can be similar to.

Within a list of equal keys, sets are first compared with a pivot of their size class, the set that can share most
with others (among near copies the one with the fewest edits, so one comparison links almost all). Verified links
give components, and then every pair of sets in a list that lie in different components is compared too, after length
and position bounds. So no link between components is lost. Lists of very frequent keys never meet in one task: their pivots come from a partial aggregate.

Rules for odd input: null or wordless text has an empty set, links with nothing and is its own component; fewer
words than a shingle form one shingle; rows with a null doc_id get their size, and a component only from ids of
equal or linked documents; doc_id must be an integer column; repeated rows are each returned; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import hashed, head_rows, integer_ids, materialize, mix, owner, pieces, rolled, texts, words
from terrafold.operators.components import components

#: Bits of a token that its count goes by (a clash only changes the order of tokens).
PRINT_BITS = 40
#: Counts from here on are listed, at most so many of the largest.
LISTED_FROM, LISTED = 16, 1 << 20
#: Ids of representatives up to this many are broadcast.
MAX_BROADCAST = 2_000_000
#: Tokens with this count are frequent; with that count their lists are dealt out.
FREQUENT_FROM, SPREAD_FROM = 256, 4096
#: Frequent tokens of a prefix go into classes of about so many.
CLASS = 16
#: Tokens of the corpus in one range of prints.
RANGE = 1 << 22


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct tokens of each text, as offsets and flat values."""
    offsets, flat = words(text)
    h, _, _ = hashed(flat)
    n, of = np.diff(offsets), owner(offsets)
    token = mix(rolled(h, width))[np.arange(len(h)) + width <= offsets[1:][of]]
    at = np.concatenate([[0], np.cumsum(np.maximum(n - width + 1, 0))]).astype(np.int64)
    sets = []
    for k, (a, b, size) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), n.tolist(), strict=True)):
        if a < b:
            t = np.sort(token[a:b])
            sets.append(t[np.concatenate([[True], t[1:] != t[:-1]])])
        elif size:
            whole = " ".join(flat.slice(offsets[k], size).to_pylist())
            sets.append(np.array([xxhash.xxh3_64_intdigest("\1" + whole)], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return bounds, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def node_ids(bounds: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set, alike for equal sets (0 for the empty one)."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = mix(np.add.reduceat(mix(tokens), bounds[:-1][some]) + np.diff(bounds)[some].astype(np.uint64))
    return out.astype(np.int64)


def overlap_needed(a, b, percent: int):
    """Least intersection of sets of these sizes: 100 i >= percent (a + b - i)."""
    return -((-percent * (a + b)) // (100 + percent))


def nodes_of(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``node`` and ``text_hash`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            bounds, tokens = shingle_sets(texts(table), width)
            yield from pa.Table.from_arrays([table.column("doc_id"), pa.array(np.diff(bounds)), pa.array(node_ids(bounds, tokens)), table.column("text_hash")], names=["doc_id", "n_shingles", "node", "text_hash"]).to_batches()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, text_hash long")


def token_counts(docs: DataFrame, width: int, tokens_in_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Prints and counts of the most frequent tokens (at most ``LISTED``), sorted by print.

    Every token of every document counts. A task sends each print of a piece once with its count, packed as differences
    by ranges of prints; there are so many ranges that one holds about ``RANGE`` tokens of the corpus.
    """
    spark = docs.sparkSession
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), tokens_in_all // RANGE, 256)
    bits = int(np.ceil(np.log2(ranges)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for table in pieces(batches):
            bounds, tokens = shingle_sets(texts(table), width)
            _, first = np.unique(node_ids(bounds, tokens), return_index=True)  # equal sets of a batch count once
            one = np.zeros(len(bounds) - 1, bool)
            one[first] = True
            prints, n = np.unique(tokens[np.repeat(one, np.diff(bounds))] >> np.uint64(64 - PRINT_BITS), return_counts=True)
            prints = prints.astype(np.int64)
            edges = np.searchsorted(prints, np.arange(1 << bits) << (PRINT_BITS - bits))[1:]
            for bucket, (part, count) in enumerate(zip(np.split(prints, edges), np.split(n, edges), strict=True)):
                if len(part):
                    packed = [squeeze.compress(x.astype("<u4").tobytes()) for x in (np.diff(part, prepend=bucket << (PRINT_BITS - bits)), count)]
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["bucket", "prints", "counts"])

    def count(table: pa.Table) -> pa.Table:
        base, loose = int(table.column("bucket")[0].as_py()) << (PRINT_BITS - bits), zstandard.ZstdDecompressor()
        unpack = lambda name: [np.frombuffer(loose.decompress(x), "<u4").astype(np.int64) for x in table.column(name).to_pylist()]
        prints, n = np.concatenate([np.cumsum(x) for x in unpack("prints")]) + base, np.concatenate(unpack("counts"))
        order = np.argsort(prints)
        prints, n = prints[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        prints, n = prints[starts], np.add.reduceat(n, starts)
        return pa.table({"print": pa.array(prints[n >= LISTED_FROM]), "n": pa.array(n[n >= LISTED_FROM])})

    counts = docs.mapInArrow(pack, "bucket int, prints binary, counts binary").groupBy("bucket").applyInArrow(count, "print long, n long")
    top = head_rows(materialize(counts), "n", LISTED).toArrow()
    prints, n = (top.column(k).to_numpy() for k in ("print", "n"))
    order = np.argsort(prints)
    return prints[order], n[order]


def class_counts_of(size: int, percent: int) -> set[int]:
    """How many classes the frequent tokens of a set go into: for its own size, and for the largest set that is similar to it.

    Sizes are rounded down to powers of two, so two similar sets always have one number in common.
    """
    prefix = lambda n: n - (percent * n + 99) // 100 + 1
    return {max(1, prefix(1 << (n.bit_length() - 1)) // CLASS) for n in (size, 100 * size // percent)}


ENTRIES = "key long, node long, size int, reach int, spread boolean"


def index_entries(docs: DataFrame, prints: np.ndarray, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """The index: keys of each set's prefix. ``reach``: the most tokens that a pair can share if this key is its first."""
    shared = docs.sparkSession.sparkContext.broadcast((prints, counts))  # at most LISTED entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, counts = shared.value
        for table in pieces(batches):
            bounds, tokens = shingle_sets(texts(table), width)
            nodes, sizes = node_ids(bounds, tokens), np.diff(bounds)
            n = np.zeros(len(tokens), np.int64)
            if len(prints) and len(tokens):
                own = (tokens >> np.uint64(64 - PRINT_BITS)).astype(np.int64)
                at = np.minimum(np.searchsorted(prints, own), len(prints) - 1)
                n = np.where(prints[at] == own, counts[at], 0)
            out: list[tuple[np.ndarray, ...]] = []
            seen: set[int] = set()
            for k in range(len(nodes)):
                size = int(sizes[k])
                if size < 2 or int(nodes[k]) in seen:  # a set of one token is similar to equal sets only
                    continue
                seen.add(int(nodes[k]))
                t, c = tokens[bounds[k] : bounds[k + 1]], n[bounds[k] : bounds[k + 1]]
                for entry in prefix_keys(t, c, size - (percent * size + 99) // 100 + 1, class_counts_of(size, percent)):
                    out.append((*entry, np.full(len(entry[0]), k)))
            if out:
                keys, reaches, spreads, at = (np.concatenate([x[j] for x in out]) for j in range(4))
                yield from pa.Table.from_arrays(
                    [pa.array(keys.astype(np.int64)), pa.array(nodes[at]), pa.array(sizes[at].astype(np.int32)), pa.array(reaches.astype(np.int32)), pa.array(spreads)],
                    names=[x.split()[0] for x in ENTRIES.split(", ")],
                ).to_batches(max_chunksize=100_000)

    return docs.mapInArrow(run, ENTRIES)


def prefix_keys(tokens: np.ndarray, counts: np.ndarray, prefix: int, class_counts: set[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of one set with their reach, and whether a key is very frequent."""
    size = len(tokens)
    order = np.argsort(counts, kind="stable")[: prefix + max(class_counts)]
    t, c = tokens[order], counts[order]
    rare = int(np.searchsorted(c, FREQUENT_FROM))
    if rare:
        yield t[:rare], size - np.arange(rare), c[:rare] >= SPREAD_FROM
    for classes in class_counts:
        f, n = t[rare : prefix + classes], c[rare : prefix + classes]
        if len(f) < 2:
            continue
        kind = (mix(f + np.uint64(classes)) % np.uint64(classes)).astype(np.int64)
        by = np.argsort(kind, kind="stable")
        members = np.bincount(kind, minlength=classes)
        begin = np.cumsum(members) - members
        place = np.arange(len(f)) - begin[kind[by]]  # of each token in its class
        ends = np.repeat(np.arange(len(f)), place)  # the second token of each pair
        starts = np.arange(len(ends)) - np.repeat(np.cumsum(place) - place, place) + begin[kind[by]][ends]
        i, j = by[starts], by[ends]
        key = mix(f[i] * np.uint64(0x9E3779B97F4A7C15) + mix(f[j] + np.uint64(classes)))
        yield key, size - rare - (place[ends] - 1), (n[i] >= SPREAD_FROM) & (n[j] >= SPREAD_FROM)


FOUND = "a long, b long, key long, node long, size int, reach int, spread boolean"


def pivot_pairs(table: pa.Table, percent: int) -> list[pa.Table]:
    """From whole runs of equal keys, sorted by size and node: pairs with pivots, and the entries of runs of three sets or more."""
    key, node, size, reach = (table.column(c).to_numpy() for c in ("key", "node", "size", "reach"))
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, node, size, reach = key[fresh], node[fresh], size[fresh], reach[fresh]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    run = np.cumsum(new) - 1
    length = np.bincount(run)
    many = length[run] > 1
    if not many.any():
        return []
    key, node, size, reach, run = key[many], node[many], size[many], reach[many], run[many]
    level = np.floor(np.log(size) / np.log(100 / percent)).astype(np.int64)
    head = np.concatenate([[True], (run[1:] != run[:-1]) | (level[1:] != level[:-1])])
    group = np.cumsum(head) - 1
    by_reach = np.lexsort((node, -reach, group))  # the set with the fewest rarer tokens is nearest to the others
    pivots = by_reach[np.flatnonzero(head)]
    to = pivots[group]
    to[pivots[1:]] = pivots[:-1]  # a size class's pivot meets the one before it
    to[pivots[0]] = pivots[0]
    ok = (to != np.arange(len(run))) & (run == run[to])
    ok &= np.minimum(reach, reach[to]) >= overlap_needed(size.astype(np.int64), size[to].astype(np.int64), percent)
    a, b = np.minimum(node, node[to])[ok], np.maximum(node, node[to])[ok]
    more = length[run] > 2
    nothing = lambda n, kind: pa.nulls(n, kind)
    names = [x.split()[0] for x in FOUND.split(", ")]
    return [
        pa.Table.from_arrays([pa.array(a), pa.array(b), nothing(len(a), pa.int64()), nothing(len(a), pa.int64()), nothing(len(a), pa.int32()), nothing(len(a), pa.int32()), nothing(len(a), pa.bool_())], names=names),
        pa.Table.from_arrays([nothing(more.sum(), pa.int64()), nothing(more.sum(), pa.int64()), pa.array(key[more]), pa.array(node[more]), pa.array(size[more]), pa.array(reach[more]), pa.array(np.zeros(int(more.sum()), bool))], names=names),
    ]


def candidates(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (``a``, ``b``) with pivots and the entries (``key``, ``node``, ``size``, ``reach``) of longer lists."""
    salt = F.when(F.col("spread"), F.pmod("node", F.lit(64))).otherwise(F.lit(0))  # lists of very frequent keys are dealt out
    dealt = entries.withColumn("salt", salt).repartition("key", "salt").drop("salt").sortWithinPartitions("key", "size", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        names = [x.split()[0] for x in FOUND.split(", ")]
        for batch in batches:
            if (hot := batch.filter(batch.column("spread"))).num_rows:
                columns = [pa.nulls(hot.num_rows, pa.int64())] * 2 + [hot.column(c) for c in ("key", "node", "size", "reach", "spread")]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                batch = batch.filter(pc.invert(batch.column("spread")))
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 200_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
            for made in pivot_pairs(table.slice(0, cut), percent) if cut else []:
                yield from made.to_batches()
            rest = table.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
        if rows:
            for made in pivot_pairs(pa.Table.from_batches(held).combine_chunks(), percent):
                yield from made.to_batches()

    near = materialize(dealt.mapInArrow(run, FOUND))
    hot = near.where("spread").select("key", "node", "size", "reach").withColumn("level", F.floor(F.log("size") / float(np.log(100 / percent))))
    pivots = materialize(hot.groupBy("key", "level").agg(F.min_by(F.struct("size", "node", "reach"), F.struct(-F.col("reach"), "node")).alias("p")))
    met = hot.hint("merge").join(pivots, ["key", "level"]).where(passes("size", "reach", "p.size", "p.reach", percent) & (F.col("node") != F.col("p.node")))
    below = pivots.select("key", (F.col("level") + 1).alias("level"), F.col("p").alias("q"))
    chained = pivots.join(below, ["key", "level"]).where(passes("p.size", "p.reach", "q.size", "q.reach", percent) & (F.col("p.node") != F.col("q.node")))
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    pairs = met.select(*pair("node", "p.node")).unionByName(chained.select(*pair("p.node", "q.node")))
    return near.select("a", "b").where("a is not null").unionByName(pairs), near.where("key is not null").select("key", "node", "size", "reach")


def passes(size_a: str, reach_a: str, size_b: str, reach_b: str, percent: int):
    """Length and position bounds of a pair that meets at a key."""
    total = (F.col(size_a) + F.col(size_b)).cast("long") * percent
    return (F.least(reach_a, reach_b) * (100 + percent) >= total) & (F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent)


def open_lists(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of lists whose sets lie in two components or more, with ``label`` and the list's largest component (``main``)."""
    named = entries.hint("merge").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = named.groupBy("key", "label").count()
    main = counts.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    return materialize(named.hint("merge").join(materialize(main.select("key", "main")), "key"))


def across(lists: DataFrame, percent: int) -> DataFrame:
    """Every pair in a list whose sets lie in different components and pass the bounds.

    The list's largest component meets only the others, so a list of mostly linked sets costs its exceptions times its length.
    """
    x, y = lists.where("label <> main").hint("merge").alias("x"), lists.alias("y")  # Spark splits long lists
    differ = (F.col("x.key") == F.col("y.key")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.label") < F.col("y.label")))
    met = x.join(y, differ & passes("x.size", "x.reach", "y.size", "y.reach", percent))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def sides(pairs: DataFrame) -> DataFrame:
    """The distinct nodes of pairs."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def sets_of(needed: DataFrame, docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """``node`` and packed ``tokens`` of the needed nodes, made anew from the texts of their representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            bounds, tokens = shingle_sets(texts(table), width)
            node = node_ids(bounds, tokens)
            at = np.flatnonzero(node == table.column("node").to_numpy())
            sets = pa.array([tokens[bounds[k] : bounds[k + 1]].tobytes() for k in at], pa.binary())
            yield from pa.Table.from_arrays([pa.array(node[at]), sets], names=["node", "tokens"]).to_batches(max_chunksize=500)

    wanted = materialize(needed.join(reps, "node").withColumnRenamed("rep", "doc_id"))
    if wanted.count() <= MAX_BROADCAST:  # two numbers a row; more are joined by a shuffle of the texts
        wanted = F.broadcast(wanted)
    sets = docs.join(wanted, "doc_id").select("text", "node").mapInArrow(run, "node long, tokens binary")
    return materialize(sets.dropDuplicates(["node"]))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes whose sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.hint("merge").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.hint("merge").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    return materialize(both.mapInArrow(compare, "a long, b long"))


def linked(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``component_id`` (the smallest doc_id that links reach from it) and ``text_hash``."""
    docs = docs.select(integer_ids(docs, doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    thin = materialize(nodes_of(docs, width))
    docs = docs.drop("text_hash")
    reps = materialize(thin.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    prints, counts = token_counts(docs, width, thin.agg(F.sum("n_shingles")).first()[0] or 0)
    pairs, lists = candidates(index_entries(docs, prints, counts, width, percent), percent)
    checked, entries = materialize(pairs.distinct()), lists.distinct()
    sets = sets_of(sides(checked), docs, reps, width)
    links = verified(checked, sets, percent)
    late = materialize(across(open_lists(entries, components(links)), percent).join(checked, ["a", "b"], "left_anti"))
    more = sets_of(sides(late).join(sets, "node", "left_anti"), docs, reps, width)
    labels = materialize(components(links.unionByName(verified(late, sets.unionByName(more), percent))).join(reps, "node"))
    least = materialize(labels.groupBy("label").agg(F.min("rep").alias("component_id")))
    moved = labels.hint("merge").join(least, "label").select("node", "component_id")
    to = materialize(reps.join(moved, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id")))
    out = thin.hint("merge").join(to, "node", "left")  # Spark splits a set that many documents have
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"), "text_hash")
