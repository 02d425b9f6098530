"""Substring dedup by MinHash bands over paragraphs of 50 words, wherever they begin.

Every run of ``passage`` words is a paragraph, and a set of five-word shingles. Its MinHash in each band is its least
shingle hash. Neighbouring paragraphs mostly share it, so one row stands for all paragraphs around an anchor (a place
where some paragraph has its least shingle): about two anchors for every ``passage`` words and band. Paragraphs of
similarity J collide in one of ``bands`` with probability 1 - (1 - J)**bands (0.96 at J = 0.8 with two; equal ones
always). A row carries the words around its anchor, so colliding paragraphs are verified where they meet and the
texts are read once.

Within the rows of a key, equal paragraphs are found by sorting the hashes of all paragraphs around the anchor, so no
pair of texts that share ``passage`` words in a row is missed and none is enumerated. Then every two rows of different
texts are compared, until they are in one component, as long as the shingles that they have in common with other
components could make a stretch; so every two similar rows of a key end in one component. Rows whose passage could
reach further, by the shingles they have in common with rows of their component, are compared with the holders of the
outermost one, until one of them or none wins it. A row that has nothing in common with others beyond what equals another
row is left to that row. A stretch from the first to the last common shingle counts if it has ``passage`` words and an
exact Jaccard similarity of its shingles of at least ``percent`` % (shingles are of 16 bits of each word); words put in or
left out move the rest by at most ``drift`` places. Overlapping stretches of a text are one passage; linked passages form
components, of which the one in the smallest doc_id stays.

Keys that a sample of the texts shows to be frequent are dealt out over tasks, in parts of about ``PART_ROWS`` rows. Equal
paragraphs of the parts are linked by a distributed aggregate over one row for each distinct paragraph and part. Similar
ones meet twice more: first the leaders of all components of all parts, then all rows that share a shingle far enough from
the anchor (``far_shingles``: similar stretches always do) with a component that is still another one. They are dealt out
so that every two of different components meet, and a task holds two parts. Equal texts are one text until the end.

Rules for odd input: null texts and texts shorter than a passage have none; rows with a null doc_id are left out; rows
of one doc_id count as one document; repeats inside one document are reported only if another document has them too;
repeated rows are reported once; other columns are not used; doc_id must be an integer column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.llm.common import hashed, integer_ids, materialize, mix, owner, pieces, rolled, texts, words
from terrafold.operators.components import components

SHINGLE = 5
ROWS = "key long, salt int, t long, at int, lead int, around binary"
FOUND = "a long, start_a int, n_a int, b long, start_b int, n_b int, h long, key long, lead int, around binary, label long"
#: One text in so many is looked at for frequent keys, which are dealt out in parts of about so many rows.
SAMPLED, PART_ROWS = 64, 2048
#: Base of the rolling hash of a paragraph's words (any odd number).
BASE = 0x9E3779B97F4A7C15
#: Places of one shingle this near to each other are thinned out.
STEP = 20
#: Rows (whole keys) and pairs of rows that are compared at once.
CHUNK, PAIRS = 6_000, 2_000


def named(key: np.ndarray, t: np.ndarray, at: np.ndarray, label: np.ndarray) -> np.ndarray:
    """A hash of the row of each label."""
    return mix(mix(key.astype(np.uint64) + mix(t.astype(np.uint64))) + at.astype(np.uint64))[label].astype(np.int64)


def slid(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = best(x[: len(x) - span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(offsets: np.ndarray, shingle: np.ndarray, passage: int, band: int) -> tuple[np.ndarray, ...]:
    """Places of the least shingles of all paragraphs of all texts, the band's keys there, and where the first and the last paragraph with that least shingle begin."""
    width, n = passage - SHINGLE + 1, len(shingle)
    if n < passage:
        return (np.zeros(0, np.int64),) * 4
    x = mix(shingle + np.uint64(0x632BE59BD9B4E019 * (band + 1) % 2**64))
    least = np.zeros(n, np.uint64)
    least[: n - width + 1] = slid(x, width, np.minimum)
    least[np.arange(n) + passage > offsets[1:][owner(offsets)]] = 0  # a paragraph lies in one text
    top = slid(np.concatenate([np.zeros(width - 1, np.uint64), least]), width, np.maximum)
    at = np.flatnonzero((x == top) & (top > 0))
    at = thinned(at, x[at], owner(offsets)[at])
    first, last = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least])
    for lo in range(0, len(at), 50_000):
        some = at[lo : lo + 50_000]
        own = padded[some[:, None] + np.arange(width)] == x[some][:, None]
        first[lo : lo + 50_000] = some - width + 1 + own.argmax(axis=1)
        last[lo : lo + 50_000] = some - own[:, ::-1].argmax(axis=1)
    return at, mix(x[at] + np.uint64(band + 1)).astype(np.int64), first, last


def thinned(at: np.ndarray, value: np.ndarray, text: np.ndarray) -> np.ndarray:
    """``at`` without most places of a shingle that a text repeats every few words.

    Of a chain of equal shingles at most STEP words apart the first of every STEP words and the last one stay, so each
    paragraph with a place of the chain holds one that stays.
    """
    order = np.lexsort((at, value, text))
    a, v, t = at[order], value[order], text[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (t[1:] != t[:-1]) | (a[1:] - a[:-1] > STEP)])[: len(a)]
    begin = a[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a) else a
    part = (a - begin) // STEP
    keep = new | np.concatenate([[True], part[1:] != part[:-1]])[: len(a)] | np.concatenate([new[1:], [True]])[: len(a)]
    return np.sort(a[keep])


def paragraph_rows(docs: DataFrame, passage: int, bands: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row for each anchor: its ``key``, the text ``t``, the word number ``at``, and ``around``: 16 bits of every word of the paragraphs that have their least shingle there, ``lead`` words of which stand before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            own = table.column("t").to_numpy()
            once = np.sort(np.unique(own, return_index=True)[1])
            table, own = table.take(pa.array(once)), own[once]
            offsets, flat = words(texts(table))
            h = hashed(flat)[0]
            shingle, of, small = rolled(h, SHINGLE), owner(offsets), (h >> np.uint64(48)).astype("<u2")
            for band in range(bands):
                at, key, first, last = anchors(offsets, shingle, passage, band)
                for lo in range(0, len(at), 50_000):
                    p, k = at[lo : lo + 50_000], key[lo : lo + 50_000]
                    text = of[p]
                    lead, n = p - first[lo : lo + 50_000], last[lo : lo + 50_000] - first[lo : lo + 50_000] + passage
                    ends = np.concatenate([[0], np.cumsum(n)])
                    around = small[np.arange(ends[-1]) - np.repeat(ends[:-1], n) + np.repeat(p - lead, n)]
                    packed = pa.BinaryArray.from_buffers(pa.binary(), len(p), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(around)])
                    t = own[text]
                    salt = np.full(len(k), -1, np.int32)
                    if len(frequent[0]):
                        near_key = np.minimum(np.searchsorted(frequent[0], k), len(frequent[0]) - 1)
                        salt = np.where(frequent[0][near_key] == k, t % frequent[1][near_key], -1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(salt), pa.array(t), pa.array((p - offsets[text]).astype(np.int32)), pa.array(lead.astype(np.int32)), packed], names=[c.split()[0] for c in ROWS.split(", ")])

    return docs.select("t", "text").mapInArrow(run, ROWS)


def frequent_keys(docs: DataFrame, passage: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that hold more than a sixteenth of a task's share of the sampled rows (and 32 at least), so at most 16 for each task, and the parts to deal each out in."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sample = paragraph_rows(docs.where(F.pmod("t", F.lit(SAMPLED)) == 0), passage, bands, none)
    counts = materialize(sample.select("key", "t", "at").distinct().groupBy("key").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = sorted((r["key"], -(-r["n"] * SAMPLED // PART_ROWS)) for r in counts.where(F.col("n") >= max(32, total // (16 * tasks))).collect())
    return tuple(np.array([x[k] for x in found], np.int64) for k in (0, 1)) if found else none


def laid_out(table: pa.Table, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words around each anchor in a matrix, the anchor's first word in column ``reach``; first and last column used in each row."""
    around, lead = table.column("around").combine_chunks(), table.column("lead").to_numpy()
    n = pc.binary_length(around).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    first = around.buffers()[1]
    start = np.frombuffer(first, np.int32)[around.offset : around.offset + len(around) + 1]
    data = np.frombuffer(around.buffers()[2], "<u2")[start[0] // 2 : start[-1] // 2]
    out = np.zeros((len(n), 2 * reach + SHINGLE), np.uint16)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(reach - lead, n)] = data
    return out, reach - lead, reach - lead + n


def shingles_of(m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of the matrix's rows; 0 where one would leave the text."""
    width = m.shape[1] - SHINGLE + 1
    out = np.zeros((len(m), width), np.uint64)
    for k in range(SHINGLE):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + m[:, k : k + width].astype(np.uint64) + np.uint64(1))
    column = np.arange(width)
    out[(column < lo[:, None]) | (column + SHINGLE > hi[:, None])] = 0
    return out


def common_places(x: np.ndarray, y: np.ndarray, drift: int) -> np.ndarray:
    """Places of ``x`` whose shingle stands in the same row of ``y``, at most ``drift`` places away."""
    width = x.shape[1]
    out = np.zeros(x.shape, bool)
    for d in range(-drift, drift + 1):
        lo, hi = max(0, d), width + min(0, d)
        out[:, lo:hi] |= x[:, lo:hi] == y[:, lo - d : hi - d]
    return out & (x != 0)


def stretch(x: np.ndarray, y: np.ndarray, mine: np.ndarray, theirs: np.ndarray, anchor: int, passage: int, percent: int, drift: int) -> tuple[int, int, int, int] | None:
    """First and last places in x and y of the longest stretch around the anchor that is similar enough; ``mine`` and ``theirs``: their common places."""
    both, back = np.flatnonzero(mine), np.flatnonzero(theirs)
    cut = np.flatnonzero(np.diff(both) > 1)
    firsts, lasts = both[np.concatenate([[0], cut + 1])], both[np.concatenate([cut, [len(both) - 1]])]
    best = None
    for a in firsts[firsts <= anchor]:
        for b in lasts[lasts >= anchor]:
            if b - a + SHINGLE < passage or (best is not None and b - a <= best[1] - best[0]):
                continue
            inner = back[(back >= a - drift) & (back <= b + drift)]
            if not len(inner):
                continue
            one, other = np.unique(x[a : b + 1]), np.unique(y[inner[0] : inner[-1] + 1])
            common = len(np.intersect1d(one, other, assume_unique=True))
            if inner[-1] - inner[0] + SHINGLE >= passage and 100 * common >= percent * (len(one) + len(other) - common):
                best = (a, b, inner[0], inner[-1])
    return best


def stretches(mine: np.ndarray, theirs: np.ndarray, anchor: int, passage: int, percent: int, drift: int) -> tuple[np.ndarray, ...]:
    """As ``stretch`` for rows that repeat no shingle and have none in common but at these places; the first behind the last if there is none."""
    n, width = mine.shape
    place = np.arange(width)
    sums = np.concatenate([np.zeros((n, 1), np.int16), np.cumsum(mine, axis=1, dtype=np.int16)], axis=1)
    after = np.minimum.accumulate(np.where(theirs, place, 2 * width)[:, ::-1], axis=1)[:, ::-1].astype(np.int16)
    before = np.maximum.accumulate(np.where(theirs, place, -width), axis=1).astype(np.int16)
    opens, closes = mine.copy(), mine.copy()
    opens[:, 1:] &= ~mine[:, :-1]
    closes[:, :-1] &= ~mine[:, 1:]
    a, b = place[: anchor + 1], place[anchor:]
    start, stop = after[:, np.maximum(a - drift, 0)], before[:, np.minimum(b + drift, width - 1)]
    long = (b[None, :] - a[:, None] + 1).astype(np.int16)
    other = stop[:, None, :] - start[:, :, None] + 1
    common = (sums[:, b + 1][:, None, :] - sums[:, a][:, :, None]).astype(np.int32)
    ok = opens[:, a][:, :, None] & closes[:, b][:, None, :] & (long >= passage - SHINGLE + 1) & (other >= passage - SHINGLE + 1) & ((100 + percent) * common >= percent * (long.astype(np.int32) + other))
    best = np.where(ok, long, 0).reshape(n, -1).argmax(axis=1)
    row, (i, j) = np.arange(n), np.divmod(best, len(b))
    found = ok[row, i, j]
    return np.where(found, a[i], width), np.where(found, b[j], -1), start[row, i].astype(np.int64), stop[row, j].astype(np.int64)


KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def batch_of(**columns) -> pa.RecordBatch:
    """Rows of FOUND from some of its columns; the others are null."""
    fields = [c.split() for c in FOUND.split(", ")]
    n = len(next(iter(columns.values())))
    made = [pa.nulls(n, KINDS[kind]) if c not in columns else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c].astype(np.int64)).cast(KINDS[kind]) for c, kind in fields]
    return pa.RecordBatch.from_arrays(made, names=[c for c, _ in fields])


def compared(table: pa.Table, passage: int, percent: int, drift: int) -> Iterator[pa.RecordBatch]:
    """Links among the rows of whole keys, sorted by key, salt, t and at."""
    key, salt, t, at = (table.column(c).to_numpy() for c in ("key", "salt", "t", "at"))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
    fresh = new | np.concatenate([[True], (t[1:] != t[:-1]) | (at[1:] != at[:-1])])  # a text's copies count once
    run = np.cumsum(new) - 1
    texts_in = np.bincount(run, weights=fresh & (new | np.concatenate([[True], t[1:] != t[:-1]])))
    table = table.filter(pa.array(fresh & ((texts_in[run] > 1) | (salt >= 0))))
    if not table.num_rows:
        return
    key, salt, t, at = (table.column(c).to_numpy() for c in ("key", "salt", "t", "at"))
    run = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])) - 1
    reach = passage - SHINGLE
    m, lo, hi = laid_out(table, reach)
    value = mix(np.arange(1, 65537, dtype=np.uint64))
    up = np.cumprod(np.full(m.shape[1], BASE, np.uint64), dtype=np.uint64)
    down = np.cumprod(np.full(reach + 1, pow(BASE, -1, 2**64), np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros((len(m), 1), np.uint64), np.cumsum(value[m] * up, axis=1, dtype=np.uint64)], axis=1)
    paragraph = mix((sums[:, passage : passage + reach + 1] - sums[:, : reach + 1]) * down)  # of its words alone, wherever it stands
    column = np.arange(reach + 1)
    row, begin = np.nonzero((column >= lo[:, None]) & (column + passage <= hi[:, None]))
    same = mix(paragraph[row, begin] ^ mix(key[row].astype(np.uint64)))
    part = mix(same + mix(run[row].astype(np.uint64) + np.uint64(7)))
    order = np.argsort(part, kind="stable")
    row, begin, same, part = row[order], begin[order], same[order], part[order]
    head = np.concatenate([[True], part[1:] != part[:-1]]) if len(part) else np.zeros(0, bool)
    kind = np.cumsum(head) - 1
    first, last = np.flatnonzero(head), np.append(np.flatnonzero(head)[1:], len(head)) - 1
    pivot, at_pivot = row[first][kind], begin[first][kind]
    linked = ~head & (t[row[first]] != t[row[last]])[kind]
    dealt = head & (salt[row] >= 0)
    out: list[tuple[np.ndarray, ...]] = []
    r, p, b, c = row[linked], pivot[linked], begin[linked], at_pivot[linked]
    low = high = low_c = high_c = b
    if len(r):
        order = np.lexsort((p, r))
        r, p, b, c = r[order], p[order], b[order], c[order]
        cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])]))
        (low, high), (low_c, high_c) = ((np.minimum.reduceat(x, cut), np.maximum.reduceat(x, cut)) for x in (b, c))
        r, p = r[cut], p[cut]
        out.append((t[r], at[r] - reach + low, high - low + passage, t[p], at[p] - reach + low_c, high_c - low_c + passage))
    start = given(table, run)
    links, label, leads = near(run, joined(start, r, p), (r, p, low, high, low_c, high_c), "label" not in table.column_names, m, lo, hi, t, at, passage, percent, drift)
    out += links
    if out:
        made = [np.concatenate([x[k] for x in out]) for k in range(6)]
        yield batch_of(**dict(zip(("a", "start_a", "n_a", "b", "start_b", "n_b"), made, strict=True)))
    if "label" in table.column_names:
        known, grown = table.column("label").to_numpy(), np.unique(start)
        grown = grown[label[grown] != grown]
        yield batch_of(label=known[grown], h=known[label[grown]])
    mine = named(key, t, at, label)
    if dealt.any():
        r, b = row[dealt], begin[dealt]
        yield batch_of(a=t[r], start_a=at[r] - reach + b, h=same[dealt].astype(np.int64), label=mine[r])
    known = np.flatnonzero(salt >= 0)
    if len(known):  # the rows of all parts meet once more
        yield batch_of(a=t[known], start_a=at[known], n_a=leads[known], label=mine[known], key=key[known], lead=table.column("lead").to_numpy()[known], around=table.column("around").combine_chunks().take(pa.array(known)))


def given(table: pa.Table, run: np.ndarray) -> np.ndarray:
    """The first row of the component that is known for each row, by the column ``label``; without it every row is its own."""
    own = np.arange(len(run))
    if "label" not in table.column_names:
        return own
    order = np.lexsort((own, table.column("label").to_numpy(), run))
    new = np.concatenate([[True], np.diff(run[order]) != 0]) | np.concatenate([[True], np.diff(table.column("label").to_numpy()[order]) != 0])
    own[order] = order[new][np.cumsum(new) - 1]
    return own


def joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after the components of each two rows became one; a label is the number of a row in its component."""
    while len(x) and (label[x] != label[y]).any():
        a, b = label[x], label[y]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
    return label


def shared(marks: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Marks (0: none) that also stand in a row of another ``who``."""
    flat, own = marks.ravel(), np.repeat(who, marks.shape[1])
    order = np.argsort(flat)
    values, own = flat[order], own[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    several = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
    out = np.empty(len(flat), bool)
    out[order] = np.repeat(several, np.diff(np.append(starts, len(flat))))
    return out.reshape(marks.shape) & (marks != 0)


def reached(common: np.ndarray, repeats: np.ndarray, plain: np.ndarray, anchor: int, passage: int, percent: int, drift: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place that similar stretches around the anchor can reach by the shingles that others have (``common``);
    the first lies behind the last if there can be none.

    A stretch has ``passage`` words and begins and ends at common shingles, and ``percent`` % of its shingles are common. In a
    row that repeats a shingle it needs only the words. If no row of the key does (``plain``), its partner has as many
    shingles, but for ``drift`` at each end, and as many as a passage.
    """
    n, width = common.shape
    span = passage - SHINGLE + 1
    begin, end = np.arange(anchor + 1), np.arange(anchor, width)
    opens, closes = common[:, begin], common[:, end]
    for some, gains, cost, need in ((~repeats, 100, percent, 0), (plain, 100 + percent, 2 * percent, -2 * percent * drift), (plain, 100 + percent, percent, percent * span)):
        gain = np.zeros((int(some.sum()), width + 1), np.int32)
        np.cumsum(gains * common[some].astype(np.int32) - cost, axis=1, out=gain[:, 1:])
        most, least = np.maximum.accumulate(gain[:, ::-1], axis=1)[:, ::-1], np.minimum.accumulate(gain, axis=1)
        opens[some] &= most[:, np.maximum(anchor, begin + span - 1) + 1] >= gain[:, begin] + need
        closes[some] &= gain[:, end + 1] >= least[:, np.maximum(0, np.minimum(anchor, end - span + 1))] + need
    low, high = np.where(opens, begin, width).min(axis=1), np.where(closes, end, -1).max(axis=1)
    none = high - low + 1 < span
    low[none], high[none] = width, -1
    return low, high


def near(run: np.ndarray, label: np.ndarray, equal: tuple[np.ndarray, ...], whole: bool, m: np.ndarray, lo: np.ndarray, hi: np.ndarray, t: np.ndarray, at: np.ndarray, passage: int, percent: int, drift: int) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray, np.ndarray]:
    """Links of rows that are similar enough, the components (``label``) with them, and rows that stand for their component.

    First every two rows of a key that aren't yet in one component are compared, if their common shingles allow a
    stretch; then, with ``whole``, rows of one component, where a longer stretch can be had. ``equal``: rows and the rows they have equal
    paragraphs with, and the first and last begin of these in both. A row that has nothing in common with others beyond
    what equals such a row is left to it.
    """
    n, width, reach = len(run), m.shape[1] - SHINGLE + 1, passage - SHINGLE
    least = -(-2 * percent * (reach + 1) // (100 + percent))  # common shingles of the shortest passage
    out: list[tuple[np.ndarray, ...]] = []
    leads = np.zeros(n, bool)
    shown = shingles_of(m, lo, hi)
    ordered = np.sort(shown, axis=1)
    repeats = ((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] != 0)).any(axis=1)
    del ordered
    plain = np.bincount(run, weights=repeats)[run] == 0  # no row of the key repeats a shingle
    content = np.unique((mix(shown) * np.cumprod(np.full(width, BASE, np.uint64), dtype=np.uint64)).sum(axis=1, dtype=np.uint64), return_inverse=True)[1]
    known: dict[tuple[int, int], tuple[int, int, int, int] | None] = {}  # stretches of rows that repeat shingles
    short = (shown >> np.uint64(32)).astype(np.uint32)  # what pairs are compared by
    first, last = np.full(n, width), np.full(n, -1)  # places of the stretches found

    def widened(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        np.minimum.at(first, x, low)
        np.maximum.at(last, x, high)

    def linked(x: np.ndarray, y: np.ndarray, longer: bool = False) -> np.ndarray:
        """Which rows of ``x`` are similar enough to that of ``y``; with ``longer`` only those that may reach beyond what they have."""
        if not len(x):
            return np.zeros(0, bool)
        low, high = (first[x], last[x]) if longer else (np.full(len(x), width), np.full(len(x), -1))
        _, once, back = np.unique(((content[x] * n + content[y]) * (width + 1) + low) * (width + 1) + high + 1, return_index=True, return_inverse=True)
        found = np.concatenate([ends(x[k], y[k], low[k], high[k]) for k in np.array_split(once, -(-len(once) // PAIRS))], axis=1)
        ok, (a, b, c, d) = found[0, back] == 1, found[1:, back]
        x, y, a, b, c, d = (k[ok] for k in (x, y, a, b, c, d))
        before = first.copy(), last.copy()
        widened(x, a, b)
        widened(y, c, d)
        tells = label[x] != label[y]
        leads[y[tells]] = True
        for u, low, high in ((x, a, b), (y, c, d)):  # of links in a component one for each new end
            for to, reaches, was in ((low, first, before[0]), (high, last, before[1])):
                new = np.flatnonzero((to == reaches[u]) & (to != was[u]))
                tells[new[np.unique(u[new], return_index=True)[1]]] = True
        out.append(tuple(k[tells] for k in (t[x], at[x] - reach + a, b - a + SHINGLE, t[y], at[y] - reach + c, d - c + SHINGLE)))
        return ok

    def ends(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each two rows are similar enough, and the first and last place of their stretch in both."""
        out = np.zeros((5, len(x)), np.int64)
        sx, sy = short[x], short[y]
        mine = common_places(sx, sy, drift)
        some = np.flatnonzero(mine.sum(axis=1) >= least)
        if not len(some):
            return out
        x, y, sx, sy, mine, low, high = x[some], y[some], sx[some], sy[some], mine[some], low[some], high[some]
        theirs = common_places(sy, sx, drift)
        (a, b), (c, d) = ((k.argmax(axis=1), k.shape[1] - 1 - k[:, ::-1].argmax(axis=1)) for k in (mine, theirs))
        common, size = np.minimum(mine.sum(axis=1), theirs.sum(axis=1)), (b - a) + (d - c) + 2
        once = ~repeats[x]
        for k in np.flatnonzero(repeats[x]):
            once[k] = len(np.unique(sx[k, a[k] : b[k] + 1])) == b[k] - a[k] + 1
        good = once & (np.minimum(b - a, d - c) + SHINGLE >= passage) & (100 * common >= percent * (size - common)) & (a <= reach) & (b >= reach)
        both = ~repeats[x] & ~repeats[y]
        begin, end = reached(mine, repeats[x], both, reach, passage, percent, drift)
        parts = np.flatnonzero(~good & (begin <= end) & ((begin < low) | (end > high)))
        ordered = np.sort(np.concatenate([sx[parts], sy[parts]], axis=1), axis=1)
        moved = ((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] != 0)).sum(axis=1) > common[parts]
        simple = both[parts] & ~moved
        for k in parts[~simple]:
            pair = int(content[x[k]]), int(content[y[k]])
            if pair not in known:
                known[pair] = stretch(sx[k], sy[k], mine[k], theirs[k], reach, passage, percent, drift)
            if known[pair] is not None:
                good[k], (a[k], b[k], c[k], d[k]) = True, known[pair]
        for j in range(0, int(simple.sum()), 256):
            k = parts[simple][j : j + 256]
            a[k], b[k], c[k], d[k] = stretches(mine[k], theirs[k], reach, passage, percent, drift)
            good[k] = a[k] <= b[k]
        out[:, some] = np.where(good, np.stack([good, a, b, c, d]), 0)
        return out

    r, p, low, high, low_p, high_p = equal
    widened(r, low, high + reach)
    widened(p, low_p, high_p + reach)
    marks = np.where(shown != 0, mix(shown + mix(run.astype(np.uint64) + np.uint64(3))[:, None]), np.uint64(0))
    begin, end = reached(shared(marks, t), repeats, plain, reach, passage, percent, drift)
    of_text = np.cumsum(np.concatenate([[True], (run[1:] != run[:-1]) | (t[1:] != t[:-1])])) - 1
    _, once, back = np.unique(mix(content.astype(np.uint64) + mix(of_text.astype(np.uint64))), return_index=True, return_inverse=True)
    twin = once[back]  # the first row of the text that is the same all around
    alone = np.bincount(of_text, weights=twin == np.arange(n))[of_text] == 1  # the only other row of its text
    left = (low == low_p) & (high == high_p) & (low <= begin[r]) & (high + reach >= end[r]) & alone[p]
    stays = begin <= end
    stays[r[left]] = False
    stays &= twin == np.arange(n)
    own = np.flatnonzero(stays)
    held = np.bincount(p, minlength=n)
    rest, rounds = own, 1
    while len(rest):
        begin, end = reached(shared(marks[rest], label[rest]), repeats[rest], plain[rest], reach, passage, percent, drift)
        if not (begin <= end).all():
            rest = rest[begin <= end]
            continue
        size = np.bincount(label[rest], minlength=n)[label[rest]]
        rest = rest[np.lexsort((rest, -held[rest] if rounds == 1 else size, run[rest]))]  # small components lead
        for _ in range(rounds):
            head = np.concatenate([[True], run[rest][1:] != run[rest][:-1]])
            lead = rest[head][np.cumsum(head) - 1]
            ask = (label[rest] != label[lead]) & (t[rest] != t[lead])
            x, y = rest[ask], lead[ask]
            ok = linked(x, y)
            label = joined(label, x[ok], y[ok])
            rest = rest[~head]
            if not len(rest) or not len(x):
                break
        rounds *= 2
    rest = own[np.bincount(label[own], minlength=n)[label[own]] > 1]
    if whole and len(rest):
        marks = np.where(shown[rest] != 0, mix(shown[rest] + mix(label[rest].astype(np.uint64) + np.uint64(5))[:, None]), np.uint64(0))
        common, order = shared(marks, t[rest]), np.argsort(marks, axis=None)
        values, holder = marks.ravel()[order], order // width
        begin, end = reached(common, repeats[rest], plain[rest], reach, passage, percent, drift)
        place, turn, missed = np.full(len(rest), -1), np.zeros(len(rest), np.int64), np.zeros(len(rest), np.uint64)
        short_of = lambda x: x[(begin[x] < first[rest[x]]) | (end[x] > last[rest[x]])]
        open_ = short_of(np.arange(len(rest)))
        while len(open_):  # the outermost place that may be won, with one holder of its shingle after the other
            want = np.where(begin[open_] < first[rest[open_]], begin[open_], end[open_])
            turn[open_] = np.where(want == place[open_], turn[open_], 0)
            place[open_] = want
            value = marks[open_, want]
            low, high = np.searchsorted(values, value), np.searchsorted(values, value, "right")
            lost = turn[open_] >= high - low
            if lost.any():  # no holder has a stretch to there
                x = open_[lost]
                common[x, place[x]], missed[x], place[x] = False, value[lost], -1
                begin[x], end[x] = reached(common[x], repeats[rest[x]], plain[rest[x]], reach, passage, percent, drift)
            x, low, size = open_[~lost], low[~lost], (high - low)[~lost]
            if len(x):
                tries = turn[x][:, None] + np.arange(max(1, min(PAIRS // len(x), 4 + int(turn[x].max()))))
                y = holder[low[:, None] + (tries + x[:, None]) % size[:, None]]
                ask = tries < size[:, None]
                turn[x] += tries.shape[1]
                x, y = np.repeat(x, tries.shape[1])[ask.ravel()], y[ask]
                ask = t[rest[x]] != t[rest[y]]
                ask[ask] = ~((marks[y[ask]] == missed[x[ask]][:, None]) & (missed[x[ask]] != 0)[:, None]).any(axis=1)  # those were compared for the place before
                linked(rest[x[ask]], rest[y[ask]], longer=True)
            open_ = short_of(open_)
    x = np.flatnonzero((twin != np.arange(n)) & (last[twin] >= 0))
    label = joined(label, x, twin[x])
    out.append((t[x], at[x] - reach + first[twin[x]], (last - first)[twin[x]] + SHINGLE, t[x], at[twin[x]] - reach + first[twin[x]], (last - first)[twin[x]] + SHINGLE))
    singles = np.bincount(label, minlength=n)[label] == 1
    leads |= singles | (label == np.arange(n))
    return out, label, leads


def far_places(passage: int, percent: int) -> np.ndarray:
    """Steps from the anchor, to each side, at which a similar stretch has a shingle in common with its partner.

    A stretch holds the anchor and at least as many places as a passage has shingles, of which ``percent`` % are common; so
    it covers half of a passage on one side, and the fewest places at the end of that half are taken of which, with those
    it covers on the other side, not all can be missing.
    """
    reach, span = passage - SHINGLE, passage - SHINGLE + 1
    half = -(-(span - 1) // 2)
    i, j = np.meshgrid(np.arange(reach + 1), np.arange(reach + 1))
    fits = i + j + 1 >= span
    for n in range(1, half + 1):
        covered = sum(np.clip(np.minimum(x, half) - (half - n), 0, n) for x in (i, j))
        if (100 * covered > (100 - percent) * (i + j + 1))[fits].all():
            return np.arange(half - n + 1, half + 1)
    return np.arange(1, reach + 1)


def far_shingles(rows: DataFrame, passage: int, percent: int, drift: int) -> DataFrame:
    """``value, row, label``: for each row its shingles at ``far_places`` and ``drift`` around them, all of its shingles if it repeats one."""
    reach, far = passage - SHINGLE, far_places(passage, percent)
    steps = np.arange(max(0, far[0] - drift), min(reach, far[-1] + drift) + 1)
    chosen = np.zeros(2 * reach + 1, bool)
    chosen[np.concatenate([reach - steps, reach + steps])] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                table = pa.Table.from_batches([batch.slice(k, CHUNK)])
                shown = shingles_of(*laid_out(table, reach))
                ordered = np.sort(shown, axis=1)
                repeats = ((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] != 0)).any(axis=1)
                at, place = np.nonzero((shown != 0) & (chosen | repeats[:, None]))
                value = mix(shown[at, place] + mix(table.column("key").to_numpy().astype(np.uint64))[at])
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), table.column("row").combine_chunks().take(pa.array(at)), table.column("label").combine_chunks().take(pa.array(at))], names=["value", "row", "label"])

    return rows.select("key", "label", "lead", "around", "row").mapInArrow(run, "value long, row long, label long")


def met_again(rows: DataFrame, passage: int, percent: int, drift: int) -> DataFrame:
    """Rows of dealt keys that share a far shingle with another component, in parts (``salt`` below -1) in which every two rows of different components meet.

    Rows of a key's largest component stay in their part. The others also move: each of their groups meets every part.
    """
    rows = rows.withColumn("row", F.xxhash64("key", "t", "at"))
    entries = far_shingles(rows, passage, percent, drift)
    shared = materialize(entries.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("value"))  # so that Spark can split a frequent value below
    hopeful = materialize(rows.hint("merge").join(entries.hint("merge").join(shared, "value").select("row").distinct(), "row").drop("row"))
    sizes = hopeful.groupBy("key", "label").agg(F.count("*").alias("n"))
    of_key = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.ceil(F.sum("n") / PART_ROWS).cast("int").alias("parts"), F.greatest(F.ceil((F.sum("n") - F.max("n")) / PART_ROWS), F.lit(1)).cast("int").alias("groups"))
    moves = F.col("label") != F.col("largest")
    dealt = hopeful.join(F.broadcast(of_key), "key")  # one row for each frequent key
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("t", "at"), F.col("parts")).cast("int")).withColumn("group", F.pmod(F.xxhash64("at", "t"), F.col("groups")).cast("int"))
    stay = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.when(moves, F.col("group")).otherwise(F.col("groups") - 1))))
    move = dealt.where(moves).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    salt = -2 - (F.col("group") * F.col("parts") + F.col("part"))
    return stay.unionByName(move).select("key", salt.cast("int").alias("salt"), "t", "at", "lead", "around", "label")


def verified(rows: DataFrame, passage: int, percent: int, drift: int) -> DataFrame:
    """``a, start_a, n_a, b, start_b, n_b``: stretches of two texts that are similar enough."""
    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "t", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key, salt = table.column("key").to_numpy(), table.column("salt").to_numpy()
            cut = int(np.flatnonzero((key != key[-1]) | (salt != salt[-1]))[-1]) + 1 if (key[0], salt[0]) != (key[-1], salt[-1]) else 0
            if cut:  # the last key may go on
                yield from compared(table.slice(0, cut).combine_chunks(), passage, percent, drift)
            held = table.slice(cut).to_batches()
            n = table.num_rows - cut
        if n:
            yield from compared(pa.Table.from_batches(held).combine_chunks(), passage, percent, drift)

    found = materialize(dealt.mapInArrow(run, FOUND))
    every = found.where("around is not null").select("key", F.col("a").alias("t"), F.col("start_a").alias("at"), "lead", "around", "label", F.col("n_a").alias("leads"))
    parts = found.where("h is not null").select("h", "a", "start_a", "label")
    plain = found.where("b is not null")
    if not every.isEmpty():
        again = lambda rows: materialize(met_again(rows, passage, percent, drift).repartition("key", "salt").sortWithinPartitions("key", "salt", "t", "at").mapInArrow(run, FOUND))
        leaders = again(every.where("leads = 1").drop("leads"))  # few of a component, so that most rows needn't meet again
        lowest = parts.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h", "low")
        edges = parts.join(lowest, "h").select(F.col("label").alias("a"), F.col("low").alias("b")).unionByName(leaders.where("a is null").select(F.col("label").alias("a"), F.col("h").alias("b")))
        whole = components(edges.where("a <> b").distinct()).withColumnRenamed("label", "to")
        met = again(every.drop("leads").join(whole, F.col("label") == F.col("node"), "left").withColumn("label", F.coalesce("to", "label")).drop("node", "to"))
        plain = plain.unionByName(leaders.where("b is not null")).unionByName(met.where("b is not null"))
    pivots = parts.groupBy("h").agg(F.min(F.struct("a", "start_a")).alias("p"), F.max("a").alias("top")).where("p.a < top")
    across = parts.drop("label").join(pivots, "h").where("a <> p.a or start_a <> p.start_a").select("a", "start_a", F.col("p.a").alias("b"), F.col("p.start_a").alias("start_b"))
    spans = across.groupBy("a", "b", (F.col("start_b") - F.col("start_a")).alias("shift")).agg(F.collect_set("start_a").alias("s"))
    ranges = spans.select("a", "b", "shift", F.explode(runs_of(F.array_sort("s"), passage)).alias("r"))
    n = F.col("r.hi") - F.col("r.lo") + passage
    wide = ranges.select("a", F.col("r.lo").alias("start_a"), n.alias("n_a"), "b", (F.col("r.lo") + F.col("shift")).alias("start_b"), n.alias("n_b"))
    return materialize(plain.drop("h", "key", "lead", "around", "label").unionByName(wide).distinct())


def runs_of(starts, passage: int):
    """Sorted starts as ranges (``lo``, ``hi``) whose paragraphs overlap."""
    nothing = F.array().cast("array<struct<lo:int,hi:int>>")
    near_last = lambda acc, x: (F.size(acc) > 0) & (x - F.element_at(acc, -1)["hi"] < passage)
    grown = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), x.alias("hi"))))
    return F.aggregate(starts, nothing, lambda acc, x: F.when(F.size(acc) == 0, F.array(F.struct(x.alias("lo"), x.alias("hi")))).when(near_last(acc, x), grown(acc, x)).otherwise(F.concat(acc, F.array(F.struct(x.alias("lo"), x.alias("hi"))))))


def linked_passages(found: DataFrame, whole: DataFrame) -> DataFrame:
    """``t``, ``start_word``, ``n_words``, ``label``: overlapping stretches of a text as one passage, and the component of each. ``whole``: ``t`` and ``n`` of texts that have copies."""
    side = lambda x: found.select(F.col(x).alias("t"), F.col(f"start_{x}").alias("start"), F.col(f"n_{x}").alias("n"))
    sides = side("a").unionByName(side("b")).unionByName(whole.select("t", F.lit(0).alias("start"), F.col("n").cast("int").alias("n"))).distinct()
    in_order = W.partitionBy("t").orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(in_order.rowsBetween(W.unboundedPreceding, -1))
    opened = F.sum(F.when(F.col("reach").isNull() | (F.col("start") >= F.col("reach")), 1).otherwise(0)).over(in_order)
    first = F.min("start").over(W.partitionBy("t", "part"))
    marked = sides.withColumn("reach", reach).withColumn("part", opened).withColumn("first", first)
    marked = materialize(marked.select("t", "start", "n", "first", F.xxhash64("t", "first").alias("passage")))
    end = lambda x: marked.select(F.col("t").alias(x), F.col("start").alias(f"start_{x}"), F.col("n").alias(f"n_{x}"), F.col("passage").alias(f"p_{x}"))
    one = found.hint("merge").join(end("a"), ["a", "start_a", "n_a"]).select("b", "start_b", "n_b", "p_a").distinct()
    edges = one.hint("merge").join(end("b"), ["b", "start_b", "n_b"]).select(F.col("p_a").alias("a"), F.col("p_b").alias("b"))
    labels = components(edges.where("a <> b").distinct())
    passages = marked.groupBy("t", F.col("first").alias("start_word"), "passage").agg(F.max(F.col("start") + F.col("n") - F.col("first")).alias("n_words"))
    return materialize(passages.join(labels, F.col("passage") == F.col("node"), "left").select("t", "start_word", "n_words", F.coalesce("label", "passage").alias("label")))


def repeated_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", passage: int = 50, percent: int = 80, bands: int = 2, drift: int = 3) -> DataFrame:
    """One row per passage that other documents repeat: ``doc_id``, ``start_word``, ``n_words``, ``cluster`` (doc_id of the passage that stays), ``removed``."""
    docs = docs.where(F.col(doc_id).isNotNull()).select(integer_ids(docs, doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("t", F.xxhash64("text"))
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    holders = materialize(docs.select("t", "doc_id", n_words.alias("n")).where(F.col("n") >= passage).distinct())
    copied = holders.groupBy("t", "n").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    rows = paragraph_rows(docs, passage, bands, frequent_keys(docs, passage, bands))
    named = linked_passages(verified(rows, passage, percent, drift), copied)
    out = materialize(named.hint("merge").join(holders.select("t", "doc_id"), "t").drop("t").distinct())
    keepers = materialize(out.groupBy("label").agg(F.min(F.struct("doc_id", "start_word")).alias("k"), F.max("doc_id").alias("top")).where("top <> k.doc_id").drop("top"))
    stays = (F.col("doc_id") == F.col("k.doc_id")) & (F.col("start_word") == F.col("k.start_word"))
    return out.hint("merge").join(keepers, "label").select("doc_id", F.col("start_word").cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), F.col("k.doc_id").alias("cluster"), (~stays).alias("removed"))
