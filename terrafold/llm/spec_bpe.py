"""BPE by speculate and verify, and decoding.

Greedy longest match proposes the tokens of every distinct piece, by a trie walked for all pieces at once. A
proposal is the exact encoding if each pair of neighbouring tokens is compatible: no merge across their border
comes before the merges that close the two sides. The border sides of a token are its spines (last or first parts,
each alive from its own merge to its parent's), so all distinct pairs are tested by table look-ups. Only pieces
with an incompatible pair are merged exactly, step by step, again for all of them at once.

Rules for odd input: null text counts as empty and gives no tokens; repeated rows are encoded each on its own;
input columns named like the added ones are replaced; added tokens in a text become their ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terrafold.llm.common import pieces, texts
from terrafold.llm.pretoken import Pieces, Vocabulary, byte_characters, cut, take_ragged

NEVER = np.int64(1) << 40
#: Pairs with a known verdict that a task keeps.
KNOWN_PAIRS = 1 << 20
#: Text bytes encoded at a time: the arrays beside a text take about twenty times its bytes.
PIECE_BYTES = 2 << 20


class HashTable:
    """Open addressing from uint64 keys to int64 values, looked up by arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys, self.values = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, -1, np.int64)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.values[at[left]] == -1
            slots, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.keys[slots], self.values[slots] = keys[won], values[won]
            left = np.setdiff1d(left, won)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is absent."""
        at = self.slot(keys)
        held, out = self.keys[at], self.values[at]
        open_ = np.flatnonzero((held != keys) & (out != -1))
        out[held != keys] = -1
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held, value = self.keys[at[open_]], self.values[at[open_]]
            same = held == keys[open_]
            out[open_[same]] = value[same]
            open_ = open_[~same & (value != -1)]
        return out


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


class Bpe:
    """Tables of a vocabulary. Ranks order the merges; single bytes have rank -1."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        model = vocabulary.spec["model"]
        ids, characters = model["vocab"], byte_characters()
        to_byte = {c: b for b, c in enumerate(characters)}
        self.size = max([*ids.values(), *vocabulary.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, k in ids.items():
            self.bytes[k] = bytes(to_byte[c] for c in token)
        for token, k in vocabulary.added.items():
            self.bytes[k] = token.encode()
        self.spelled = pa.array(self.bytes, pa.large_binary())
        self.of_byte = np.array([ids[c] for c in characters], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.made = made
        self.merge_rank = HashTable(paired(left, right), np.arange(len(merges), dtype=np.int64))
        self.rank = np.full(self.size, -1, np.int64)
        self.children = np.full((self.size, 2), -1, np.int64)
        for r in range(len(merges) - 1, -1, -1):  # the earliest merge makes a token
            self.rank[made[r]], self.children[made[r]] = r, (left[r], right[r])
        twice = np.bincount(made, minlength=self.size) > 1
        self.first, self.first_end = self.spine(0)
        self.last, self.last_end = self.spine(1)
        self.sound = self.reachable(~twice)
        self.trie(ids.values())

    def spine(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Per token its parts at the border from the token down to a byte, and the rank of the merge that ends each part."""
        parts, ends = [np.arange(self.size)], [np.full(self.size, NEVER)]
        while True:
            child = np.where(parts[-1] >= 0, self.children[parts[-1], side], -1)
            if not (child >= 0).any():
                return np.stack(parts, axis=1), np.stack(ends, axis=1)
            ends.append(np.where(child >= 0, self.rank[parts[-1]], -1))
            parts.append(child)

    def clash(self, a: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Whether a merge across the border of a and b comes up, among those of rank under ``before``."""
        bad = np.zeros(len(a), bool)
        for i in range(self.last.shape[1]):
            some = np.flatnonzero((self.last[a, i] >= 0) & ~bad)
            if not len(some):
                break
            for j in range(self.first.shape[1]):
                some = some[self.first[b[some], j] >= 0]
                if not len(some):
                    break
                rank = self.merge_rank.get(paired(self.last[a[some], i], self.first[b[some], j]))
                bad[some] |= (rank >= 0) & (rank < self.last_end[a[some], i]) & (rank <= self.first_end[b[some], j]) & (rank < before[some])
        return bad

    def reachable(self, once: np.ndarray) -> np.ndarray:
        """Tokens that the encoding of their own bytes gives back."""
        merged = np.flatnonzero(self.rank >= 0)
        ok = once.copy()
        ok[merged] &= ~self.clash(self.children[merged, 0], self.children[merged, 1], self.rank[merged])
        for k in merged[np.argsort(self.rank[merged])]:
            ok[k] &= ok[self.children[k, 0]] and ok[self.children[k, 1]]
        return ok

    def trie(self, ids) -> None:
        nodes: dict[bytes, int] = {b"": 0}
        edges: list[tuple[int, int]] = []
        for k in ids:
            if self.sound[k]:
                for n in range(1, len(self.bytes[k]) + 1):
                    part = self.bytes[k][:n]
                    if part not in nodes:
                        nodes[part] = len(nodes)
                        edges.append((nodes[part[:-1]] * 256 + part[-1], nodes[part]))
        self.token_at = np.full(len(nodes), -1, np.int64)
        for k in ids:
            if self.sound[k]:
                self.token_at[nodes[self.bytes[k]]] = k
        e = np.array(edges, np.int64)
        self.edges = HashTable(e[:, 0].astype(np.uint64), e[:, 1])

    def greedy(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of byte strings, as offsets and ids."""
        at, word = offsets[:-1].copy(), np.arange(len(offsets) - 1)
        end = offsets[1:]
        owners, found = [], []
        word = word[at < end]
        while len(word):
            start = at[word]
            node, best, length = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
            live, depth = np.arange(len(word)), 0
            while len(live):
                live = live[start[live] + depth < end[word[live]]]
                step = self.edges.get((node[live] * 256 + data[start[live] + depth]).astype(np.uint64))
                live, step = live[step >= 0], step[step >= 0]
                node[live] = step
                depth += 1
                token = self.token_at[step]
                hit = live[token >= 0]
                best[hit], length[hit] = token[token >= 0], depth
            owners.append(word)
            found.append(best)
            at[word] += length
            word = word[at[word] < end[word]]
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        ids = (np.concatenate(found) if found else np.zeros(0, np.int64))[order]
        return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))]).astype(np.int64), ids

    def exact(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Plain merging, lowest rank first and leftmost of equals, one merge in every string at a time."""
        ids, word = self.of_byte[data], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        done_ids, done_word = [], []
        while len(ids):
            rank = np.full(len(ids), NEVER)
            inner = np.flatnonzero(word[1:] == word[:-1])
            got = self.merge_rank.get(paired(ids[inner], ids[inner + 1]))
            rank[inner] = np.where(got >= 0, got, NEVER)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            count = np.diff(np.append(starts, len(ids)))
            over = np.repeat(least == NEVER, count)
            done_ids.append(ids[over])
            done_word.append(word[over])
            hits = np.flatnonzero((rank == np.repeat(least, count)) & ~over)
            hits = hits[np.unique(word[hits], return_index=True)[1]]
            ids[hits] = self.made[rank[hits]]
            keep = ~over
            keep[hits + 1] = False
            ids, word = ids[keep], word[keep]
        word, ids = (np.concatenate(done_word), np.concatenate(done_ids)) if done_ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(word, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(offsets) - 1))]).astype(np.int64), ids[order]


def merged_long(bpe: Bpe, data: bytes) -> list[int]:
    """Plain merging of one long string with a heap."""
    import heapq

    ids = bpe.of_byte[np.frombuffer(data, np.uint8)].tolist()
    ahead, back = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
    rank_of = dict(zip(bpe.merge_rank.keys[bpe.merge_rank.values >= 0].tolist(), bpe.merge_rank.values[bpe.merge_rank.values >= 0].tolist(), strict=True))
    heap = [(r, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (r := rank_of.get(ids[k] << 32 | ids[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, k, a, b = heapq.heappop(heap)
        n = ahead[k]
        if ids[k] != a or n < 0 or ids[n] != b:
            continue
        ids[k], ids[n], ahead[k] = int(bpe.made[r]), -1, ahead[n]
        if ahead[k] >= 0:
            back[ahead[k]] = k
        for i, j in ((back[k], k), (k, ahead[k])):
            if i >= 0 and j >= 0 and (r := rank_of.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))
    return [k for k in ids if k >= 0]


class Encoder:
    """Encodes batches of texts and keeps the verdicts on pairs (bounded by ``KNOWN_PAIRS``)."""

    def __init__(self, vocabulary: Vocabulary, long_bytes: int = 256) -> None:
        self.bpe, self.added, self.long_bytes = Bpe(vocabulary), vocabulary.added, long_bytes
        self.known, self.bad = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.proposed = self.failed = 0

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Per neighbouring pair of tokens whether it is compatible; each distinct pair is tested once."""
        key, inverse = np.unique(paired(a, b), return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, key), max(0, len(self.known) - 1))
        new = self.known[at] != key if len(self.known) else np.ones(len(key), bool)
        bad = np.zeros(len(key), bool)
        if len(self.known):
            bad[~new] = self.bad[at[~new]]
        left, right = (key[new] >> np.uint64(32)).astype(np.int64), (key[new] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        bad[new] = self.bpe.clash(left, right, np.full(len(left), NEVER))
        if new.any() and len(self.known) + new.sum() <= KNOWN_PAIRS:
            known, verdicts = np.concatenate([self.known, key[new]]), np.concatenate([self.bad, bad[new]])
            order = np.argsort(known)
            self.known, self.bad = known[order], verdicts[order]
        return ~bad[inverse]

    def words(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each distinct piece."""
        column = pa.array(distinct, pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8).astype(np.int64) if offsets[-1] else np.zeros(0, np.int64)
        at, ids = self.bpe.greedy(offsets, data)
        word = np.repeat(np.arange(len(distinct)), np.diff(at))
        inner = np.flatnonzero(word[1:] == word[:-1])
        wrong = inner[~self.fits(ids[inner], ids[inner + 1])] if len(inner) else inner
        failing = np.unique(word[wrong])
        self.proposed, self.failed = self.proposed + len(distinct), self.failed + len(failing)
        if not len(failing):
            return at, ids
        size = np.diff(offsets)
        short = failing[size[failing] <= self.long_bytes]
        again, part = take_ragged(offsets, data, short)
        again, part = self.bpe.exact(again, part)
        extra = [merged_long(self.bpe, distinct[k].encode()) for k in failing[size[failing] > self.long_bytes]]
        all_at = np.concatenate([at, at[-1] + again[1:], at[-1] + again[-1] + np.cumsum([len(x) for x in extra])]).astype(np.int64)
        source = np.arange(len(distinct))
        source[short] = len(distinct) + np.arange(len(short))
        source[failing[size[failing] > self.long_bytes]] = len(distinct) + len(short) + np.arange(len(extra))
        return take_ragged(all_at, np.concatenate([ids, part, np.array([k for x in extra for k in x], np.int64)]), source)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of each text."""
        found: Pieces = cut(text, self.added)
        at, ids = self.words(found.distinct)
        for k in np.flatnonzero(found.added >= 0):  # added tokens are rare
            at, ids = replaced(at, ids, k, found.added[k])
        unit_at, flat = take_ragged(at, ids.astype(np.int32), found.numbers)
        return unit_at[found.offsets], flat

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The text of each list of ids; bytes that are no UTF-8 become U+FFFD."""
        spelled = self.bpe.spelled.take(pa.array(ids))
        at = np.frombuffer(spelled.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = spelled.buffers()[2].to_pybytes() if len(ids) else b""
        bounds = at[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def replaced(at: np.ndarray, ids: np.ndarray, k: int, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists with list k replaced by one id."""
    shift = np.zeros(len(at), np.int64)
    shift[k + 1 :] = 1 - (at[k + 1] - at[k])
    return at + shift, np.concatenate([ids[: at[k]], [by], ids[at[k + 1] :]])


def encode(docs: DataFrame, vocabulary_path: str, *, text: str = "text", decoded: bool = False) -> DataFrame:
    """Add ``ids`` (array of int) and, if asked for, ``decoded``, the text that the ids give back."""
    return _mapped(docs, vocabulary_path, text, [("ids", T.ArrayType(T.IntegerType()))] + [("decoded", T.StringType())] * decoded)


def digest(docs: DataFrame, vocabulary_path: str, *, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` (of little-endian 32-bit ids) and ``decoded_sha256`` (of the decoded text in UTF-8)."""
    return _mapped(docs, vocabulary_path, text, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())])


def encode_with_digest(docs: DataFrame, vocabulary_path: str, *, text: str = "text") -> DataFrame:
    """``encode`` and ``digest`` in one pass."""
    return _mapped(docs, vocabulary_path, text, [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())])


#: Encoders of this worker by vocabulary: tables are built once in a process, not once in a task.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    if vocabulary.text not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.text] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.text]


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, text: str, added: list) -> Iterator[pa.RecordBatch]:
    """The rows with the columns ``added`` (names and kinds), encoded ``PIECE_BYTES`` at a time."""
    names = {n for n, _ in added}
    for table in pieces(batches, text, PIECE_BYTES):
        encoder = encoder_of(vocabulary)
        offsets, ids = encoder.encode(texts(table, text))
        back = encoder.decode(offsets, ids) if names & {"decoded", "decoded_sha256"} else []
        made = {"n_tokens": lambda: pa.array(np.diff(offsets)), "ids": lambda: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), "decoded": lambda: pa.array(back, pa.string()),
                "ids_sha256": lambda: pa.array([hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]),
                "decoded_sha256": lambda: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])}
        for name, _ in added:
            table = table.append_column(name, made[name]())
        yield from table.combine_chunks().to_batches()


def _mapped(docs: DataFrame, path: str, text: str, added: list) -> DataFrame:
    docs = docs.drop(*(n for n, _ in added))
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path).text)  # read on the driver only; as large as the vocabulary
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in added)])
    return docs.mapInArrow(lambda batches: encoded(batches, Vocabulary(shared.value), text, added), schema)
