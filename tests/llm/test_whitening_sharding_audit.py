"""Whitening, hash-tree sharding and the source audit against brute force, with odd rows."""

import collections
import math
import random
import re
import zlib
from hashlib import md5

import numpy as np
import pytest

from terrafold.llm import hash_tree, source_audit, whitening
from terrafold.llm.hash_tree import Leaf

VECTORS = "vec_id long, embedding array<float>, component string, n int"


def brute_whitening(vectors, components=16):
    """Moments in Python integers, covariance centred before multiplying."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, sums = len(fit), fit.sum(0)
    centred = fit * n - sums
    scatter = np.array((centred.T @ centred / n), float) / n**2  # centred is n (x - mean)
    values, vectors = np.linalg.eigh(scatter)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = [i for i in range(min(components, len(values))) if values[i] > 1e-11 * values[0]]
    rows = np.array(x, object) * n - sums
    return n, (rows**2).sum(1), (rows.astype(float) / n) @ vectors[:, k] / np.sqrt(values[k]), values[k] / np.trace(scatter)


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(7)
    good = rng.normal(0, 0.3, (90, 5)).astype(np.float32)
    good[:, 4] = good[:, 0]  # one dimension too many
    good = np.concatenate([good, good[:20], np.repeat(good[:1], 40, 0)])
    rows = [(k % 100, v.tolist(), "x", 1) for k, v in enumerate(good)]
    bad = [(1, None, "x", 1), (2, [1.0, None, 1.0, 1.0, 1.0], "x", 1), (3, [float("nan")] * 5, "x", 1), (4, [math.inf] * 5, "x", 1), (5, [], "x", 1), (6, [1.0, 2.0], "x", 1), (7, [3e38] * 5, "x", 1)]
    df = spark.createDataFrame(rows + bad, VECTORS).repartition(5)
    got = whitening.whiten(df).collect()
    n, deviation, whitened, explained = brute_whitening(good)
    assert len(whitened[0]) == 4 and len(got) == len(good) * 4
    assert {r["n"] for r in got} == {n} and n <= 90 and {r["component"] for r in got} == {1, 2, 3, 4}
    want = collections.Counter((k % 100, int(d)) for k, d in enumerate(deviation))
    assert collections.Counter((r["vec_id"], int(r["deviation"])) for r in got if r["component"] == 1) == want
    for c in range(4):
        mine = sorted((r["vec_id"], round(abs(r["whitened"]), 6)) for r in got if r["component"] == c + 1)
        assert np.allclose([m[1] for m in mine], [b for _, b in sorted((k % 100, abs(w[c])) for k, w in enumerate(whitened))], atol=1e-5)
        assert all(abs(r["explained"] / explained[c] - 1) < 1e-9 for r in got if r["component"] == c + 1)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_of_little(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(empty).count() == 0 and whitening.whiten(empty).columns[0] == "vec_id"
    same = spark.createDataFrame([(k, [1.0, 2.0], "x", 1) for k in range(5)], VECTORS)
    assert whitening.whiten(same).count() == 0
    two = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], "x", 1), (2, [1.5, 2.0], "x", 1)], VECTORS)).collect()
    assert sorted((r["vec_id"] is None, r["component"], round(abs(r["whitened"]), 9)) for r in two) == [(False, 1, 1.0), (True, 1, 1.0)]


@pytest.mark.parametrize("spread", [3, 1 << 20, 1 << 45])
def test_products_are_exact(spread):
    rng = random.Random(spread)
    x = np.array([[rng.randrange(-spread, spread) for _ in range(4)] + [17] for _ in range(131)], np.int64)
    n, sums, cross = whitening.batch_moments(x)
    y = x.astype(object)
    assert n == 131 and (sums == y.sum(0)).all() and (cross == y.T @ y).all()


TREE = hash_tree.by_capacity([(k // 4, k // 2 % 2, k, 1.0) for k in range(8)])


def shares(spark, tree, keys=4000):
    df = spark.range(keys)
    return {r["id"]: tuple(r["p"]) for r in df.select("id", hash_tree.place(df["id"], tree).alias("p")).collect()}


def test_tree_moves_keys_only_where_weights_change(spark):
    before = shares(spark, TREE)
    count = collections.Counter(p[2] for p in before.values())
    assert set(count) == set(range(8)) and max(count.values()) < 1.3 * min(count.values())
    grown = shares(spark, hash_tree.by_capacity([(k // 4, k // 2 % 2, k, 1.0) for k in range(9)]))
    moved = {k for k in before if before[k] != grown[k]}
    assert {grown[k][2] for k in moved} == {8} and 0.07 < len(moved) / len(before) < 0.16
    # a shard more in a rack whose own weight is held: only keys of this rack move
    inner = shares(spark, [*TREE, Leaf(1, 1, 9, *next(x for x in TREE if x.rack == 1 and x.region == 1)[3:5], 2.0)])
    moved = {k for k in before if before[k] != inner[k]}
    assert moved and {before[k][:2] for k in moved} == {(1, 1)} and {inner[k][2] for k in moved} == {9}
    # a heavier region draws from others, and changes nothing among those that stay
    heavy = shares(spark, [x._replace(region_weight=8.0) if x.region == 0 else x for x in TREE])
    assert all(heavy[k][0] == 0 for k in before if before[k] != heavy[k])
    closed = shares(spark, [x._replace(shard_weight=0.0) if x.shard == 3 else x for x in TREE])
    assert all(before[k][2] == 3 and closed[k][2] == 2 for k in before if before[k] != closed[k])


def one(key, path, weight):
    """A draw, by hashlib."""
    return -math.log((int(md5(f"{key}/{path}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight


def test_place_by_brute_force(spark):
    tree = hash_tree.by_capacity([(0, 0, 0, 1.0), (0, 1, 1, 2.0), (0, 1, 2, 0.5), (5, 0, 3, 3.0)])
    for key, got in shares(spark, tree, 300).items():
        region = min({x.region: x.region_weight for x in tree}.items(), key=lambda r: (one(key, r[0], r[1]), r[0]))[0]
        rack = min({x.rack: x.rack_weight for x in tree if x.region == region}.items(), key=lambda r: (one(key, f"{region}.{r[0]}", r[1]), r[0]))[0]
        shard = min(((one(key, f"{region}.{rack}.{x.shard}", x.shard_weight), x.shard) for x in tree if (x.region, x.rack) == (region, rack)))[1]
        assert got == (region, rack, shard)
    with pytest.raises(ValueError):
        hash_tree.place(spark.range(1)["id"], [x._replace(shard_weight=0.0) for x in tree])
    with pytest.raises(ValueError):
        hash_tree.place(spark.range(1)["id"], [*tree, tree[0]])


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(None, "a", 1), (None, None, 2), (3, "", 1), (3, "é", 1), (3, "é", 1)] + [(7, "same", k) for k in range(500)] + [(k, "x" * k, k) for k in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(7)
    got = hash_tree.shards(docs, TREE, bucket_rows=16).collect()
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(map(tuple, hash_tree.shards(docs, TREE, bucket_rows=1 << 16).drop("slot").collect()), key=str) == sorted((tuple(r)[:6] + tuple(r)[7:] for r in got), key=str)
    assert len({(r["region"], r["rack"], r["shard"]) for r in got if r["doc_id"] == 7}) == 1
    assert hash_tree.shards(docs.limit(0), TREE).count() == 0
    hash_tree.write_shards(docs, TREE, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == len(rows) and back.where("slot is null").count() == 0
    assert {(r["doc_id"], r["_shard"]) for r in back.select("doc_id", "_shard").collect()} == {(r["doc_id"], r["shard"]) for r in got}


def brute_audit(rows, min_docs=3, top=200):
    cut = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(lang or "", source or "", cut(text)) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, c in held.items() if c >= min_docs)
        whole = collections.Counter(t for d in mine for t in d[2] if held[t] >= min_docs)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        count = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2] if held[t] >= min_docs) for s in {d[1] for d in mine}}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            parts = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in p if o != s], "term": [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[: top if part == "term" else None]
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)}
    return out


AUDITED = "text string, lang string, source string, rank int, value string, doc_id long"


@pytest.mark.parametrize("top", [3, 200])
def test_audit_by_brute_force(spark, monkeypatch, top):
    rng = random.Random(5)
    words = ["The", "the,", "the-the", "éa", "ÉA", "x y", "...", "42", "a1b", "中文", "I'm", "zebra", "Zebra!", "qu"] + [f"w{c}" for c in "abcdefghij"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(1, 40))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "é", None])) for _ in range(120)]
    rows += [(None, "en", "d"), ("", "xx", "only"), ("...", "xx", "other"), ("lone word", "yy", "one"), ("the\x0bthe\tthe\r\nthe", "en", "a"), ("z" * 30_000, "fr", "b"), (rows[0][0], "en", "a"), (rows[0][0], "en", "a")]
    df = spark.createDataFrame([(*r, 1, "v", None) for r in rows], AUDITED).repartition(6)
    monkeypatch.setattr(source_audit, "HELD", 40)
    got = source_audit.audit(df, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert set(map(tuple, got.collect())) == brute_audit(rows, top=top)


def test_audit_of_nothing_and_large_counts(spark):
    assert source_audit.audit(spark.createDataFrame([], AUDITED)).count() == 0
    big = np.array([[0, 9_300_000_000, 5]], np.int64)
    want = [1 + 10**9 * (int(c) + 1) // 10_000_000_007 for c in big[0]]
    assert source_audit.shares(big, np.full(big.shape, 10_000_000_007)).tolist() == [want]


def test_packed_entries_come_back():
    e = source_audit.Entries(source_audit.pa.array(["a", "é", "", "long word"], source_audit.pa.large_string()), *(np.array(x, np.int64) for x in ([0, 0, 1, 3], [2, 5, 0, 1], [1, 1 << 40, 3, 4], [1, 2, 3, 1], [7, 7, 0, 1 << 50], [7, 9, 0, 1 << 50])))
    back = [source_audit.unpacked(data) for _, data in source_audit.packed(e, 3)]
    rows = {(k, *map(int, r)) for b in back for k, *r in zip(b.keys.take(source_audit.pa.array(b.key)).to_pylist(), *b[2:], strict=True)}
    assert rows == {(k, *map(int, r)) for k, *r in zip(e.keys.take(source_audit.pa.array(e.key)).to_pylist(), *e[2:], strict=True)}


def test_documents_unite_exactly():
    rng = random.Random(3)
    for _ in range(50):
        sets = [set(rng.sample(range(6), rng.randrange(1, 5))) for _ in range(rng.randrange(1, 5))]
        n = len(sets)
        columns = [np.zeros(n, np.int64)] * 2 + [np.array(x, np.int64) for x in ([1] * n, [min(len(s), 3) for s in sets], [min(s) if len(s) < 3 else 0 for s in sets], [max(s) if len(s) < 3 else 0 for s in sets])]
        got = source_audit.merged(source_audit.Entries(source_audit.pa.array(["k"], source_audit.pa.large_string()), *columns), 1)
        assert got.documents.tolist() == [min(3, len(set().union(*sets)))] and got.occurrences.tolist() == [n]
