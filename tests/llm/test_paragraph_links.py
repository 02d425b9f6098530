"""Near links of the paragraph dedup: groups of equal rows, dealt keys, boilerplate lines, and recall by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from terrafold.llm import paragraph_dedup

WORDS = [f"w{k}" for k in range(6000)]


def some(rng, n):
    return rng.choices(WORDS, k=n)


def frame(spark, rows):
    return spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(5)


def clusters(df):
    return {r["doc_id"]: r["cluster"] for r in paragraph_dedup.repeated_passages(df).collect()}


@pytest.mark.parametrize("part_rows", [2048, 16])
def test_equal_pairs_that_are_similar_to_each_other(spark, monkeypatch, part_rows):
    """Documents 1 and 2 share 98 words, 3 and 4 share them with one word changed: all four are one cluster."""
    monkeypatch.setattr(paragraph_dedup, "SAMPLED", 1)
    monkeypatch.setattr(paragraph_dedup, "PART_ROWS", part_rows)
    rng, rows = random.Random(1), []
    for k in range(60):
        p = some(rng, 98)
        q = [*p[:49], "changed", *p[50:]]
        for j, part in enumerate((p, p, q, q)):
            rows.append((10 * k + j, some(rng, rng.randrange(60)) + part + some(rng, rng.randrange(60))))
    got = clusters(frame(spark, rows))
    assert sum(all(got.get(10 * k + j) == 10 * k for j in range(4)) for k in range(60)) >= 58


@pytest.mark.parametrize(("sampled", "part_rows"), [(64, 2048), (1, 2048), (1, 64)])
def test_many_variants_are_one_cluster_however_they_are_dealt(spark, monkeypatch, sampled, part_rows):
    monkeypatch.setattr(paragraph_dedup, "SAMPLED", sampled)
    monkeypatch.setattr(paragraph_dedup, "PART_ROWS", part_rows)
    rng = random.Random(2)
    p = some(rng, 98)
    rows = [(k, some(rng, rng.randrange(40)) + [*p[: k % 98], f"v{k}", *p[k % 98 + 1 :]] + some(rng, 30)) for k in range(400)]
    docs = frame(spark, rows)
    keys, parts = paragraph_dedup.frequent_keys(docs.withColumn("t", F.xxhash64("text")), 50, 2)
    assert (len(keys) > 0) == (sampled == 1) and (not len(parts) or (parts.max() > 1) == (part_rows == 64))
    got = paragraph_dedup.repeated_passages(docs).collect()
    assert len({r["doc_id"] for r in got}) >= 398 and {r["cluster"] for r in got if r["doc_id"]} == {0}
    assert {r["doc_id"] for r in got if not r["removed"]} == {0}


def test_pairs_alone_in_their_parts(spark, monkeypatch):
    """Two texts of a frequent line that are similar, not equal, and like no others are linked in whichever parts they are."""
    monkeypatch.setattr(paragraph_dedup, "SAMPLED", 1)
    monkeypatch.setattr(paragraph_dedup, "PART_ROWS", 12)
    rng, rows = random.Random(6), []
    line = some(rng, 47)
    for k in range(100):
        start = [f"s{k}a", f"s{k}b", f"s{k}c"]
        rows.append((10 * k, some(rng, 20) + start + line + some(rng, 20)))
        rows.append((10 * k + 1, some(rng, 20) + start + [*line[:25], f"v{k}", *line[26:]] + some(rng, 20)))
    got = clusters(frame(spark, rows))
    assert sum(got.get(10 * k) == got.get(10 * k + 1) == 10 * k for k in range(100)) >= 85
    assert all(c // 10 == d // 10 for d, c in got.items())


def test_far_places_hold_a_common_shingle():
    """Whatever stretch around the anchor, its places there can't all be missing."""
    for passage, percent in ((50, 80), (50, 90), (30, 80), (20, 70)):
        far, reach = set(paragraph_dedup.far_places(passage, percent)), passage - paragraph_dedup.SHINGLE
        for i in range(reach + 1):
            for j in range(max(0, reach - i), reach + 1):
                assert 100 * (sum(x <= i for x in far) + sum(x <= j for x in far)) > (100 - percent) * (i + j + 1)


def test_a_line_below_a_passage_costs_in_proportion(spark, monkeypatch):
    """47 words in many documents with unrelated surroundings are no passage; rows compared grow as the holders."""
    counted, plain = [], paragraph_dedup.common_places
    monkeypatch.setattr(paragraph_dedup, "common_places", lambda x, y, drift: (counted.append(len(x)), plain(x, y, drift))[1])
    rng = random.Random(3)
    line, none = some(rng, 47), (paragraph_dedup.np.zeros(0, int), paragraph_dedup.np.zeros(0, int))
    cost = {}
    for n in (500, 2000):
        docs = frame(spark, [(k, some(rng, 60) + line + some(rng, 60)) for k in range(n)]).withColumn("t", F.xxhash64("text"))
        rows = paragraph_dedup.paragraph_rows(docs, 50, 2, none).orderBy("key", "salt", "t", "at").toArrow().combine_chunks()
        counted.clear()
        assert sum(b.num_rows for b in paragraph_dedup.compared(rows, 50, 80, 3)) == 0
        cost[n] = sum(counted)
    assert cost[2000] <= 5 * cost[500] and cost[2000] <= 12 * 2000


def jaccard(a, b):
    x, y = ({tuple(p[i : i + 5]) for i in range(len(p) - 4)} for p in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_similar_passages(spark):
    """Pairs and larger groups of changed passages: at least 95 of 100 links of similarity 0.8 and more, and nothing among strangers."""
    rng, rows, links, groups = random.Random(4), [], [], {}
    for k in range(150):
        p = some(rng, rng.randrange(60, 140))
        parts = [p]
        for _ in range(rng.choice([1, 1, 3])):
            q = list(p)
            for _ in range(rng.choice([1, 1, 2])):
                i = rng.randrange(len(q))
                q[i : i + rng.choice([0, 1])] = [f"n{rng.randrange(10**6)}"] * rng.choice([1, 1, 0])
            parts.append(q)
        for j, part in enumerate(parts):
            rows.append((10 * k + j, some(rng, rng.randrange(50)) + part + some(rng, rng.randrange(50))))
        links += [(10 * k, 10 * k + j) for j in range(1, len(parts)) if jaccard(p, parts[j]) >= 0.8]
        groups[k] = len(parts)
    rows += [(5000 + k, some(rng, 150)) for k in range(100)]
    got = paragraph_dedup.repeated_passages(frame(spark, rows)).collect()
    cluster = {r["doc_id"]: r["cluster"] for r in got}
    assert sum(cluster.get(a, -1) == cluster.get(b, -2) for a, b in links) >= 0.95 * len(links) and len(links) > 150
    assert all(c // 10 == d // 10 for d, c in cluster.items()) and max(cluster) < 5000
    for c in set(cluster.values()):
        mine = [r for r in got if r["cluster"] == c]
        assert c == min(r["doc_id"] for r in mine) and {r["doc_id"] for r in mine if not r["removed"]} == {c}


def chains(rng, n, length):
    """Groups of texts, each made of the one before by a few words, with other words around; some end as their neighbours do."""
    texts = []
    for _ in range(n):
        p, end = some(rng, 90), some(rng, 30)
        for k in range(length):
            if k:
                p = list(p)
                for i in rng.sample(range(len(p)), rng.choice([0, 1, 1, 2])):
                    p[i] = f"n{rng.randrange(10**6)}"
            texts.append(some(rng, rng.randrange(40)) + p + (end if rng.random() < 0.3 else some(rng, rng.randrange(40))))
    return texts


def longest(x, y, anchor=45, drift=3):
    """By brute force: first and last places, in both, of the longest similar stretch around the anchor of two rows of shingles (None: outside)."""
    common = lambda x, y: [i for i, s in enumerate(x) if s is not None and s in y[max(0, i - drift) : i + drift + 1]]
    mine, theirs = common(x, y), common(y, x)
    best = None
    for a in mine:
        for b in reversed(mine):
            if a > anchor or b < anchor or b - a + 5 < 50 or (best and b - a <= best[1] - best[0]):
                continue
            inner = [i for i in theirs if a - drift <= i <= b + drift]
            one, other = set(x[a : b + 1]), set(y[inner[0] : inner[-1] + 1])
            if inner[-1] - inner[0] + 5 >= 50 and 100 * len(one & other) >= 80 * len(one | other):
                best = a, b, inner[0], inner[-1]
    return best


def test_every_two_similar_rows_of_a_key_are_linked_as_far_as_they_go(spark):
    """Also those that are similar to followers alone, not to the row that was first."""
    import numpy as np
    import pyarrow as pa

    none = (np.zeros(0, int), np.zeros(0, int))
    docs = frame(spark, list(enumerate(chains(random.Random(8), 12, 10)))).withColumn("t", F.col("doc_id"))
    table = paragraph_dedup.paragraph_rows(docs, 50, 2, none).orderBy("key", "salt", "t", "at").toArrow().combine_chunks()
    checked = beyond = 0
    for key in table.column("key").unique().to_pylist():
        rows = table.filter(pa.compute.equal(table.column("key"), key)).combine_chunks()
        t, at = rows.column("t").to_pylist(), rows.column("at").to_pylist()
        if len(set(t)) < len(t) or len(t) < 3:
            continue
        shown = [[s or None for s in x] for x in paragraph_dedup.shingles_of(*paragraph_dedup.laid_out(rows, 45)).tolist()]
        want, pairs, got, links = {}, set(), {}, set()
        for i in range(len(t)):
            for j in range(len(t)):
                if i < j and (s := longest(shown[i], shown[j])):
                    pairs.add((t[i], t[j]))
                    for r, a, b in ((t[i], s[0], s[1]), (t[j], s[2], s[3])):
                        want[r] = min(a, want.get(r, (a, b))[0]), max(b, want.get(r, (a, b))[1])
        for batch in paragraph_dedup.compared(rows, 50, 80, 3):
            for r in batch.to_pylist():
                links.add((r["a"], r["b"]))
                for x in "ab":
                    a = r[f"start_{x}"] - at[t.index(r[x])] + 45
                    b = a + r[f"n_{x}"] - 5
                    got[r[x]] = min(a, got.get(r[x], (a, b))[0]), max(b, got.get(r[x], (a, b))[1])
        assert got == want
        assert groups(t, links) == groups(t, pairs)
        checked += len(pairs)
        beyond += any(len(g) * (len(g) - 1) // 2 > sum(a in g for a, _ in pairs) for g in groups(t, pairs))
    assert checked > 1000 and beyond > 30


def groups(nodes, links):
    found = {n: {n} for n in nodes}
    for a, b in links:
        if found[a] is not found[b]:
            found[a] |= found[b]
            for n in found[b]:
                found[n] = found[a]
    return sorted(map(sorted, {id(g): g for g in found.values()}.values()))


def test_chains_are_whole_however_they_are_dealt(spark, monkeypatch):
    """Texts similar only to followers, in whichever parts of a frequent key they are."""
    rows, found = list(enumerate(chains(random.Random(9), 10, 30))), []
    for sampled, part_rows in ((10**9, 2048), (1, 6)):
        monkeypatch.setattr(paragraph_dedup, "SAMPLED", sampled)
        monkeypatch.setattr(paragraph_dedup, "PART_ROWS", part_rows)
        found.append({(r["doc_id"], r["cluster"]) for r in paragraph_dedup.repeated_passages(frame(spark, rows)).collect()})
    assert found[0] == found[1] and len(found[0]) > 280
    assert len({c for _, c in found[0]}) < 25


@pytest.mark.parametrize("parts", [1, 4])
def test_components_of_a_key_are_whole_in_whichever_parts_its_rows_are(spark, monkeypatch, parts):
    """Each key alone, as if its texts were in no other: rows similar only to followers, in the same part or another."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(paragraph_dedup, "PART_ROWS", 4)
    none = (np.zeros(0, int), np.zeros(0, int))
    docs = frame(spark, list(enumerate(chains(random.Random(11), 8, 12)))).withColumn("t", F.col("doc_id"))
    table = paragraph_dedup.paragraph_rows(docs, 50, 2, none).orderBy("key", "t", "at").toArrow().combine_chunks()
    rows, want = [], []
    for k, key in enumerate(table.column("key").unique().to_pylist()):
        own = table.filter(pa.compute.equal(table.column("key"), key)).combine_chunks()
        t = [1000 * k + x for x in own.column("t").to_pylist()]
        if len(set(t)) < len(t) or len(t) < 3:
            continue
        shown = [[s or None for s in x] for x in paragraph_dedup.shingles_of(*paragraph_dedup.laid_out(own, 45)).tolist()]
        pairs = {(t[i], t[j]) for i in range(len(t)) for j in range(i) if longest(shown[i], shown[j])}
        want += [g for g in groups(t, pairs) if len(g) > 1]
        rows += [(r["key"], n % parts, x, r["at"], r["lead"], bytes(r["around"])) for n, (x, r) in enumerate(zip(t, own.to_pylist(), strict=True))]
    dealt = spark.createDataFrame(rows, paragraph_dedup.ROWS)
    links = {(r["a"], r["b"]) for r in paragraph_dedup.verified(dealt, 50, 80, 3).collect()}
    assert [g for g in groups([r[2] for r in rows], links) if len(g) > 1] == sorted(want) and len(want) > 30
