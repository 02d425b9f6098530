"""Small tests of the operators that compare documents, against brute force."""

import collections
import hashlib
import itertools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from terrafold.llm import decontam, jaccard_join, line_dedup, paragraph_dedup
from terrafold.llm import queries as q

LOWER = {c: c + 32 for c in range(65, 91)}
LONG = "This line is long enough to be a key of forty code points."


def run_oracle(name, **tables):
    con = duckdb.connect()
    for table, rows in tables.items():
        con.register(f"{table}_rows", rows.toPandas())
        con.execute(f"create view {table} as select * from {table}_rows")
    return con.execute(q.ORACLES[name]).fetchall()


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = con.execute(q.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = q.QUERIES[name](spark, sf_dir).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_line_dedup_odd_input(spark):
    rows = [(k, f"{LONG}\nown line {k}\n \t{LONG.upper()} ", 1) for k in range(6)] + [(None, LONG, 1), (7, None, 1), (8, "", 1), (3, LONG, 1), (3, LONG, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_dropped int")
    bitmaps = line_dedup.keep_bitmaps(docs)
    out = line_dedup.apply_bitmaps(docs, bitmaps).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] in range(5) and "own" in (r["text"] or ""):
            assert (r["n_lines"], r["n_dropped"], r["kept"]) == (3, 2, f"own line {r['doc_id']}")
        elif r["doc_id"] == 3:
            assert (r["n_dropped"], r["kept"]) == (1, "")
        else:
            assert (r["n_dropped"], r["kept"]) == (0, r["text"] or "")
    none = spark.createDataFrame([], docs.schema)
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).count() == 0


def test_line_dedup_long_runs_and_borders(spark, monkeypatch):
    rows = [(k, "\n".join([LONG, f"Another rather long line that only few of the documents hold {k % 40}."])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    monkeypatch.setattr(line_dedup, "HELD_ROWS", 10)
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()}
    assert got == {k: int(k != 399) + int(k < 360) for k in range(400)}


def windows_hit(doc, items, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, found = cut(doc), set(), set()
    for item, text in items:
        b = cut(text)
        m = min(n, len(b))
        for i in range(len(b) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == b[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(item)
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_by_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:  # as with a benchmark too large for that
        monkeypatch.setattr(decontam, "MAX_BROADCAST_BYTES", -1)
    item = "One two three four five six seven eight nine ten eleven twelve."
    items = [(1, item), (2, "Zebra"), (10, "short item"), (3, None), (4, "!!"), (None, "ghost"), (5, item), (6, "Été naïve Été")]
    texts = [item, "x " + item[:50], "a zebra, a ZEBRA!", "short  ITEM", "item short", None, "", "...", "one two three four five six seven eight nine ten " * 3, "Zebra", "été Naïve été", "Été naïve Été", item]
    docs = spark.createDataFrame([(k if k < 12 else 0, t, 0) for k, t in enumerate(texts)] + [(None, "zebra", 0)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in decontam.report(docs, bench).collect())
    real = [x for x in items if x[0] is not None]
    want = sorted((str(d), *windows_hit(t, real)) for d, t, _ in docs.collect())
    assert got == want
    assert decontam.report(docs.limit(0), bench).count() == 0
    assert not decontam.report(docs, bench.limit(0)).where("contaminated").count()


def jaccard_components(rows, width=5, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    to = list(range(len(rows)))

    def root(k):
        while to[k] != k:
            k = to[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            to[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), d), d)
    return sorted((d, len(sets[k]), least[root(k)]) for k, (d, _) in enumerate(rows))


def test_jaccard_join_by_brute_force(spark, monkeypatch):
    import random

    random.seed(4)
    pool = [f"w{k}" for k in range(300)]
    bases = [[random.choice(pool) for _ in range(n)] for n in (6, 9, 30, 60, 120, 250)]
    rows = [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "two words"), (1005, " \n")]
    for k in range(160):
        w = list(bases[k % 6])
        for _ in range(random.choice([0, 0, 1, 2, 4])):
            w[random.randrange(len(w))] = random.choice(pool)
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_components(rows)
    for frequent, spread, listed, size in ((256, 4096, 16, 5), (3, 6, 2, 5), (2, 2, 2, 3)):
        monkeypatch.setattr(jaccard_join, "CLASS", size)
        monkeypatch.setattr(jaccard_join, "FREQUENT_FROM", frequent)
        monkeypatch.setattr(jaccard_join, "SPREAD_FROM", spread)
        monkeypatch.setattr(jaccard_join, "LISTED_FROM", listed)
        assert sorted(map(tuple, jaccard_join.linked(docs).drop("text_hash").collect())) == want


def test_jaccard_join_odd_input(spark):
    text = " ".join(f"t{k}" for k in range(30))
    docs = spark.createDataFrame([(None, text, 1), (5, text, 1), (5, text, 1), (5, "other words stand here now", 1), (9, text, 1)], "doc_id long, text string, n_shingles int")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.linked(docs).collect())
    assert got == [("5", 1, 5), ("5", 26, 5), ("5", 26, 5), ("9", 26, 5), ("None", 26, 5)]
    assert jaccard_join.linked(docs.limit(0)).count() == 0


def test_passages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    holders = collections.defaultdict(set)
    for r in docs.collect():
        w = (r["text"] or "").translate(LOWER).split()
        for i in range(len(w) - 49):
            holders[tuple(w[i : i + 50])].add(r["doc_id"])
    want = {d for x in holders.values() if len(x) > 1 for d in x}
    got = paragraph_dedup.repeated_passages(docs).collect()
    assert want <= {r["doc_id"] for r in got}
    text, spans = {r["doc_id"]: (r["text"] or "").translate(LOWER).split() for r in docs.collect()}, collections.defaultdict(list)
    for r in got:
        spans[r["doc_id"]].append((r["start_word"], r["start_word"] + r["n_words"]))
    for w, ids in holders.items():  # every place of a repeated run is inside a passage
        if len(ids) > 1:
            for d in ids:
                at = [i for i in range(len(text[d]) - 49) if tuple(text[d][i : i + 50]) == w]
                assert all(any(a <= i and i + 50 <= b for a, b in spans[d]) for i in at)
    cut = lambda d, a, n: {tuple(text[d][i : i + 5]) for i in range(a, a + n - 4)}
    for r in got:  # and a passage without such a run is similar to another of its cluster
        if r["doc_id"] not in want:
            mine = cut(r["doc_id"], r["start_word"], r["n_words"])
            others = [cut(x["doc_id"], x["start_word"], x["n_words"]) for x in got if x["cluster"] == r["cluster"] and x["doc_id"] != r["doc_id"]]
            assert any(100 * len(mine & o) >= 60 * min(len(mine), len(o)) for o in others)
    by = collections.defaultdict(list)
    for r in got:
        by[r["cluster"]].append(r)
        assert r["n_words"] >= 50 and r["cluster"] <= r["doc_id"]
    assert sum(not r["removed"] for r in got) > 0


def random_words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_passages_of_triples_insertions_and_nothing_else(spark, monkeypatch):
    import random

    rng, rows, shared, alone = random.Random(8), [], [], []
    for k in range(60):  # 60 words in documents 2 and 3, 49 of them in document 1
        p = random_words(rng, 60)
        for j, part in enumerate((p[:49], p, p)):
            rows.append((1000 + 3 * k + j, random_words(rng, rng.randrange(80)) + part + random_words(rng, 90)))
        shared.append((1001 + 3 * k, 1002 + 3 * k))
        alone.append(1000 + 3 * k)
    for k in range(60):  # 120 words, two more put in: the Jaccard similarity of their shingles is 0.857
        p = random_words(rng, 120)
        i, j = sorted(rng.sample(range(1, 120), 2))
        rows.append((2000 + 2 * k, random_words(rng, rng.randrange(80)) + p + random_words(rng, 60)))
        rows.append((2001 + 2 * k, random_words(rng, rng.randrange(80)) + p[:i] + ["new"] + p[i:j] + ["extra"] + p[j:] + random_words(rng, 60)))
        shared.append((2000 + 2 * k, 2001 + 2 * k))
    line = random_words(rng, 30)
    for k in range(300):  # a line of 30 words in many documents is no passage
        rows.append((5000 + k, random_words(rng, 70) + line + random_words(rng, 70)))
        alone.append(5000 + k)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    for sampled, chunk in ((64, 20_000), (1, 50)):  # the second deals every key with 32 rows out and compares in small chunks
        monkeypatch.setattr(paragraph_dedup, "SAMPLED", sampled)
        monkeypatch.setattr(paragraph_dedup, "CHUNK", chunk)
        got = paragraph_dedup.repeated_passages(docs).collect()
        cluster = {r["doc_id"]: r["cluster"] for r in got}
        found = [cluster.get(a, -1) == cluster.get(b, -2) for a, b in shared]
        assert all(found[:60]) and sum(found[60:]) >= 57
        assert not set(alone) & set(cluster)
        for r in got:
            assert r["n_words"] <= 130 and r["removed"] == (r["cluster"] != r["doc_id"])


def test_passages_of_a_frequent_key(spark, monkeypatch):
    import random

    rng = random.Random(3)
    p = random_words(rng, 70)
    rows = [(k, " ".join(random_words(rng, rng.randrange(90)) + p + random_words(rng, 40))) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(paragraph_dedup, "SAMPLED", 1)
    assert len(paragraph_dedup.frequent_keys(docs.withColumn("t", F.xxhash64("text")), 50, 2)) > 0
    got = {r["doc_id"]: (r["n_words"], r["cluster"]) for r in paragraph_dedup.repeated_passages(docs).collect()}
    assert len(got) == 500 and {c for _, c in got.values()} == {0} and {n for n, _ in got.values()} <= {70, 71, 72}


def test_passages_need_integer_ids(spark):
    with pytest.raises(TypeError):
        paragraph_dedup.repeated_passages(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_passages_odd_input(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    far = " ".join(f"q{k}" for k in range(60))
    rows = [(1, f"start {passage} end"), (2, f"{far} {passage}"), (2, f"{far} {passage}"), (3, far[:90]), (None, passage), (4, None), (5, ""), (6, f"{passage} {passage}".replace("p7 ", "x "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["start_word"], r["n_words"], r["cluster"], r["removed"]) for r in paragraph_dedup.repeated_passages(docs).collect())
    assert (1, 1, 60, 1, False) in got and (2, 60, 60, 1, True) in got
    assert {r[0] for r in got} == {1, 2, 6}
    assert paragraph_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_kept_hash_of_empty_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_passages_of_documents_that_are_not_their_bands_first(spark):
    run = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    passage = run("p", 55).split()
    rows = [(100 + k, f"{run(f'c{k}x', 60)} {' '.join(passage[k : k + 30])} {run(f'd{k}x', 60)}") for k in range(0, 26)]
    rows += [(500, f"{run('e', 70)} {' '.join(passage)} {run('f', 70)}"), (501, f"{run('g', 90)} {' '.join(passage)} {run('h', 40)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["start_word"], r["n_words"], r["cluster"], r["removed"]) for r in paragraph_dedup.repeated_passages(docs).collect())
    assert got == [(500, 70, 55, 500, False), (501, 90, 55, 500, True)]


def test_passages_that_a_document_has_twice(spark):
    run = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    p, q, alone = run("p", 60), run("q", 60), run("r", 60)
    rows = [(1, f"{run('a', 30)} {p}"), (2, f"{p} {run('b', 40)} {p}"), (3, f"{q} {run('c', 70)} {q}"), (4, f"{run('d', 20)} {q}"), (5, f"{alone} {run('e', 30)} {alone}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["start_word"], r["n_words"], r["cluster"], r["removed"]) for r in paragraph_dedup.repeated_passages(docs).collect())
    assert got == [(1, 30, 60, 1, False), (2, 0, 60, 1, True), (2, 100, 60, 1, True), (3, 0, 60, 3, False), (3, 130, 60, 3, True), (4, 20, 60, 3, True)]
