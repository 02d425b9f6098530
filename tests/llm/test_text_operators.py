"""Small tests of the row-wise operators: values by brute force, and odd input."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrafold.llm import divergence, hmm_lm, language_id, line_crf, spec_bpe, token_store
from terrafold.llm.common import pieces, words
from terrafold.llm.pretoken import Vocabulary
from terrafold.llm.queries import vocabulary_path

ODD = [(1, "The cat sat on the mat. " * 9, "en"), (1, "The cat sat on the mat. " * 9, "en"), (None, "x", None), (2, None, "en"), (3, "", "de"), (4, "\n\n \t\n", "de"), (5, "12345 !!! ###", None), (6, "der Hund und die Katze " * 400, "de"), (7, "a" * 5000, "en")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_match_the_pattern():
    texts = ["", " a\tb ", "x\x0by\x0cz\r\n", "É ü  end", "\x1fq\x00r"]
    offsets, flat = words(pa.array(texts, pa.large_string()), lower=False)
    for k, t in enumerate(texts):
        assert flat.slice(offsets[k], offsets[k + 1] - offsets[k]).to_pylist() == re.findall(r"[^\x20\x09-\x0D]+", t)


def test_pieces_keep_every_row():
    table = pa.table({"text": ["x" * n for n in (5, 0, 30_000_000, 7, 17_000_000)], "k": list(range(5))})
    assert [k for t in pieces(iter(table.to_batches())) for k in t.column("k").to_pylist()] == list(range(5))


def test_language_id(odd, empty):
    model = language_id.fit(odd, sample_docs=4)
    assert {lang for lang, _ in model.dictionaries} == {"en", "de"}
    rows = language_id.identify(odd.withColumnRenamed("lang", "score"), model).collect()
    assert len(rows) == len(ODD)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        assert 0 <= r["score"] <= 1
    assert [r["lang_pred"] for r in by[1]] == ["en", "en"] and by[6][0]["lang_pred"] == "de"
    assert {by[k][0]["lang_pred"] for k in (2, 3, 4, 5)} == {"und"}
    none = language_id.fit(empty)
    assert none.dictionaries == () and language_id.identify(empty, none).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}


def test_language_id_is_accurate_on_held_out_rows(spark, sf_dir):
    from terrafold.llm.queries import op1_language_id

    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in op1_language_id(spark, sf_dir).collect() if r["held_out"]]
    assert sum(docs[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.9 * len(held)


def rule_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    low = [x.translate({c: c + 32 for c in range(65, 91)}) for x in w]
    seen = collections.Counter(tuple(low[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if seen[tuple(low[i : i + 8])] > 1 for k in range(8)}
    lines, before, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        dup += x in before and bool(re.search(r"[^\x20\x09-\x0D]", x))
        before.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_divergence_counts_and_odd_input(spark, odd, empty, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    for df in (odd, docs):
        for r in divergence.judge(df.withColumnRenamed("lang", "kept"), divergence.learn(df)).collect():
            got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
            assert got == rule_counts(r["text"])
            assert r["base_failed"] == (got[0] < 20 or 100 * got[4] > 30 * got[0]) and not (r["base_failed"] and r["kept"])
    assert divergence.judge(empty, divergence.learn(empty)).count() == 0


def test_repeat_windows_fold_case():
    text = "One two three four five six seven eight nine. " + "one two three four five six seven eight."
    offsets, flat = words(pa.array([text], pa.large_string()))
    assert divergence.repeated_words(offsets, flat)[0] == rule_counts(text)[4]


def test_divergence_distance_by_hand():
    p, q = np.array([[0.5, 0.5]]), np.array([[1.0, 0.0]])
    m = [0.75, 0.25]
    want = math.sqrt((0.5 * math.log2(0.5 / m[0]) + 0.5 * math.log2(0.5 / m[1]) + math.log2(1 / m[0])) / 2)
    assert abs(divergence.distance(p, q)[0, 0] - want) < 1e-12


def test_crf_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    logit, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for code in range(32):
        y = [(code >> k) & 1 for k in range(5)]
        p = math.exp(sum(logit[k] * y[k] for k in range(5)) + sum(trans[y[k], y[k + 1]] for k in range(4)))
        total += p
        good += p * np.array(y)
    post, pairs, _ = line_crf.marginals(np.array([0, 5]), logit, trans)
    assert np.allclose(post, good / total) and np.isclose(pairs.sum(), 4)


def test_crf_learns_and_scores_odd_input(spark, odd, empty):
    good = [(k, "A plain sentence with words number %d.\nAnother calm line follows it." % k, 1) for k in range(40)]
    bad = [(100 + k, "BUY $$$ NOW %% %d\n### CLICK ### HERE ###" % k, 0) for k in range(40)]
    labelled = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = line_crf.fit(labelled, steps=80)
    scored = {r["doc_id"]: r["score"] for r in line_crf.score(labelled, model).collect()}
    assert min(scored[k] for k in range(40)) > max(scored[100 + k] for k in range(40))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in line_crf.score(odd.withColumnRenamed("lang", "score"), model).collect())
    assert line_crf.score(empty, model).count() == 0
    one = line_crf.fit(labelled.where("quality = 1"))
    assert one.prior == 1.0 and line_crf.fit(labelled.where("quality = 9")).prior == 1.0
    assert line_crf.label_lines(odd, model).where("doc_id = 4").count() == 4


def hmm_brute(model, obs):
    a = model.start * model.emit[obs[0]]
    for o in obs[1:]:
        a = (a @ model.trans) * model.emit[o]
    return math.log(a.sum())


def test_hmm_likelihood_and_counts(spark, odd, empty):
    counts = hmm_lm.word_counts(odd)
    lex = hmm_lm.lexicon(counts, odd.count(), head=6, own=3)
    model = hmm_lm.baum_welch(odd, lex, states=3, passes=2)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.trans.sum(axis=1), 1)
    offsets, obs, *_ = hmm_lm.observed(pa.array([r[1] or "" for r in ODD if len(r[1] or "") < 300], pa.large_string()), lex)
    want = [hmm_brute(model, obs[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    assert np.allclose(hmm_lm.likelihoods(model, offsets, obs), want)
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None]
    c = collections.Counter(x for r in ODD for x in lower(r[1]))
    n, v = sum(c.values()), len(c)
    got = hmm_lm.score(odd, counts, lex, model).collect()
    assert len(got) == len(ODD)
    base = sorted(round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in lower(r[1])), 6) for r in ODD)
    assert sorted(round(r["base_score"], 6) for r in got) == base
    assert all(r["n_known"] == r["n_tokens"] and r["train_tokens"] == n and r["score"] <= 0 for r in got)
    nothing = hmm_lm.word_counts(empty)
    bare = hmm_lm.lexicon(nothing, 0)
    rows = hmm_lm.score(odd, nothing, bare, hmm_lm.baum_welch(empty, bare, states=2, passes=1)).collect()
    assert all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in rows)


def test_hmm_reads_each_text_once(spark, odd):
    """One pass over the texts gives all that training and scoring need; other rows train nothing."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = odd.select("doc_id", "text").mapInArrow(counted, "doc_id long, text string")
    some = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    counts = hmm_lm.word_counts(odd.where(some))
    lex = hmm_lm.lexicon(counts, odd.where(some).count(), head=6, own=3)
    want = hmm_lm.baum_welch(odd.where(some), lex, states=3)
    scored = sorted(r["score"] for r in hmm_lm.score(docs, counts, lex, want).collect())
    assert len(scored) == len(ODD) == read.value
    encoded = hmm_lm.encode(docs, lex, train=some)
    model = hmm_lm.fit(encoded, lex, states=3)
    assert np.allclose(model.emit, want.emit, rtol=1e-4) and np.allclose(model.trans, want.trans, rtol=1e-4)
    assert np.allclose(scored, sorted(r["score"] for r in hmm_lm.score_encoded(encoded, counts, lex, model).collect()), rtol=1e-4)
    assert read.value == 2 * len(ODD)


def test_hmm_classes_of_endings():
    words = ["a", "", "é", "日本語", "ing", "😀😀", "xing", "ab" * 90]
    assert hmm_lm.ending_class(pa.array(words, pa.large_string())).tolist() == [zlib.crc32(w[-2:].encode()) % hmm_lm.ENDINGS for w in words]


HARD = ["", "  a   b\n\n\nc  ", "<|endoftext|>x <|endoftext|>", "a  b  c\x85 d\x1c \x1c z", "it's 'll  \t x\r\n y", "ab" * 700, "\x00 \x00added\x00<|endoftext|>", "日本語 テキスト 😀😀  é́", " ", "\n", "   ", "\n \n b", "    x", "Hello, World! 123"]


def test_bpe_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    texts = HARD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = spec_bpe.Encoder(Vocabulary.load(vocabulary_path()))
    offsets, ids = encoder.encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    assert encoder.decode(offsets, ids) == [library.decode(i, skip_special_tokens=False) for i in want]
    assert 0 < encoder.failed < encoder.proposed
    offsets, ids = token_store.LibraryEncoder(Vocabulary.load(vocabulary_path())).encode(pa.array(texts, pa.large_string()), 2)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [i + [2] for i in want]


def test_library_encoder_keeps_units(monkeypatch):
    """Units met before are neither cut nor encoded again, and full tables change no ids."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    texts = [*HARD, "x y\x7f z's abc' O'Neil don't a1b2 é, word. word", "\nab c\n", "word"]
    want = [[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(token_store.LibraryEncoder, "KEPT_UNITS", 9)
    small = token_store.LibraryEncoder(Vocabulary.load(vocabulary_path()))
    for _ in range(3):
        offsets, ids = small.encode(pa.array(texts, pa.large_string()), 2)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    assert len(small.units) == 9
    monkeypatch.undo()
    encoder = token_store.LibraryEncoder(Vocabulary.load(vocabulary_path()))
    plain = pa.array(["Hello, World! 123", "", "a word's word\nand a line"], pa.large_string())
    first = encoder.encode(plain, 2)
    monkeypatch.setattr("regex.compile", lambda pattern: 1 / 0)
    monkeypatch.setattr(encoder, "model", None)
    assert all((a == b).all() for a, b in zip(first, encoder.encode(plain, 2), strict=True))


def test_bpe_odd_input(odd, empty):
    rows = spec_bpe.encode(odd.withColumnRenamed("lang", "ids"), vocabulary_path(), decoded=True).collect()
    assert sorted(r["decoded"] for r in rows) == sorted(r[1] or "" for r in ODD)
    assert spec_bpe.digest(empty, vocabulary_path()).count() == 0


def test_bpe_works_on_small_pieces():
    text = ["many words of text " * 5000] * 100  # 9.5 MB in one batch
    batch = pa.RecordBatch.from_arrays([pa.array(text)], names=["text"])
    made = list(spec_bpe.encoded(iter([batch]), Vocabulary.load(vocabulary_path()), "text", [("ids", None), ("decoded", None)]))
    assert [x for b in made for x in b.column("decoded").to_pylist()] == text
    assert max(sum(map(len, b.column("text").to_pylist())) for b in made) <= 2 << 20


def test_elias_fano_round_trip():
    rng = np.random.default_rng(5)
    for n, top in ((0, 0), (1, 0), (1, 9), (300, 310), (999, 10**6), (4000, 4000)):
        values = np.sort(rng.integers(0, top + 1, n))
        packed = token_store.EliasFano.of(values)
        assert packed.all().tolist() == values.tolist() == [packed.select(k) for k in range(n)]
    assert packed.bytes_used() < 4000  # under a byte for a document, against eight


def test_token_store(spark, odd, empty, tmp_path):
    token_store.write(odd, f"{tmp_path}/store", vocabulary_path(), segment_ids=64)
    rows = token_store.read(spark, f"{tmp_path}/store", with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in ODD), key=lambda d: (d is not None, d))
    start = 0
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        start += r["n_tokens"]
    crc = {(r["doc_id"], r["ids_crc32"]) for r in token_store.read(spark, f"{tmp_path}/store").collect()}
    assert crc == {(r["doc_id"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in rows}
    token_store.write(empty, f"{tmp_path}/none", vocabulary_path())
    assert token_store.read(spark, f"{tmp_path}/none").count() == 0


def test_token_store_lookup(spark, tmp_path, monkeypatch):
    """Single documents by select: spread, equal, negative and very distant doc_ids, and none that isn't there."""
    ids = [None, -(2**63), -5, 3, 3, 3, *range(10, 400, 7), 2**62, 2**63 - 1]
    docs = spark.createDataFrame([(d, f"text {k} " * (k % 9), "x") for k, d in enumerate(ids)], SCHEMA)
    token_store.write(docs, f"{tmp_path}/s", vocabulary_path(), segment_ids=100)
    whole = [tuple(r) for r in token_store.read(spark, f"{tmp_path}/s", with_ids=True).select("doc_id", "start", "n_tokens", "ids").collect()]
    assert sorted((x[0] for x in whole), key=lambda d: (d is not None, d)) == sorted(ids, key=lambda d: (d is not None, d))
    monkeypatch.setattr(token_store.EliasFano, "all", lambda self: 1 / 0)
    wanted = [3, -(2**63), 2**62, 24, 25, 10**9, 2**63 - 1]
    got = sorted(map(tuple, token_store.find(spark, f"{tmp_path}/s", wanted).select("doc_id", "start", "n_tokens", "ids").collect()))
    assert got == sorted(x for x in whole if x[0] in wanted) and len(got) == 7
    assert token_store.find(spark, f"{tmp_path}/s", []).count() == 0
    assert max(len(r["doc_low"]) + len(r["doc_high"]) + len(r["doc_samples"]) for r in spark.read.parquet(f"{tmp_path}/s/segments").collect()) < 200
    with pytest.raises(TypeError):
        token_store.write(docs.withColumn("doc_id", F.col("doc_id").cast("string")), f"{tmp_path}/t", vocabulary_path())


def test_quality_scores_on_held_out_labels(spark):
    from terrafold.llm.queries import op4_line_crf

    sf = "/root/testdata/sf0.01"
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(quality[r["doc_id"]], r["score"], r["predicted"]) for r in op4_line_crf(spark, sf).collect() if r["held_out"] and r["doc_id"] in quality]
    good, bad = ([s for q, s, _ in held if q == k] for k in (1, 0))
    assert good and bad
    assert sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum(q == p for q, _, p in held) >= 0.9 * len(held)


def test_encoding_queries_equal_the_library_on_whole_tables(spark, sf_dir):
    import hashlib

    from tokenizers import Tokenizer

    from terrafold.llm.queries import op9_speculative_bpe, op10_elias_fano_store

    library = Tokenizer.from_file(vocabulary_path())
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in docs}
    packed = lambda x: np.array(x, "<u4").tobytes()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {d: (len(x), sha(packed(x)), sha(library.decode(x, skip_special_tokens=False).encode())) for d, x in ids.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op9_speculative_bpe(spark, sf_dir).collect()} == want
    start, stored = 0, {}
    for d, _ in docs:
        stored[d] = (start, len(ids[d]) + 1, zlib.crc32(packed([*ids[d], 2])))
        start += len(ids[d]) + 1
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op10_elias_fano_store(spark, sf_dir).collect()} == stored


def test_many_languages(spark):
    rows = [(k, f"word{k} of tongue{k} " * 30, f"l{k}") for k in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert len(language_id.fit(docs).dictionaries) == 80
    assert len(divergence.learn(docs).languages) == 80
    parts = "a b " * 200_000  # longer than the window of a dictionary
    assert 0 < language_id.judged(parts, language_id.fit(docs).compressors()[:2], 0.02)[1] <= 1


def test_dictionaries_learn_from_the_whole_text(spark):
    head = "kopfzeile vorspann hinweis " * 60
    rows = [(k, head + "the quick brown fox and the lazy dog were here " * 40, "en") for k in range(5)] + [(9, "der schnelle braune fuchs und der faule hund waren hier " * 40, "de")]
    model = language_id.fit(spark.createDataFrame(rows, SCHEMA))
    assert b"quick brown" in dict(model.dictionaries)["en"]
