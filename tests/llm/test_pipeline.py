"""The pipeline's stages against brute force on a small table."""

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from terrafold.llm import queries as q
from terrafold.llm.common import materialize


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """What each stage keeps, from the first on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in p.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir)))
    return out


def oracle(name, docs, sf_dir):
    con = duckdb.connect()
    con.register("docs", docs.toPandas())
    con.execute("create view documents as select * from docs")
    con.execute(f"create view benchmark as select * from '{sf_dir}/benchmark.parquet'")
    return con.execute(q.ORACLES[name]).df()


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_names_and_columns(kept):
    assert len(p.STAGES) == 5
    for df in kept[1:5]:
        assert df.columns == list(p.COLUMNS)


def test_quality_stage_drops_what_the_classifier_rejects(spark, kept, sf_dir):
    scored = q.op4_line_crf(spark, sf_dir).where("predicted = 1")
    assert ids(kept[1]) == ids(scored) and len(ids(kept[1])) < kept[0].count()


def test_line_stage(kept, sf_dir):
    import hashlib

    want = dict(oracle("op8_line_dedup", kept[1], sf_dir)[["doc_id", "kept_sha256"]].itertuples(index=False, name=None))
    rows = kept[2].collect()
    assert {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in rows} == want
    assert any(r["n_chars"] == len(r["text"]) for r in rows)


def test_near_copy_stage(kept, sf_dir):
    want = oracle("op7_jaccard_join", kept[2], sf_dir)
    assert ids(kept[3]) == sorted(want[want.doc_id == want.component_id].doc_id.tolist())


def test_benchmark_stage(kept, sf_dir):
    want = oracle("op5_decontamination", kept[3], sf_dir)
    assert ids(kept[4]) == sorted(want[~want.contaminated].doc_id.tolist())


def test_token_stage_and_run(spark, kept, sf_dir):
    library = Tokenizer.from_file(q.vocabulary_path())
    got = {r["doc_id"]: r["ids"] for r in p.run(spark, sf_dir).collect()}
    for r in kept[4].collect():
        assert got.pop(r["doc_id"]) == library.encode(r["text"] or "", add_special_tokens=False).ids
    assert not got


def test_stages_take_odd_rows(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", "s", 0), (2, "plain words are here.", None, "s", 3), (2, "plain words are here.", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES:
        assert stage(spark, docs, sf_dir).count() <= len(rows)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
