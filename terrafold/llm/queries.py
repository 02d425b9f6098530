"""The queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import decontam, divergence, hash_tree, hmm_lm, jaccard_join, language_id, line_crf, line_dedup, paragraph_dedup, source_audit, spec_bpe, token_store, whitening
from terrafold.llm.common import configure, documents, fold_crc, shared_dir


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    fold = fold_crc(F.col("doc_id"), 3)
    model = language_id.fit(docs.where(fold != 1))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    judged = divergence.judge(docs.select("doc_id", "text"), divergence.learn(docs))
    return judged.drop("text")


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = documents(spark, sf_dir, "doc_id", "text")
    fold = fold_crc(F.col("doc_id"), 5)
    scored = line_crf.score(docs, quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> line_crf.LineModel:
    """The line model that op4 and the pipeline use, learned from labels of the rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(fold_crc(F.col("doc_id"), 5) != 0)
    some = line_crf.sample_labels(labels)  # so few rows can be broadcast
    return line_crf.fit(docs.join(F.broadcast(some), "doc_id"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return spec_bpe.digest(documents(spark, sf_dir, "doc_id", "text"), vocabulary_path()).drop("text")


def op10_elias_fano_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    path = shared_dir(spark)
    token_store.write(documents(spark, sf_dir, "doc_id", "text"), path, vocabulary_path())
    return token_store.read(spark, path)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = documents(spark, sf_dir, "doc_id", "text")
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from cut),
common as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (
  select k.*, c.key is not null and k.doc_id <> c.keeper as gone from keyed k left join common c on k.key = c.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    items = F.array_join("items", ",")
    return decontam.report(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated")


def words_sql(column: str) -> str:
    """DuckDB: the words of op5."""
    lower = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP5_SQL = f"""
with d as (select doc_id, {words_sql("text")} as w from documents),
b as (select item_id, {words_sql("text")} as w from benchmark where item_id is not null),
win as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as t
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct n from win),
places as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as t
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
hit as (select x.doc_id, x.i, x.n, win.item_id from places x join win on x.n = win.n and x.t = win.t),
hits as (select doc_id, count(distinct p)::bigint as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
its as (select doc_id, count(*)::bigint as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, item_id::varchar as s from hit) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits on d.doc_id = hits.doc_id left join its on d.doc_id = its.doc_id
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return jaccard_join.linked(documents(spark, sf_dir, "doc_id", "text")).drop("text_hash")


OP7_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, sh from (
    select doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as sh
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0))),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
e as (select a, b from l union select b, a from l),
r as (
  with recursive r(doc_id, root) as (select doc_id, doc_id from w union select e.b, r.root from r join e on e.a = r.doc_id)
  select doc_id, min(root) as component_id from r group by doc_id)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, r.component_id from w left join n on n.doc_id = w.doc_id join r on r.doc_id = w.doc_id
"""


def op2_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = documents(spark, sf_dir, "doc_id", "text")
    fold = fold_crc(F.col("doc_id"), 7)
    train = docs.where(fold != 2).select("text")
    counts = hmm_lm.word_counts(train)
    lex = hmm_lm.lexicon(counts, train.count())
    encoded = hmm_lm.encode(docs, lex, train=fold != 2)
    scored = hmm_lm.score_encoded(encoded, counts, lex, hmm_lm.fit(encoded, lex))
    return scored.select("doc_id", (fold == 2).alias("held_out"), *(c for c in scored.columns if c != "doc_id"))


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return paragraph_dedup.repeated_passages(documents(spark, sf_dir, "doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whitening.whiten(vectors).withColumn("deviation", F.col("deviation").cast("long"))


#: Two regions of two racks of two shards; the ninth shard opens a region of its own.
TREE = hash_tree.by_capacity([(k // 4, k // 2 % 2, k, 1.0) for k in range(8)])
GROWN_TREE = hash_tree.by_capacity([(k // 4, k // 2 % 2, k, 1.0) for k in range(9)])


def op12_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hash_tree.shards(documents(spark, sf_dir, "doc_id", "text"), TREE, GROWN_TREE)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def tree_sql(name: str, tree: list[hash_tree.Leaf]) -> str:
    """DuckDB: tables of a tree's levels, and ``name`` (doc_id, shard) of the keys in ``ids``."""
    draw = lambda path, weight: f"-ln((('0x' || substr(md5(key || '/' || {path}), 1, {hash_tree.DIGITS}))::bigint::double + 0.5) / {1 << 4 * hash_tree.DIGITS}::double) / {weight}"
    rows = ", ".join(f"({x.region}, {x.rack}, {x.shard}, {x.region_weight}::double, {x.rack_weight}::double, {x.shard_weight}::double)" for x in tree)
    return f"""
{name}_tree as (select * from (values {rows}) t(region, rack, shard, rw, kw, sw)),
{name}_1 as (
  select doc_id, key, arg_min(region, (d, region)) as region
  from (select doc_id, key, region, {draw("region", "rw")} as d from ids, (select distinct region, rw from {name}_tree)) group by 1, 2),
{name}_2 as (
  select doc_id, key, region, arg_min(rack, (d, rack)) as rack
  from (select doc_id, key, region, rack, {draw("region || '.' || rack", "kw")} as d from {name}_1 join (select distinct region, rack, kw from {name}_tree) using (region)) group by 1, 2, 3),
{name} as (
  select doc_id, arg_min(shard, (d, shard))::int as shard
  from (select doc_id, shard, {draw("region || '.' || rack || '.' || shard", "sw")} as d from {name}_2 join {name}_tree using (region, rack)) group by 1)"""


#: CRC-32 has no function in DuckDB: a table made from the polynomial, folded over the bytes of the text.
OP12_SQL = f"""
with recursive crc_bits(i, c, k) as (
  select i::bigint, i::bigint, 0 from range(256) t(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, k + 1 from crc_bits where k < 8),
crc_table as (select list(c order by i) as crc from crc_bits where k = 8),
d as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
sums as (
  select doc_id, strlen(text)::bigint + 1 as size,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
                         lambda x, y: xor(x >> 8, crc[xor(x & 255, y) + 1])), 4294967295::bigint) as text_crc32
  from d, crc_table),
ids as (select distinct doc_id, coalesce(doc_id::varchar, 'null') as key from d),{tree_sql("now", TREE)},{tree_sql("later", GROWN_TREE)}
select s.doc_id, s.size, s.text_crc32, 'key' as law, now.shard,
       row_number() over (partition by now.shard order by md5(s.doc_id::varchar || ':' || s.size || ':' || s.text_crc32), s.doc_id, s.size, s.text_crc32) - 1 as slot, later.shard as grown_shard
from sums s join now on now.doc_id = s.doc_id join later on later.doc_id = s.doc_id
"""


OP13_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return source_audit.audit(documents(spark, sf_dir, "text", "lang", "source"))


OP13_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
t as (select doc_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{OP13_LETTERS}')) as term from d),
kept as (select lang, term, count(*) as in_lang from t group by 1, 2 having count(distinct doc_id) >= 3),
whole as (select lang, count(*)::hugeint as v, sum(in_lang)::hugeint as n_lang from kept group by 1),
here as (select t.lang, t.source, t.term, count(*)::hugeint as c from t join kept using (lang, term) group by 1, 2, 3),
groups as (select distinct lang, source from d),
sized as (select g.lang, g.source, coalesce(sum(c), 0)::hugeint as n from groups g left join here h on g.lang = h.lang and g.source = h.source group by 1, 2),
p as (
  select s.lang, s.source, k.term, coalesce(h.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(h.c, 0) + 1)) // (s.n + w.v) as p, 1 + (1000000000::hugeint * (k.in_lang + 1)) // (w.n_lang + w.v) as q
  from sized s join kept k on s.lang = k.lang join whole w on w.lang = s.lang left join here h on h.lang = s.lang and h.source = s.source and h.term = k.term),
sums as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value from p where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item))::int as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 200
"""


QUERIES = {"op6_paragraph_dedup": op6_paragraph_dedup, "op2_hmm_lm": op2_hmm_lm, "op7_jaccard_join": op7_jaccard_join, "op5_decontamination": op5_decontamination, "op8_line_dedup": op8_line_dedup, "op10_elias_fano_store": op10_elias_fano_store, "op9_speculative_bpe": op9_speculative_bpe, "op4_line_crf": op4_line_crf, "op3_divergence_rules": op3_divergence_rules, "op1_language_id": op1_language_id, "op11_whitening": op11_whitening, "op12_hash_tree": op12_hash_tree, "op13_source_audit": op13_source_audit}
ORACLES: dict[str, str] = {"op5_decontamination": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op8_line_dedup": OP8_SQL, "op12_hash_tree": OP12_SQL, "op13_source_audit": OP13_SQL}
