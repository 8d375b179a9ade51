"""The queries of the operators here, each over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, conversation_trie, decontamination, language_id, licenses, line_dedup, mixing, nearest, ngram_jaccard, packing, phrases, suffix_dedup, toxicity
from ._store import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_part(k: int, of: int) -> Column:
    """Whether a row is in part k of the parts that crc32 makes; a null doc_id is in none."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) == k, F.lit(False))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link_components(_table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train_languages(docs.where(~_is_part(2, 4)))
    return language_id.predict_languages(docs, model).withColumn("held_out", _is_part(2, 4))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))[0]


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, _table(spark, sf_dir, "labels").where(~_is_part(1, 3)))
    return toxicity.score_toxicity(docs, model, least=0.7).withColumn("held_out", _is_part(1, 3))


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model, counts = brown_lm.train_classes(docs.where(~_is_part(0, 10)))
    return brown_lm.score_texts(docs, model, counts).withColumn("held_out", _is_part(0, 10))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer, window=4096, end_id=2)
    order = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "doc_row", "ids"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(7).values.to_numpy().astype("<u4"), batch.column(7).offsets.to_pylist()
            crc = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())
            yield pa.record_batch([*batch.columns[:7], crc], names=[*order[:7], "ids_crc32"])

    kinds = ", ".join(f"{c} long" for c in [*order[:7], "ids_crc32"])
    return packed.select(order).mapInArrow(digest, kinds)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(conversation_trie.digest_turns(_table(spark, sf_dir, "conversations")))
    convs = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")))
    c = F.col("conv_id")
    turns, convs = conversation_trie.graft(turns, convs, c - c % 5, F.crc32(c.cast("string")) % 9, 8)
    return conversation_trie.prefix_trie(turns, stored(convs))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_table(spark, sf_dir, "documents"), least=10, absorb=50, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_ngram_jaccard_join, op2_benchmark_decontamination, op3_suffix_array_dedup, op4_language_id, op5_line_dedup,
        op6_nearest_neighbours, op7_license_scan, op8_source_mixing, op9_toxicity, op10_brown_lm,
        op11_packing, op12_conversation_trie, op13_phrases,
    )
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SQL = {
    "op1_ngram_jaccard_join": f"""with recursive w as (select doc_id, coalesce({_WORDS}, []) w from documents),
s as (select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i:i + 3], ' ') end x
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
c as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n p on a = p.doc_id join n q on b = q.doc_id where 100 * c >= 85 * (p.n + q.n - c)),
sym as (select a, b from l union all select b, a from l),
r as (select doc_id d, doc_id m from w union select sym.b, r.m from r join sym on r.d = sym.a)
select w.doc_id, coalesce(n.n, 0) n_shingles, (select min(m) from r where d = w.doc_id) component_id from w left join n using (doc_id)""",
    "op3_suffix_array_dedup": """with t as (select doc_id, coalesce(hex(encode(text)), '') h, coalesce(octet_length(encode(text)), 0) n from documents),
blocks as (select doc_id, n, k * 512 beg, substr(h, k * 1024 + 1, 1222) p from (select *, unnest(range(0, n // 512 + 1)) k from t)),
win as (select doc_id, beg + i i, substr(p, 2 * i + 1, 200) x from (select *, unnest(range(0, least(512, n - 99 - beg))) i from blocks where n - 99 > beg)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by x order by doc_id, i) k from win) where k > 1),
isle as (select *, sum(case when was is null or i > was + 100 then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) g
  from (select *, lag(i) over (partition by doc_id order by i) was from late)),
span as (select doc_id, min(i) b, max(i) + 100 e from isle group by doc_id, g),
cut as (select doc_id, b, e from span union all select doc_id, n, n from t),
kept as (select doc_id, coalesce(lag(e) over (partition by doc_id order by b, e), 0) f, b from cut),
part as (select doc_id, string_agg(substr(h, 2 * f + 1, 2 * (b - f)), '' order by f) k from kept join t using (doc_id) group by 1),
gone as (select doc_id, sum(e - b) r, count(*) c from span group by 1)
select doc_id, cast(n as bigint) n_bytes, cast(coalesce(r, 0) as bigint) n_removed, coalesce(c, 0) n_spans, sha256(unhex(k)) kept_sha256 from t join part using (doc_id) left join gone using (doc_id)""",
    "op12_conversation_trie": """with recursive t as (select i, 0 k, i v from range(256) r(i)
  union all select i, k + 1, case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from t where k < 8),
tab as (select list(v order by i) tab from t where k = 8),
own as (select conv_id, cast(conv_id as varchar) s, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) w
  from conversations where conv_id is not null group by 1),
h as (select conv_id, w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: cast(ascii(s[i]) as bigint))),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 9 h from own, tab),
reb as (select o.conv_id c, list_concat(coalesce(b.w[1:h], []), o.w[h + 1:]) w from h o left join own b on b.conv_id = o.conv_id - o.conv_id % 5),
pre as (select c, d, w[1:d] p, len(w) n from (select *, unnest(range(0, len(w) + 1)) d from reb)),
node as (select d, p, min(c) conv_id, count(*) n_convs, sha256(coalesce(array_to_string(list(c order by c) filter (n = d), ','), '')) ends_sha256 from pre group by d, p),
kids as (select d - 1 d, p[1:d - 1] p, count(*) n_children from node where d > 0 group by all),
whole as (select node.*, coalesce(n_children, 0) n_children, m.conv_id parent_conv_id, case when n_children is null then 1 else 0 end leaf,
  case when node.d = 0 then 0 else (node.n_convs - 1) * strlen(node.p[node.d].t) end saved
  from node left join kids using (d, p) left join node m on m.d = node.d - 1 and m.p = node.p[1:node.d - 1]),
up as (select e d, p[1:e] p, cast(sum(leaf) as bigint) n_leaves, cast(sum(saved) as bigint) saved_tokens from (select *, unnest(range(0, d + 1)) e from whole) group by all)
select conv_id, cast(d as bigint) depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from whole join up using (d, p)""",
    "op13_phrases": r"""with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) x from documents),
w as (select lang, regexp_extract_all(x, '[^\x20\x09]+') w from p),
g as (select lang, w[i:i + k - 1] ph from (select *, unnest(range(1, len(w) - k + 2)) i from (select *, unnest([1, 2, 3]) k from w) where len(w) >= k)),
f as (select lang, ph, count(*) a from g group by all),
n as (select lang, cast(sum(len(w)) as bigint) n from w group by 1),
c as (select * from f where len(ph) > 1 and a >= 10),
longer as (select lang, ph, max(b) b from (select lang, a b, unnest([ph[1:2], ph[2:3]]) ph from c where len(ph) = 3) group by all),
cut as (select c.lang, c.ph, c.a, k, l.a l, r.a r, cast(cast(1000000 as hugeint) * c.a * c.a // (cast(l.a as hugeint) * r.a) as bigint) score
  from (select *, unnest(range(1, len(ph))) k from c) c join f l on l.lang = c.lang and l.ph = c.ph[1:k] join f r on r.lang = c.lang and r.ph = c.ph[k + 1:len(c.ph)]),
best as (select cut.*, row_number() over (partition by cut.lang, cut.ph order by score, k) o from cut left join longer using (lang, ph) where b is null or 100 * b < 50 * a),
ranked as (select *, array_to_string(ph, ' ') phrase, row_number() over (partition by lang order by score desc, a desc, array_to_string(ph, ' ')) rank from best where o = 1)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000""",
}


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express; the others learn models, draw at random or align: tests/llm holds them to brute force."""
    return dict(_SQL)
