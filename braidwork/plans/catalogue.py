"""The registered queries over the sequence and statistics operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bases import LETTERS, digits_of
from ..operators import kmers as K
from ..operators import relational as R
from ..operators import seeding as S
from ..operators.dealing import Made
from ..operators.order import average_ranks
from ..sources.sequences import sequences_from_documents, table

_DIGITS = ("0123" * 7)[:26]
_ENC = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{_DIGITS}')"
_SEQ = f"seqs as (select doc_id ctg, source scaf, {_ENC} seq from documents where length({_ENC}) >= 40)"


def _rank(x: str) -> str:
    code = " + ".join(f"(ascii(substr({x}, {k + 1}, 1)) - 48) * {4 ** (3 - k)}" for k in range(4))
    return f"((({code}) * 167 + 13) % 256)"


_POS = f"""wide as (select *, translate(reverse(seq), '0123', '3210') rc, length(seq) len from seqs),
p as (select ctg, seq, rc, len, unnest(range(0, len - 7)) i from wide),
q as (select *, substr(seq, i + 1, 8) f, substr(rc, len - 8 - i + 1, 8) b from p),
z as (select *, least({_rank('f')} * 256 + {_rank('substr(f, 5, 4)')}, {_rank('b')} * 256 + {_rank('substr(b, 5, 4)')}) mz from q),
w as (select *, min(mz) over (partition by ctg order by i rows between current row and 4 following) m,
  lead(mz, 4) over (partition by ctg order by i) mz4 from z),
sel as (select ctg, seq, rc, len, i j from w where mz4 is not null and (mz = m or mz4 = m))"""
_REC = """rec as (select ctg, j pos, 0 strand, substr(seq, j + 1, 40) kmer from sel where j <= len - 40
  union all select ctg, j + 12, 1, substr(rc, len - j - 12 + 1, 40) from sel where j >= 28 and j + 12 <= len)"""
_LCP = """g as (select *, substr(kmer, 1, 12) pre, row_number() over (partition by substr(kmer, 1, 12) order by kmer, ctg, pos, strand) rn from rec),
l as (select *, lag(kmer) over (partition by pre order by rn) k0 from g),
c as (select *, case when k0 is null then 0 else len(list_filter(range(1, 41), lambda k: kmer[1:k] = k0[1:k])) end lcp from l),
e as (select *, greatest(lcp, coalesce(lead(lcp) over (partition by pre order by rn), 0)) plen from c)"""
_SEED = """t as (select a.ctg ctg_a, a.pos pos_a, a.strand sa, a.plen, a.pre, a.rn, b.ctg ctg_b, b.pos pos_b, b.strand sb,
  count(*) over (partition by a.pre, a.rn) n from e a join e b on a.pre = b.pre and b.rn between a.rn - 9 and a.rn + 9 and a.rn <> b.rn
  and substr(a.kmer, 1, a.plen) = substr(b.kmer, 1, a.plen) where a.plen >= 12),
s as (select ctg_a, pos_a, ctg_b, pos_b, sa <> sb comp, plen from t where n + 1 < 10)"""
_TO = {"seq": f"with {_SEQ} ", "sel": f"with {_SEQ}, {_POS} ", "rec": f"with {_SEQ}, {_POS}, {_REC} ", "lcp": f"with {_SEQ}, {_POS}, {_REC}, {_LCP} ", "seed": f"with {_SEQ}, {_POS}, {_REC}, {_LCP}, {_SEED} "}
_BAND = """mx as (select max(length(seq)) x from seqs),
bd as (select *, case when comp then x - (pos_a - pos_b) else pos_a + pos_b end ad,
  case when comp then 2 * x - (pos_a + pos_b) else x + pos_a - pos_b end diag from s, mx),
sb as materialized (select ctg_a, ctg_b, comp, diag >> 6 band, ad, diag & 63 dg, plen from bd)"""
_CHAIN = """big as materialized (select ctg_a, ctg_b, comp from sb group by all having sum(2 * plen) >= 170),
sc as materialized (select sb.* from sb semi join big on sb.ctg_a = big.ctg_a and sb.ctg_b = big.ctg_b and sb.comp = big.comp),
bands as materialized (select distinct ctg_a, ctg_b, comp, band from sc),
x2 as (select ctg_a, ctg_b, comp, band base, ad, dg, 2 * plen w, 1 role from sc
  union all select s1.ctg_a, s1.ctg_b, s1.comp, s1.band - 1, ad, dg + 64, 2 * plen, 2 from sc s1 semi join bands b
  on s1.ctg_a = b.ctg_a and s1.ctg_b = b.ctg_b and s1.comp = b.comp and b.band = s1.band - 1),
r as (select *, max(ad + w) over (partition by ctg_a, ctg_b, comp, base order by ad, role, dg, w rows between unbounded preceding and 1 preceding) pe from x2),
f as (select *, case when pe is null or ad >= pe + 2000 then 1 else 0 end new from r),
ch as (select *, sum(new) over (partition by ctg_a, ctg_b, comp, base order by ad, role, dg, w rows unbounded preceding) cid from f),
gr as (select ctg_a, ctg_b, comp, base, cid, min(ad) alow, max(ad + w) ahgh, min(dg) dlow, max(dg) dhgh, bit_or(role) mix,
  sum(case when new = 1 then w else greatest(0, ad + w - greatest(ad, pe)) end) cov from ch group by all)"""


def _micros():
    """Microseconds of events.ts since 1970, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def _recs(spark: SparkSession, d: str) -> DataFrame:
    return S.packed_records(sequences_from_documents(spark, d))


def _made(spark: SparkSession, d: str) -> Made:
    """The records, made where they are dealt out."""
    return S.packed(sequences_from_documents(spark, d))


def _longest(spark: SparkSession, d: str) -> int:
    return sequences_from_documents(spark, d).agg(F.max(F.length("seq"))).first()[0] or 0


def _chains(spark: SparkSession, d: str) -> DataFrame:
    longest, recs = _longest(spark, d), _made(spark, d)
    block = S.block_for(longest)
    return S.chains(S.banded(S.seeds(recs), longest), block=block) if block else S.short_chains(recs, longest)


def seq_encode_stats(spark: SparkSession, d: str) -> DataFrame:
    count = lambda x: F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(x), F.lit("")))).alias(f"n{x}")
    return sequences_from_documents(spark, d).groupBy("scaf").agg(F.count("*").alias("n_ctg"), F.sum(F.length("seq")).alias("bases"), F.max(F.length("seq")).alias("longest"), *map(count, "0123"))


def syncmer_select(spark: SparkSession, d: str) -> DataFrame:
    return S.syncmers(sequences_from_documents(spark, d)).groupBy("ctg").agg(F.count("*").alias("n"), F.sum(F.col("j").cast("long")).alias("sum_j"))


def syncmer_records(spark: SparkSession, d: str) -> DataFrame:
    return _recs(spark, d).groupBy("ctg").agg(F.sum((F.col("place") + 1) % 2).alias("n_forward"), F.sum(F.col("place") % 2).alias("n_reverse"))


def kmer_bucket_histogram(spark: SparkSession, d: str) -> DataFrame:
    counts = _recs(spark, d).groupBy(F.shiftright("hi", 30).alias("b")).agg(F.count("*").alias("n")).select(digits_of(F.col("b"), 5).alias("bucket"), "n")
    return counts.withColumn("up_to", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))


def prefix_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = _recs(spark, d).groupBy(F.shiftright("hi", 16).alias("pre")).agg(F.count("*").alias("n"))
    return runs.groupBy("n").agg(F.count("*").alias("groups"))


def kmer_count_histogram(spark: SparkSession, d: str) -> DataFrame:
    one = K.kmer_counts(K.canonical(_recs(spark, d)))
    return one.groupBy(F.least("n", F.lit(100)).alias("freq")).agg(F.count("*").alias("kmers"))


def plen_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.plen_counts(_made(spark, d))


def seed_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.pair_counts(_made(spark, d)).drop("first")


def pair_task_features(spark: SparkSession, d: str) -> DataFrame:
    longest, recs = _longest(spark, d), _made(spark, d)
    if not S.block_for(longest):
        return S.band_counts(recs, longest)
    by_band = S.banded(S.seeds(recs), longest).groupBy("ctg_a", "ctg_b", "comp", "band").agg(F.count("*").alias("n"))
    return by_band.groupBy("ctg_a", "ctg_b", "comp").agg(F.sum("n").alias("n_seeds"), F.count("*").alias("n_bands"), F.max("n").alias("max_band"))


def seed_chains(spark: SparkSession, d: str) -> DataFrame:
    return _chains(spark, d)


def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = _chains(spark, d).where("not comp and ctg_a <> ctg_b")
    return found.groupBy(F.least("ctg_a", "ctg_b").alias("x"), F.greatest("ctg_a", "ctg_b").alias("y")).agg(F.max("cov").alias("best"), F.count("*").alias("n_chains"))


def interval_union(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", _micros().alias("b"), (_micros() + F.floor(F.coalesce("value", F.lit(0.0)) * 60_000_000).cast("long")).alias("e"))
    return R.interval_union(e, "user_id", "b", "e")


def carry_last_call(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", _micros().alias("t"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("call"))
    return R.carried(e, "user_id", ["t", "event_id"], F.col("call"), "last_call").select("event_id", "user_id", "last_call")


def bag_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "source")
    return R.bag_difference(docs.where("lang = 'en'").select("source"), docs.where("lang <> 'en'").select("source"))


def imbalance(spark: SparkSession, d: str) -> DataFrame:
    load = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"), F.count("*").alias("n"))
    return load.agg(F.count("*").alias("workers"), F.max("n").alias("most"), F.min("n").alias("least"), F.round(F.max("n") / F.avg("n"), 6).alias("max_over_mean"), F.sum("q").cast("double").alias("total"))


def cost_regression(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.round(F.corr(y, x), 6).alias("r"), F.count("*").alias("n"))


def spearman_cost(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderpriority", "o_custkey", "o_totalprice")
    r = average_ranks(average_ranks(o, "o_orderpriority", "o_custkey", "rx"), "o_orderpriority", "o_totalprice", "ry")
    return r.groupBy("o_orderpriority").agg(F.round(F.corr("rx", "ry"), 6).alias("rho"), F.count("*").alias("n"))


def topk_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The twelve dearest lines and the share of all cost that each has."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    top = lines.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(12)
    whole = lines.agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).first()[0]
    return top.withColumn("share", F.round(F.col("l_extendedprice") / F.lit(float(whole or 1)), 9))


_SQL = {
    "seq_encode_stats": _TO["seq"] + "select scaf, count(*) n_ctg, sum(length(seq)) bases, max(length(seq)) longest, " + ", ".join(f"sum(length(seq) - length(replace(seq, '{x}', ''))) n{x}" for x in "0123") + " from seqs group by scaf",
    "syncmer_select": _TO["sel"] + "select ctg, count(*) n, sum(j) sum_j from sel group by ctg",
    "syncmer_records": _TO["rec"] + "select ctg, sum(1 - strand) n_forward, sum(strand) n_reverse from rec group by ctg",
    "kmer_bucket_histogram": _TO["rec"] + "select bucket, n, sum(n) over (order by bucket rows unbounded preceding) up_to from (select substr(kmer, 1, 5) bucket, count(*) n from rec group by 1)",
    "prefix_runs": _TO["rec"] + "select n, count(*) as groups from (select count(*) n from rec group by substr(kmer, 1, 12)) group by n",
    "kmer_count_histogram": _TO["rec"] + "select least(n, 100) freq, count(*) kmers from (select count(*) n from rec group by least(kmer, translate(reverse(kmer), '0123', '3210'))) group by 1",
    "plen_histogram": _TO["lcp"] + "select plen, count(*) n, sum(lcp) sum_lcp from e group by plen",
    "seed_pair_counts": _TO["seed"] + "select ctg_a, ctg_b, comp, count(*) n_seeds, sum(plen) sum_plen from s group by all",
    "pair_task_features": _TO["seed"] + f", {_BAND} select ctg_a, ctg_b, comp, sum(n) n_seeds, count(*) n_bands, max(n) max_band from (select ctg_a, ctg_b, comp, band, count(*) n from sb group by all) group by all",
    "seed_chains": _TO["seed"] + f", {_BAND}, {_CHAIN} select gr.* from gr left join bands b on gr.ctg_a = b.ctg_a and gr.ctg_b = b.ctg_b and gr.comp = b.comp and b.band = gr.base - 1 where cov >= 170 and (mix <> 1 or b.band is null)",
    "near_duplicate_pairs": _TO["seed"] + f", {_BAND}, {_CHAIN} select least(gr.ctg_a, gr.ctg_b) x, greatest(gr.ctg_a, gr.ctg_b) y, max(cov) best, count(*) n_chains from gr left join bands b on gr.ctg_a = b.ctg_a and gr.ctg_b = b.ctg_b and gr.comp = b.comp and b.band = gr.base - 1 where cov >= 170 and (mix <> 1 or b.band is null) and not gr.comp and gr.ctg_a <> gr.ctg_b group by 1, 2",
    "interval_union": "with e as (select user_id, epoch_us(ts) b, epoch_us(ts) + cast(floor(coalesce(value, 0) * 60000000) as bigint) e from events), r as (select *, max(e) over (partition by user_id order by b, e rows between unbounded preceding and 1 preceding) m from e), g as (select *, sum(case when m is null or b > m then 1 else 0 end) over (partition by user_id order by b, e rows unbounded preceding) k from r) select user_id, min(b) beg, max(e) \"end\", count(*) n from g group by user_id, k",
    "carry_last_call": "select event_id, user_id, last_value(case when event_type = 'click' then event_id end ignore nulls) over (partition by user_id order by epoch_us(ts), event_id rows between unbounded preceding and 1 preceding) last_call from events",
    "bag_diff": "select source, n_left, n_right from (select source, sum(case when lang = 'en' then 1 else 0 end) n_left, sum(case when lang <> 'en' then 1 else 0 end) n_right from documents where lang is not null group by source) where n_left <> n_right",
    "imbalance": "select count(*) workers, max(n) most, min(n) least, round(max(n) / avg(n), 6) max_over_mean, cast(sum(q) as double) total from (select l_suppkey, sum(cast(l_quantity as decimal(18,2))) q, count(*) n from lineitem group by 1)",
    "cost_regression": "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 3) intercept, round(regr_r2(l_extendedprice, l_quantity), 6) r2, round(corr(l_extendedprice, l_quantity), 6) r, count(*) n from lineitem group by 1",
    "spearman_cost": "with r as (select o_orderpriority, rank() over (partition by o_orderpriority order by o_custkey) + (count(*) over (partition by o_orderpriority, o_custkey) - 1) / 2.0 rx, rank() over (partition by o_orderpriority order by o_totalprice) + (count(*) over (partition by o_orderpriority, o_totalprice) - 1) / 2.0 ry from orders) select o_orderpriority, round(corr(rx, ry), 6) rho, count(*) n from r group by 1",
    "topk_tasks": "select l_orderkey, l_linenumber, l_extendedprice, round(l_extendedprice / (select cast(sum(cast(l_extendedprice as decimal(18,2))) as double) from lineitem), 9) share from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 12",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _SQL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
