"""Registered queries over intervals, runs, layouts and alignments, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import ranges as G
from ..operators import relational as R
from ..operators import kmers as K
from ..operators import seeding as S
from ..operators.order import lower_medians
from ..operators.scripts import scripts_of
from ..sources.sequences import encoded, sequences_from_documents, sizes_from_documents, table
from .catalogue import _BAND, _CHAIN, _ENC, _POS, _REC, _SEQ, _TO, _chains, _made, _micros, _recs

HOUR = 3_600_000_000


def _spans(spark: SparkSession, d: str, which: str = "true") -> DataFrame:
    length = F.floor(F.coalesce("value", F.lit(0.0)) * 60_000_000).cast("long")
    return table(spark, d, "events").where(which).select("user_id", "event_id", _micros().alias("b"), (_micros() + length).alias("e"))


def contig_gap_split(spark: SparkSession, d: str) -> DataFrame:
    return G.split_at_gaps(table(spark, d, "documents").withColumnRenamed("doc_id", "ctg"), "ctg", "text", gap="[^A-Za-z]", least=2)


def lcp_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.lcp_histogram(_made(spark, d))


def interval_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.overlapping_pairs(_spans(spark, d), "user_id", "event_id", "b", "e", width=HOUR)


def mask_values(spark: SparkSession, d: str) -> DataFrame:
    masks = R.interval_union(_spans(spark, d, "event_type = 'click'"), "user_id", "b", "e")
    points = _spans(spark, d).select("user_id", "event_id", F.col("b").alias("at"))
    return G.mask_ahead(points, masks, "user_id", "at", most=HOUR).select("event_id", "mask")


def order_violations(spark: SparkSession, d: str) -> DataFrame:
    return G.order_violations(_spans(spark, d), "user_id", "event_id", "b")


def value_runs(spark: SparkSession, d: str) -> DataFrame:
    return G.value_runs(table(spark, d, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_returnflag"], "l_returnflag")


def nearest_earlier_partner(spark: SparkSession, d: str) -> DataFrame:
    return G.nearness(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


def skeleton_match(spark: SparkSession, d: str) -> DataFrame:
    described = F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.coalesce("role", F.lit("")), F.coalesce(F.length("text"), F.lit(0)))
    return G.same_layout(table(spark, d, "conversations"), "conv_id", described)


def kmer_lookup(spark: SparkSession, d: str) -> DataFrame:
    items = encoded(table(spark, d, "benchmark").select(F.col("item_id").alias("ctg"), F.lit(None).alias("scaf"), "text"))
    asked = S.packed_records(items)
    known = K.asked_for(_recs(spark, d), asked, {"hi": F.col("hi"), "lo": F.col("lo")}).groupBy("hi", "lo").agg(F.count("*").alias("n"))
    looked = asked.join(known, ["hi", "lo"], "left").groupBy(F.col("ctg").alias("item_id"))
    return looked.agg(F.count("*").alias("n_kmers"), F.count("n").alias("n_found"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_places"))


def median_cost(spark: SparkSession, d: str) -> DataFrame:
    price, orders = F.col("o_totalprice"), table(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    ends = orders.groupBy("o_orderpriority").agg(F.min(price).alias("least"), F.max(price).alias("most"), F.count("*").alias("n"))
    return lower_medians(orders, "o_orderpriority", "o_totalprice").join(ends, "o_orderpriority")


def log_cost_model(spark: SparkSession, d: str) -> DataFrame:
    """Least squares with two features, from sums alone: one partial aggregate, nothing collected."""
    logs = table(spark, d, "lineitem").where("l_quantity > 0 and l_extendedprice > 0").select("l_returnflag", F.ln("l_extendedprice").alias("y"), F.ln("l_quantity").alias("u"), F.ln(F.col("l_discount") + 1).alias("v"))
    pop = F.covar_pop
    sums = logs.groupBy("l_returnflag").agg(pop("u", "u").alias("uu"), pop("v", "v").alias("vv"), pop("u", "v").alias("uv"), pop("u", "y").alias("uy"), pop("v", "y").alias("vy"), F.count("*").alias("n"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    by_u, by_v = (F.col("uy") * F.col("vv") - F.col("vy") * F.col("uv")) / det, (F.col("vy") * F.col("uu") - F.col("uy") * F.col("uv")) / det
    return sums.select("l_returnflag", F.round(by_u, 4).alias("by_quantity"), F.round(by_v, 4).alias("by_discount"), "n")


def pair_weights(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of scaffolds by the product of their bases, the largest first: few scaffolds, whatever the rows."""
    size = sizes_from_documents(spark, d).where("scaf is not null").groupBy("scaf").agg(F.sum("n").alias("n"))
    i, j = size.select(F.col("scaf").alias("i"), F.col("n").alias("ni")), size.select(F.col("scaf").alias("j"), F.col("n").alias("nj"))
    pairs = i.join(j, F.col("i") <= F.col("j")).select("i", "j", (F.col("ni") * F.col("nj")).alias("weight"))
    return pairs.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("weight"), "i", "j")))


def align_overlaps(spark: SparkSession, d: str) -> DataFrame:
    contigs = sequences_from_documents(spark, d)
    longest = contigs.agg(F.max(F.length("seq"))).first()[0] or 0
    return A.drop_redundant(A.fuse_paths(A.align_chains(_chains(spark, d), contigs, longest))).drop("trace")


def chain_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Chains as boxes of antidiagonals and diagonals; those of one end, or inside another's box, go."""
    low = F.col("base") * A.BAND
    box = (F.col("alow").alias("abpos"), F.col("ahgh").alias("aepos"), (low + F.col("dlow")).alias("bbpos"), (low + F.col("dhgh") + 1).alias("bepos"))
    return A.drop_redundant(_chains(spark, d).select("ctg_a", "ctg_b", "comp", *box, F.lit(0).alias("diffs"))).drop("diffs")


def edit_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Scripts between the names of neighbouring parts of a brand: differences, and how much of both names they tell."""
    was = F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    found = scripts_of(table(spark, d, "part").withColumn("was", was).where("was is not null"), ["p_partkey"], "was", "p_name")
    told = lambda skip: F.aggregate("script", F.lit(0), lambda s, r: s + F.when(r["op"] == skip, 0).otherwise(r["n"]))
    return found.select("p_partkey", "n_diffs", told("I").alias("n_was"), told("D").alias("n_name"))


_EV = "ev as (select user_id, event_id, event_type, epoch_us(ts) b, epoch_us(ts) + cast(floor(coalesce(value, 0) * 60000000) as bigint) e from events)"
_BOTH = f"seqs as (select doc_id ctg, source scaf, {_ENC} seq from documents where length({_ENC}) >= 40 union all select -1 - item_id, null, {_ENC} from benchmark where length({_ENC}) >= 40)"
_BOX = """o as (select gr.ctg_a, gr.ctg_b, gr.comp, alow abpos, ahgh aepos, base * 64 + dlow bbpos, base * 64 + dhgh + 1 bepos from gr left join bands b
  on gr.ctg_a = b.ctg_a and gr.ctg_b = b.ctg_b and gr.comp = b.comp and b.band = gr.base - 1 where cov >= 170 and (mix <> 1 or b.band is null)),
o1 as (select *, row_number() over (partition by ctg_a, ctg_b, comp, abpos, bbpos order by aepos - abpos desc, aepos, bepos) n1 from o),
o2 as (select *, row_number() over (partition by ctg_a, ctg_b, comp, aepos, bepos order by aepos - abpos desc, abpos, bbpos) n2 from o1 where n1 = 1),
box as materialized (select ctg_a, ctg_b, comp, abpos, aepos, bbpos, bepos, aepos - abpos + bepos - bbpos size from o2 where n2 = 1)
select ctg_a, ctg_b, comp, abpos, aepos, bbpos, bepos from box x where not exists (select 1 from box w where w.ctg_a = x.ctg_a and w.ctg_b = x.ctg_b and w.comp = x.comp
  and x.abpos >= w.abpos - 10 and x.aepos <= w.aepos + 10 and x.bbpos >= w.bbpos - 10 and x.bepos <= w.bepos + 10
  and (w.size > x.size or (w.size = x.size and (w.abpos, w.bbpos, w.aepos, w.bepos) < (x.abpos, x.bbpos, x.aepos, x.bepos))))"""
_SQL = {
    "chain_boxes": _TO["seed"] + f", {_BAND}, {_CHAIN}, {_BOX}",
    "edit_scripts": "select p_partkey, levenshtein(p_name, was) n_diffs, length(was) n_was, length(p_name) n_name from (select *, lag(p_name) over (partition by p_brand order by p_partkey) was from part) where was is not null",
    "contig_gap_split": "with z as (select doc_id ctg, string_split_regex(text, '[^A-Za-z]{2,}') p, regexp_extract_all(text, '[^A-Za-z]{2,}') g from documents where text is not null), u as (select ctg, unnest(range(1, len(p) + 1)) k, p, g from z), v as (select ctg, k, length(p[k]) clen, coalesce(length(g[k]), 0) gap from u), w as (select *, sum(clen + gap) over (partition by ctg order by k rows unbounded preceding) - clen - gap sbeg from v) select ctg, k, cast(sbeg as bigint) sbeg, clen from w where clen > 0",
    "lcp_histogram": f"with {_SEQ}, {_POS}, {_REC}, g as (select kmer, lag(kmer) over (order by kmer, ctg, pos, strand) was from rec) select lcp, count(*) n from (select case when was is null then 0 else len(list_filter(range(1, 41), lambda k: kmer[1:k] = was[1:k])) end lcp from g) group by lcp",
    "interval_overlap_pairs": f"with {_EV} select a.user_id, a.event_id a, b.event_id b from ev a join ev b on a.user_id = b.user_id and b.b >= a.b and b.b < a.e and a.event_id <> b.event_id",
    "mask_values": f"with {_EV} select p.event_id, greatest(0, least({HOUR}, coalesce(max(m.e) - p.b, 0))) mask from ev p left join lateral (select u.e from (select min(b) b, max(e) e from (select *, sum(case when m is null or b > m then 1 else 0 end) over (partition by user_id order by b, e rows unbounded preceding) k from (select *, max(e) over (partition by user_id order by b, e rows between unbounded preceding and 1 preceding) m from ev where event_type = 'click')) t where t.user_id = p.user_id group by k) u where u.b <= p.b and p.b < u.e) m on true group by p.event_id, p.b",
    "order_violations": f"with {_EV}, l as (select *, coalesce(b < lag(b) over (partition by user_id order by event_id), false) fell from ev) select user_id, count(*) n_rows, count(*) filter (where fell) n_bad, min(event_id) filter (where fell) first_bad from l group by user_id",
    "value_runs": "with l as (select l_suppkey, l_orderkey, l_linenumber, l_returnflag, case when lag(l_returnflag) over w is not distinct from l_returnflag and row_number() over w > 1 then 0 else 1 end new from lineitem window w as (partition by l_suppkey order by l_orderkey, l_linenumber, l_returnflag)), r as (select *, sum(new) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_returnflag rows unbounded preceding) run from l) select l_suppkey, cast(run as bigint) run, any_value(l_returnflag) l_returnflag, count(*) n from r group by l_suppkey, run",
    "nearest_earlier_partner": "select *, row_number() over (partition by l_partkey order by l_suppkey desc) - 1 nearness from (select distinct l_partkey, l_suppkey from lineitem where l_suppkey < l_partkey)",
    "skeleton_match": "with s as (select conv_id, coalesce(cast(turn as varchar), '') || ':' || coalesce(role, '') || ':' || coalesce(length(text), 0) x from conversations), y as (select conv_id, string_agg(x, ',' order by x) layout from s group by conv_id) select conv_id, min(conv_id) over (partition by layout) first_match from y",
    "kmer_lookup": f"with {_BOTH}, {_POS}, {_REC}, k as (select kmer, count(*) n from rec where ctg >= 0 group by kmer) select -1 - ctg item_id, count(*) n_kmers, count(n) n_found, cast(coalesce(sum(n), 0) as bigint) n_places from rec left join k using (kmer) where ctg < 0 group by ctg",
    "median_cost": "select o_orderpriority, quantile_disc(o_totalprice, 0.5) median, min(o_totalprice) least, max(o_totalprice) most, count(*) n from orders group by 1",
    "log_cost_model": "with l as (select l_returnflag, ln(l_extendedprice) y, ln(l_quantity) u, ln(l_discount + 1) v from lineitem where l_quantity > 0 and l_extendedprice > 0), s as (select l_returnflag, covar_pop(u, u) uu, covar_pop(v, v) vv, covar_pop(u, v) uv, covar_pop(u, y) uy, covar_pop(v, y) vy, count(*) n from l group by 1) select l_returnflag, round((uy * vv - vy * uv) / (uu * vv - uv * uv), 4) by_quantity, round((vy * uu - uy * uv) / (uu * vv - uv * uv), 4) by_discount, n from s",
    "pair_weights": f"with {_SEQ}, t as (select scaf m, cast(sum(length(seq)) as bigint) n from seqs where scaf is not null group by 1) select a.m i, b.m j, a.n * b.n weight, row_number() over (order by a.n * b.n desc, a.m, b.m) nth from t a join t b on a.m <= b.m",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in [*_SQL, "align_overlaps"]}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
