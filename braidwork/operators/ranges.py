"""Overlaps of intervals, points in masks, runs of values, order checks and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import Scan, by_heat, carried_scans


def _floor_to(x: Column, width: int) -> Column:
    return x - F.pmod(x, F.lit(width))


def overlapping_pairs(rows: DataFrame, key: str, ident: str, beg: str, end: str, *, width: int) -> DataFrame:
    """(key, a, b): other intervals b of the key that start in [beg, end) of a; integer bounds.

    An interval goes to each bin of ``width`` that it touches, a start to the one bin that holds it, so a pair
    meets once and a long key is spread over its bins. Choose width near the usual length of an interval.
    """
    low, high = F.col(beg), F.col(end)
    bins = F.explode(F.sequence(_floor_to(low, width), _floor_to(high - 1, width), F.lit(width).cast("long"))).alias("bin")
    held = rows.where(high > low).select(key, F.col(ident).alias("a"), low.alias("a_beg"), high.alias("a_end"), bins)
    starts = rows.select(key, F.col(ident).alias("b"), low.alias("b_beg"), _floor_to(low, width).alias("bin"))
    return held.join(starts, [key, "bin"]).where("b_beg >= a_beg and b_beg < a_end and a <> b").select(key, "a", "b")


def _held(both: DataFrame, key: str, order: list[str], value: str, most_rows: int) -> DataFrame:
    """both with value: the last non-null one up to each row of the key in order; hot keys in ranges."""

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))

    def cut(part: DataFrame) -> DataFrame:
        part = part.withColumnRenamed(value, "_held")
        return carried_scans(part, [key], order, {value: Scan("last", F.col("_held"), upto=True)}).drop("_held")

    return by_heat(both, [key], plain, cut, most=most_rows)


def mask_ahead(points: DataFrame, masks: DataFrame, key: str, at: str, *, most: int, most_rows: int = 1 << 22) -> DataFrame:
    """points with mask: how far (``most`` at most) the disjoint mask (key, beg, end) that holds the point still goes, else 0.

    One sort of points and masks together takes the place of an interval join; a key of more than most_rows is cut into ranges.
    """
    marks = masks.select(key, F.col("beg").alias(at), F.lit(0).alias("kind"), F.col("end").alias("stop"))
    both = points.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    left = F.col("stop") - F.col(at)
    held = _held(both, key, [at, "kind"], "stop", most_rows).withColumn("mask", F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(left, F.lit(0))))).where("kind = 1")
    return held.select(*points.columns, "mask")


def value_runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, run, value, n): maximal runs of equal values of a key in order, numbered from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    new = rows.withColumn("new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    runs = new.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def expand_runs(runs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, run, value), each row of value_runs as often as it says: the runs decoded."""
    return runs.select(key, "run", value, F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).drop("col")


def order_violations(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, n_rows, n_bad, first_bad): places in order whose value is less than the one before."""
    fell = F.col(value) < F.lag(value).over(Window.partitionBy(key).orderBy(order))
    seen = rows.withColumn("fell", F.coalesce(fell, F.lit(False)))
    return seen.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_if("fell").alias("n_bad"), F.min(F.when(F.col("fell"), F.col(order))).alias("first_bad"))


def nearness(pairs: DataFrame, x: str, b: str) -> DataFrame:
    """Distinct pairs with b before x, and how many other partners of x lie between: 0 is the nearest."""
    earlier = pairs.select(x, b).where(F.col(b) < F.col(x)).distinct()
    return earlier.withColumn("nearness", F.row_number().over(Window.partitionBy(x).orderBy(F.desc(b))) - 1)


def same_layout(parts: DataFrame, key: str, described: Column) -> DataFrame:
    """(key, first_match): the least key whose parts have the same descriptions, its own if none is less."""
    layouts = parts.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(described)), ",").alias("layout"))
    return layouts.select(key, F.min(key).over(Window.partitionBy("layout")).alias("first_match"))


def split_at_gaps(scaffolds: DataFrame, key: str, seq: str, *, gap: str, least: int) -> DataFrame:
    """(key, k, sbeg, clen): stretches of seq between runs of at least ``least`` symbols of the class ``gap``.

    Shorter runs stay in their stretch. k counts stretches from 1, empty ones at the ends included, which are left out.
    """
    cut = f"{gap}{{{least},}}"
    lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    sized = scaffolds.where(F.col(seq).isNotNull()).select(
        key, F.arrays_zip(lengths(F.split(seq, cut, -1)).alias("clen"), lengths(F.regexp_extract_all(seq, F.lit(f"({cut})"), 1)).alias("gap")).alias("z")
    )
    parts = sized.select(key, F.posexplode("z").alias("k", "z")).select(key, (F.col("k") + 1).alias("k"), "z.clen", F.coalesce("z.gap", F.lit(0)).alias("gap"))
    before = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("sbeg", F.coalesce(F.sum(F.col("clen") + F.col("gap")).over(before), F.lit(0))).where("clen > 0").select(key, "k", "sbeg", "clen")


def in_parts(spans: DataFrame, parts: DataFrame, key: str, *, most_rows: int = 1 << 22) -> DataFrame:
    """(key, k, beg, end): spans (key, beg, end) in the coordinates of the parts (key, k, sbeg, clen), disjoint, that hold their starts.

    Spans that begin in no part go. One sort of both together takes the place of an interval join; hot keys are cut into ranges.
    """
    marks = parts.select(key, F.col("sbeg").alias("beg"), F.lit(0).alias("kind"), F.struct("k", "sbeg", (F.col("sbeg") + F.col("clen")).alias("stop")).alias("part"))
    both = spans.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    held = _held(both, key, ["beg", "kind"], "part", most_rows).where("kind = 1 and beg < part.stop")
    return held.select(key, "part.k", (F.col("beg") - F.col("part.sbeg")).alias("beg"), (F.col("end") - F.col("part.sbeg")).alias("end"))
