"""Numbers, running totals and ranks in a global order, and values carried over rows of an order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import stored


def running_total(rows: DataFrame, order: list[str], weight: Column, name: str) -> DataFrame:
    """rows with name: the sum of weight over all rows before in order (which must be total, for one result).

    Rows are cut into sorted ranges; what the ranges before hold is added from a table of one row a range.
    """
    cut = rows.withColumn("_w", weight).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    cut = stored(cut)  # ranges are drawn anew each time they are planned
    offset = cut.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = offset.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return summed.join(F.broadcast(offset), "_part").select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_base") + F.col("_in")).alias(name))


@dataclass(frozen=True)
class Scan:
    """A running value over the rows of a key before each row, or up to it: kind is max, sum or last (non-null)."""

    kind: str
    value: Column
    upto: bool = False


_AGGREGATES = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}
_JOINED = {"max": F.greatest, "sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "last": lambda a, b: F.coalesce(b, a)}


def carried_scans(rows: DataFrame, key: list[str], order: list[str], scans: dict[str, Scan], *, block: Column | None = None) -> DataFrame:
    """rows with a column for each scan over the rows of its key, in order, none of which lies in one task whole.

    A key is worked on in blocks, each with what the blocks before it carry to it. block: of a row, rising with order;
    by default the sorted range that the row falls into, and then the table of what is carried has a row a range at most,
    as only a range's first key can go on from the range before.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    cut = rows.select("*", *(s.value.alias(f"_v_{n}") for n, s in scans.items()))
    if block is None:
        cut = stored(cut.repartitionByRange(*key, *order).withColumn("_block", F.spark_partition_id()))
    else:
        cut = cut.withColumn("_block", block)
    with_key = [*key, "_block"]
    if any(s.kind == "last" for s in scans.values()):
        place = F.struct(*order)
        ends = [(F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), place)) if s.kind == "last" else _AGGREGATES[s.kind](f"_v_{n}")).alias(f"_c_{n}") for n, s in scans.items()]
    else:
        ends = [_AGGREGATES[s.kind](f"_v_{n}").alias(f"_c_{n}") for n, s in scans.items()]
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = cut.groupBy(*with_key).agg(*ends)
    carry = carry.select(*with_key, F.row_number().over(Window.partitionBy(*key).orderBy("_block")).alias("_nth"), *(_AGGREGATES[s.kind](f"_c_{n}").over(earlier).alias(f"_c_{n}") for n, s in scans.items()))
    carry = carry.where("_nth > 1").drop("_nth")
    inside = Window.partitionBy(*with_key).orderBy(*order)
    frames = {n: inside.rowsBetween(Window.unboundedPreceding, 0 if s.upto else -1) for n, s in scans.items()}
    found = cut.select("*", *(_AGGREGATES[s.kind](f"_v_{n}").over(frames[n]).alias(f"_i_{n}") for n, s in scans.items()))
    carry = carry.toDF(*(f"_k_{c}" for c in with_key), *carry.columns[len(with_key) :])
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in with_key]
    found = found.join(F.broadcast(carry) if block is None else carry, same, "left")
    return found.select(*columns, *(_JOINED[s.kind](F.col(f"_c_{n}"), F.col(f"_i_{n}")).alias(n) for n, s in scans.items()))


def by_heat(rows: DataFrame, key: list[str], plain: Callable[[DataFrame], DataFrame], carried: Callable[[DataFrame], DataFrame], *, most: int = 1 << 22) -> DataFrame:
    """plain over the rows of keys with up to most rows, together with carried over those of the others.

    Both must give the same columns; of keys with more than most rows there are few by their nature.
    """
    hot = stored(rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).drop("_n"))
    if not hot.take(1):
        return plain(rows)
    hot = F.broadcast(hot.toDF(*(f"_hot_{c}" for c in key)))
    same = [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in key]
    return plain(rows.join(hot, same, "left_anti")).unionByName(carried(rows.join(hot, same, "left_semi")))


def numbered(rows: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """rows with their number, from 1, in order."""
    return running_total(rows, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) + 1)


def value_ranks(rows: DataFrame, key: str, by: str) -> DataFrame:
    """(key, by, n, before, total): each distinct value of a key, its rows, the key's rows below it, and all the key's rows."""
    counts = rows.where(F.col(by).isNotNull()).groupBy(key, by).agg(F.count("*").alias("n"))
    summed = stored(running_total(counts, [key, by], F.col("n"), "all_before"))
    base = summed.groupBy(F.col(key).alias("_key")).agg(F.min("all_before").alias("_first"), F.sum("n").alias("total"))
    return summed.join(base, F.col(key).eqNullSafe(F.col("_key"))).select(key, by, "n", (F.col("all_before") - F.col("_first")).alias("before"), "total")


def average_ranks(rows: DataFrame, key: str, by: str, name: str, *, most: int = 1 << 22) -> DataFrame:
    """rows with the rank of by within key, ties averaged; no key of more than most rows is sorted in one task."""

    def plain(part: DataFrame) -> DataFrame:
        ties = F.count("*").over(Window.partitionBy(key, by))
        return part.withColumn(name, F.rank().over(Window.partitionBy(key).orderBy(by)) + (ties - 1) / F.lit(2.0))

    def ranged(part: DataFrame) -> DataFrame:
        ranks = value_ranks(part, key, by).select(F.col(key).alias("_key"), F.col(by).alias("_by"), (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias(name))
        return part.join(ranks, F.col(key).eqNullSafe(F.col("_key")) & (F.col(by) == F.col("_by"))).drop("_key", "_by")

    return by_heat(rows.where(F.col(by).isNotNull()), [key], plain, ranged, most=most)


def lower_medians(rows: DataFrame, key: str, by: str) -> DataFrame:
    """(key, median): the least value with half of the key's rows, or more, at or below it."""
    ranks = value_ranks(rows, key, by)
    return ranks.where(2 * (F.col("before") + F.col("n")) >= F.col("total")).groupBy(key).agg(F.min(by).alias("median"))


def longest_first(contigs: DataFrame, ctg: str, length: Column) -> DataFrame:
    """(ctg, clen, place): contigs numbered from 0, the longest first, ties by ctg."""
    rows = contigs.select(F.col(ctg).alias("ctg"), length.alias("clen"), (-length).alias("_neg"))
    return numbered(rows, ["_neg", "ctg"], "place").select("ctg", "clen", (F.col("place") - 1).alias("place"))


def permutation_faults(rows: DataFrame, key: str, place: str, *, first: int) -> DataFrame:
    """(key, n, valid): whether a key's places are first, first + 1, ... without gap, repeat or null."""
    n, p = F.count("*"), F.col(place)
    valid = (F.count(p) == n) & (F.count_distinct(p) == n) & (F.min(p) == first) & (F.max(p) == n + first - 1)
    return rows.groupBy(key).agg(n.alias("n"), F.coalesce(valid, F.lit(False)).alias("valid"))


def self_values(calls: DataFrame, group: str, x: str, y: str, value: str, *, unset_first: int = 32767, unset: int = 0) -> DataFrame:
    """(group, x, value, from_x, from_y): what the pair (x, x) finds left by the call before it.

    calls (group, x, y, value): pairs in the order of x, then y; a null value is a pair that made no call. The
    nearest earlier partner of x that made a call counts; else the last call of the nearest earlier row of the
    group, whatever side of its self pair it stands on; else unset_first in the least group, unset in others.
    A self pair that made no call passes on what it found, so chains of such pairs need no rounds.
    Within a row first, then between rows by one row each: no window spans all calls.
    """
    made = calls.where(F.col(value).isNotNull())
    last = F.max(F.struct(F.col(y).alias("y"), F.col(value).alias("v")))
    rows = calls.select(group, x).distinct()
    near = made.where(F.col(y) < F.col(x)).groupBy(group, x).agg(last.alias("near"))
    whole = made.groupBy(group, x).agg(last.alias("whole"))
    both = rows.join(near, [group, x], "left").join(whole, [group, x], "left")
    earlier = Window.partitionBy(group).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    held = F.when(F.col("whole").isNotNull(), F.struct(F.col(x).alias("x"), F.col("whole.y").alias("y"), F.col("whole.v").alias("v")))
    both = both.withColumn("row", F.last(held, ignorenulls=True).over(earlier))
    lowest = calls.agg(F.min(group)).first()[0]
    none = F.when(F.col(group) == F.lit(lowest), unset_first).otherwise(unset)
    found = F.when(F.col("near").isNotNull(), F.struct(F.col("near.v").alias("v"), F.col(x).alias("x"), F.col("near.y").alias("y"))).otherwise(
        F.struct(F.coalesce("row.v", none).alias("v"), F.col("row.x").alias("x"), F.col("row.y").alias("y"))
    )
    return both.withColumn("f", found).select(group, x, F.col("f.v").alias("value"), F.col("f.x").alias("from_x"), F.col("f.y").alias("from_y"))


def delta_coded(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """rows with delta: value less the one before in the key's order (the first: value itself)."""
    return rows.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(key).orderBy(*order)), F.lit(0)))


def delta_decoded(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows of delta_coded with the values summed back."""
    return rows.withColumn(name, F.sum("delta").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
