"""Intervals, bags, as-of values and load statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import stored
from .order import Scan, by_heat, carried_scans


def interval_union(rows: DataFrame, key: str, beg: str, end: str, *, most: int = 1 << 22) -> DataFrame:
    """(key, beg, end, n): unions of touching or overlapping intervals of a key; keys of more than most rows are cut into ranges."""

    def marked(part: DataFrame, reach: Column) -> DataFrame:
        return part.withColumn("new", F.when(reach.isNull() | (F.col(beg) > reach), 1).otherwise(0))

    def plain(part: DataFrame) -> DataFrame:
        order = Window.partitionBy(key).orderBy(beg, end)
        found = marked(part, F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        return found.withColumn("grp", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def carried_(part: DataFrame) -> DataFrame:
        # a total order, so that both scans see the rows in the same one
        part = part.select(key, beg, end).withColumn("_row", F.monotonically_increasing_id())
        part, order = stored(part), [beg, end, "_row"]
        reach = carried_scans(part, [key], order, {"_reach": Scan("max", F.col(end))})
        found = marked(reach, F.col("_reach")).drop("_reach")
        return carried_scans(found, [key], order, {"grp": Scan("sum", F.col("new"), upto=True)}).drop("_row")

    grouped = by_heat(rows.select(key, beg, end), [key], plain, carried_, most=most)
    return grouped.groupBy(key, "grp").agg(F.min(beg).alias("beg"), F.max(end).alias("end"), F.count("*").alias("n")).drop("grp")


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose multiplicities differ, with both: one aggregate over the union, no join."""
    columns = left.columns
    both = left.withColumn("l", F.lit(1)).withColumn("r", F.lit(0)).unionByName(right.withColumn("l", F.lit(0)).withColumn("r", F.lit(1)))
    return both.groupBy(*columns).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).where("n_left <> n_right")


def carried(rows: DataFrame, key: str, order: list[str], value: Column, name: str, *, most: int = 1 << 22) -> DataFrame:
    """rows with the latest non-null value of an earlier row of the key; keys of more than most rows are cut into ranges."""

    def plain(part: DataFrame) -> DataFrame:
        before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return part.withColumn(name, F.last(value, ignorenulls=True).over(before))

    return by_heat(rows, [key], plain, lambda part: carried_scans(part, [key], order, {name: Scan("last", value)}), most=most)
