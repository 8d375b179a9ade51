"""Scans carried over blocks of a key, against windows over whole keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from braidwork.operators import ranges, relational, seeding
from braidwork.operators.order import Scan, average_ranks, by_heat, carried_scans


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), t, rng.choice([None, rng.randrange(50)])) for t in range(600)]
    return spark.createDataFrame([(k, rng.randrange(400), i, v) for i, (k, _, v) in enumerate(rows)], "k long, t long, i long, v long").repartition(5)


@pytest.mark.parametrize("block", [None, 7, 90, 10**6])
def test_carried_scans_equal_windows(points, block):
    whole = Window.partitionBy("k").orderBy("t", "i")
    before, upto = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda w: F.last("v", ignorenulls=True).over(w)
    want = points.select("*", F.max("v").over(before).alias("a"), F.sum("v").over(upto).alias("b"), last(before).alias("c"), last(upto).alias("d"))
    v = F.col("v")
    scans = {"a": Scan("max", v), "b": Scan("sum", v, upto=True), "c": Scan("last", v), "d": Scan("last", v, upto=True)}
    got = carried_scans(points, ["k"], ["t", "i"], scans, block=None if block is None else F.floor(F.col("t") / block))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_keys_go_another_way(points):
    mark = lambda x: lambda rows: rows.withColumn("way", F.lit(x))
    got = {(r.k, r.way) for r in by_heat(points, ["k"], mark("plain"), mark("carried"), most=110).collect()}
    assert got == {(1, "carried"), (None, "plain"), (2, "plain"), (3, "plain")}
    assert {r.way for r in by_heat(points, ["k"], mark("plain"), mark("carried"), most=10**6).collect()} == {"plain"}


def test_operators_give_the_same_rows_for_hot_keys(spark, points):
    spans = points.where("t is not null").select("k", F.col("t").alias("b"), (F.col("t") + F.coalesce("v", F.lit(0)) % 5).alias("e"))
    same = lambda one, other: sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    union = relational.interval_union(spans, "k", "b", "e")
    assert union.count() > 20 and same(union, relational.interval_union(spans, "k", "b", "e", most=10))
    args = ("k", ["t", "i"], F.col("v"), "was")
    assert same(relational.carried(points, *args), relational.carried(points, *args, most=10))
    masks = union.where("k is not null").select("k", F.col("beg"), F.col("end"))
    held = [ranges.mask_ahead(points.select("k", "i", "t"), masks, "k", "t", most=9, most_rows=n) for n in (10**6, 10)]
    assert same(*held) and held[0].where("mask > 0").count() > 5
    assert same(average_ranks(points, "k", "v", "rank"), average_ranks(points, "k", "v", "rank", most=10))
    parts = masks.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy("beg"))).select("k", F.col("p").alias("k2"), F.col("beg").alias("sbeg"), (F.col("end") - F.col("beg")).alias("clen"))
    parts, own = parts.withColumnRenamed("k", "q").withColumnRenamed("k2", "k"), spans.select(F.col("k").alias("q"), F.col("b").alias("beg"), F.col("e").alias("end"))
    found = [ranges.in_parts(own, parts, "q", most_rows=n) for n in (10**6, 10)]
    assert same(*found) and found[0].count() > 20


@pytest.mark.parametrize("block", [50, 1000, 10**7])
def test_chains_do_not_depend_on_blocks(spark, block):
    rng = random.Random(block)
    rows = [(1, 1 + rng.randrange(2), False, 5 + rng.randrange(4), rng.randrange(9000), rng.randrange(64), rng.choice([12, 20, 40])) for _ in range(900)]
    seeds = spark.createDataFrame(rows + rows[:40], "ctg_a long, ctg_b long, comp boolean, band long, ad long, dg long, plen int").repartition(3)
    want = seeding.chains(seeds, block=None).collect()
    assert len(want) > 3 and sorted(map(str, seeding.chains(seeds, block=block).collect())) == sorted(map(str, want))


def test_block_is_left_out_for_short_contigs():
    assert seeding.block_for(1000) is None and seeding.block_for(seeding.BLOCK) == seeding.BLOCK
