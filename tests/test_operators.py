"""Operators against brute force in Python."""

import random

from pyspark.sql import functions as F

from braidwork.operators import relational, seeding


def test_syncmers_and_records_against_brute_force(spark):
    rng = random.Random(1)
    contigs = [(k, "".join(rng.choice("0123") for _ in range(n))) for k, n in enumerate((11, 12, 41, 67, 68, 300))] + [(9, "0" * 60)]
    rank = lambda w: (int(w, 4) * 167 + 13) % 256
    comp = lambda w: w[::-1].translate(str.maketrans("0123", "3210"))
    one = lambda w: rank(w[:4]) * 256 + rank(w[4:])
    want = set()
    for ctg, s in contigs:
        mz = [min(one(s[i : i + 8]), one(comp(s[i : i + 8]))) for i in range(len(s) - 7)]
        for j in range(len(mz) - 4):
            if min(mz[j : j + 5]) in (mz[j], mz[j + 4]):
                if j <= len(s) - 40:
                    want.add((ctg, j, 0, s[j : j + 40]))
                if j >= 28 and j + 12 <= len(s):
                    want.add((ctg, j + 12, 1, comp(s[j - 28 : j + 12])))
    got = seeding.records(spark.createDataFrame(contigs, "ctg long, seq string")).select("ctg", "pos", "strand", "kmer").collect()
    assert len(got) == len(want) > 50 and {tuple(r) for r in got} == want


def test_interval_union_joins_touching_intervals(spark):
    data = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 8, 9), (1, 1, 2), (2, 3, 4)], "k int, b int, e int")
    got = {tuple(r) for r in relational.interval_union(data, "k", "b", "e").collect()}
    assert got == {(1, 0, 7, 3), (1, 8, 9, 1), (2, 3, 4, 1)}


def test_bag_difference_counts_copies(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "x string") for s in ("aabc", "abbc"))
    assert {tuple(r) for r in relational.bag_difference(a, b).collect()} == {("a", 2, 1), ("b", 1, 2)}


def test_carried_takes_the_latest_earlier_value(spark):
    data = spark.createDataFrame([(1, 1, None), (1, 2, 7), (1, 3, None), (1, 4, 9)], "k int, t int, v int")
    got = relational.carried(data, "k", ["t"], F.col("v"), "last").orderBy("t").collect()
    assert [r["last"] for r in got] == [None, None, 7, 7]
