"""Edit scripts and redundant boxes against full tables and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from braidwork.operators import alignment, scripts, seeding


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j - 1] + (x != y), prev[j] + 1, row[-1] + 1))
    return row[-1]


def some_pairs(rng, n):
    for _ in range(n):
        letters = rng.choice(["ab", "acgt"])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(90)))
        rate = rng.choice([0, 0.1, 0.5, 1])
        b = "".join(x if rng.random() > rate else rng.choice(letters) for x in a if rng.random() > rate / 3) + rng.choice(["", letters])
        yield a.encode(), b.encode()


def test_scripts_replay_and_cost_the_least():
    for a, b in [(b"", b""), (b"a", b""), (b"", b"bc"), (b"abc", b"abc"), *some_pairs(random.Random(1), 250)]:
        script = scripts.edit_script(a, b)
        assert scripts.replay(script, a, b) == b and scripts.differences(script) == edits(a, b)
        assert all(x[0] != y[0] for x, y in zip(script, script[1:], strict=False))


def test_gaps_meet_where_that_costs_nothing():
    fewer = 0
    for a, b in some_pairs(random.Random(2), 300):
        script = scripts.edit_script(a, b)
        better = scripts.fewer_gaps(script, a, b)
        assert scripts.replay(better, a, b) == b
        assert scripts.differences(better) <= scripts.differences(script) and scripts.gaps(better) <= scripts.gaps(script)
        fewer += scripts.gaps(better) < scripts.gaps(script)
    assert fewer > 5
    a, b = b"xxaaaayy", b"xxaayy"
    assert scripts.fewer_gaps([("=", 2), ("D", 1), ("=", 2), ("D", 1), ("=", 2)], a, b) == [("=", 2), ("D", 2), ("=", 4)]


def test_scripts_of_rows_and_printed_columns(spark):
    rows = [(1, "kitten", "sitting"), (2, None, "x"), (3, "", "ab"), (4, "é", "è")]
    found = scripts.scripts_of(spark.createDataFrame(rows, "k long, x string, y string"), ["k"], "x", "y")
    got = {r.k: r for r in found.collect()}
    assert [got[k].n_diffs for k in (1, 2, 3, 4)] == [3, None, 2, 1] and got[2].script is None and got[3].n_gaps == 1
    both = scripts.printed(found.join(spark.createDataFrame(rows, "k long, x string, y string"), "k").where("k = 1"), "x", "y").first()
    assert (both.a_line.replace("-", ""), both.b_line.replace("-", "")) == ("kitten", "sitting") and len(both.a_line) == len(both.marks) == len(both.b_line)
    assert all((m == "|") == (x == y) for x, m, y in zip(both.a_line, both.marks, both.b_line, strict=True))


@pytest.mark.parametrize("tile", [100, 4096])
def test_scripts_along_alignments(spark, tile):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("0123") for _ in range(n))
    shared = make(900)
    worn = "".join(rng.choice("0123") if rng.random() < 0.05 else x for x in shared if rng.random() > 0.02)
    flip = lambda s: s[::-1].translate(str.maketrans("0123", "3210"))
    seqs = [make(500) + shared + make(300), make(100) + worn + make(700), make(250) + flip(worn) + make(50)]
    contigs = spark.createDataFrame(list(enumerate(seqs)), "ctg long, seq string")
    longest = max(map(len, seqs))
    found = alignment.align_chains(seeding.chains(seeding.banded(seeding.seeds(seeding.packed_records(contigs)), longest)), contigs, longest)
    rows = scripts.alignment_scripts(alignment.drop_redundant(found), contigs, tile=tile).collect()
    assert {(r.ctg_a, r.ctg_b, r.comp) for r in rows} == {(0, 1, False), (0, 2, True), (1, 2, True)}
    for r in rows:
        a, b = seqs[r.ctg_a], flip(seqs[r.ctg_b]) if r.comp else seqs[r.ctg_b]
        a, b = a[r.abpos : r.aepos].encode(), b[r.bbpos : r.bepos].encode()
        script = [(s.op, s.n) for s in r.script]
        assert scripts.replay(script, a, b) == b and edits(a, b) <= r.n_diffs == scripts.differences(script) <= r.diffs


def plain_redundant(rows):
    for x, y in ((1, 2), (3, 4)):
        best = {}
        for r in sorted(rows, key=lambda r: (-(r[3] - r[1]), r[5], r[1], r[2], r[3], r[4])):
            best.setdefault((r[0], r[x], r[y]), r)
        rows = list(best.values())
    size = lambda r: (r[3] - r[1] + r[4] - r[2], tuple(-v for v in r[1:5]))
    inside = lambda o, w: o[0] == w[0] and o[1] >= w[1] - 10 and o[3] <= w[3] + 10 and o[2] >= w[2] - 10 and o[4] <= w[4] + 10
    return sorted(o for o in rows if not any(inside(o, w) and size(w) > size(o) for w in rows))


def boxes(spark, rows):
    return spark.createDataFrame(rows, "ctg_a long, abpos int, bbpos int, aepos int, bepos int, diffs int").withColumn("ctg_b", F.lit(5)).withColumn("comp", F.lit(False))


@pytest.mark.parametrize("seed", range(4))
def test_redundant_boxes_equal_the_plain_rule(spark, seed):
    rng, rows = random.Random(seed), []
    for _ in range(400):
        x, y, n = rng.randrange(-20, 600), rng.randrange(600), rng.choice([1, 5, 30, 200, 900])
        rows.append((rng.randrange(2), x, y, x + n + rng.randrange(9), y + n + rng.randrange(9), rng.randrange(5)))
    got = alignment.drop_redundant(boxes(spark, rows + rows[:50])).collect()
    assert sorted((r.ctg_a, r.abpos, r.bbpos, r.aepos, r.bepos, r.diffs) for r in got) == plain_redundant(rows)


def test_many_boxes_of_one_pair(spark):
    rng = random.Random(7)
    rows = [(1, x := rng.randrange(10**7), y := rng.randrange(10**7), x + rng.randrange(60, 4000), y + rng.randrange(60, 4000), 0) for _ in range(100_000)]
    assert 90_000 < alignment.drop_redundant(boxes(spark, rows)).count() <= 100_000
