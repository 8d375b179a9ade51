"""Global orders, carried values, k-mer tables and text reports against brute force."""

import random

from pyspark.sql import functions as F

from braidwork.functions.bases import digits, letters
from braidwork.operators import kmers, order, ranges
from braidwork.operators import seeding as S
from braidwork.sources import fasta, reports


def test_numbers_and_totals_cross_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), k, rng.randrange(9)) for k in range(500)]
    data = spark.createDataFrame(rows, "x int, k int, w int").repartition(7)
    want, total = {}, 0
    for n, (x, k, w) in enumerate(sorted(rows), 1):
        want[k] = (n, total)
        total += w
    for parts in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {r.k: r.rn for r in order.numbered(data, ["x", "k"]).collect()} == {k: n for k, (n, _) in want.items()}
        assert {r.k: r.t for r in order.running_total(data, ["x", "k"], F.col("w"), "t").collect()} == {k: t for k, (_, t) in want.items()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ranks_and_medians(spark):
    rows = [("a", 5.0), ("a", 1.0), ("a", 5.0), ("b", 2.0), (None, 3.0), (None, 4.0), ("b", None)]
    data = spark.createDataFrame(rows, "k string, v double")
    got = sorted((str(r.k), r.v, r.r) for r in order.average_ranks(data, "k", "v", "r").collect())
    assert got == [("None", 3.0, 1.0), ("None", 4.0, 2.0), ("a", 1.0, 1.0), ("a", 5.0, 2.5), ("a", 5.0, 2.5), ("b", 2.0, 1.0)]
    assert {r.k: r["median"] for r in order.lower_medians(data, "k", "v").collect()} == {"a": 5.0, "b": 2.0, None: 3.0}


def test_permutations_are_checked(spark):
    rows = [(1, 0), (1, 1), (1, 2), (2, 0), (2, 2), (3, 0), (3, 0), (4, None), (5, 1)]
    assert {r.k: r.valid for r in order.permutation_faults(spark.createDataFrame(rows, "k int, p int"), "k", "p", first=0).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    contigs = spark.createDataFrame([(1, "0" * 5), (2, "0" * 9), (3, "0" * 5)], "ctg long, seq string")
    assert [(r.ctg, r.place) for r in order.longest_first(contigs, "ctg", F.length("seq")).orderBy("place").collect()] == [(2, 0), (1, 1), (3, 2)]


def test_self_values_equal_a_walk_through_the_calls(spark):
    rng = random.Random(7)
    calls = sorted({(g, x): None for g in (0, 1) for x in range(g * 20, g * 20 + 20)})
    rows = [(g, x, y, rng.randrange(1000) if rng.random() < 0.3 else None) for g, x in calls for y in rng.sample(range(40), rng.randrange(1, 6)) if y != x]
    want, last, group = {}, None, None
    for g, x in sorted({r[:2] for r in rows}):
        if g != group:
            last, group = (0 if g else 32767, None, None), g
        for _, _, y, v in sorted((r for r in rows if r[:2] == (g, x) and r[2] < x), key=lambda r: r[2]):
            last = (v, x, y) if v is not None else last
        want[g, x] = last  # the self pair makes no call of its own
        for _, _, y, v in sorted((r for r in rows if r[:2] == (g, x) and r[2] > x), key=lambda r: r[2]):
            last = (v, x, y) if v is not None else last
    got = {(r.g, r.x): (r["value"], r.from_x, r.from_y) for r in order.self_values(spark.createDataFrame(rows, "g int, x int, y int, v int"), "g", "x", "y", "v").collect()}
    assert got == want and len({v for v in want.values()}) > 10


def test_kmer_tables(spark):
    rng = random.Random(9)
    contigs = [(k, "".join(rng.choice("0123") for _ in range(300))) for k in range(4)]
    contigs.append((4, contigs[0][1][50:250]))
    data = spark.createDataFrame(contigs, "ctg long, seq string")
    plain, packed = S.records(data), S.packed_records(data)
    said = {r.kmer: r.n for r in plain.groupBy("kmer").agg(F.count("*").alias("n")).collect()}
    table = kmers.kmer_counts(packed)
    text = lambda r: "".join(str(x >> 2 * (19 - k) & 3) for x in (r.hi, r.lo) for k in range(20))
    assert {text(r): r.n for r in table.collect()} == said
    assert {text(r) for r in kmers.kmer_counts(packed, at_least=2).collect()} == {k for k, n in said.items() if n > 1} != set()
    assert {text(r) for r in kmers.kmer_range(table, "1", "21").collect()} == {k for k in said if "1" <= k < "21"}
    ordered = sorted(said)
    assert [(r.rn, text(r)) for r in kmers.kmers_at(table, 10).orderBy("rn").collect()] == [(n + 1, k) for n, k in enumerate(ordered) if n % 10 == 0]
    lcps = {r["ctg"]: r for r in S.kmer_table(packed).groupBy("ctg").agg(F.max("lcp").alias("m")).collect()}
    assert lcps[4].m == 40 or lcps[0].m == 40
    masks = spark.createDataFrame([(0, 0, 300)], "ctg long, beg int, end int")
    found = S.seeds(packed)
    left = S.unmasked(found, masks)
    assert found.where("ctg_a = 0 or ctg_b = 0").count() > 0
    want = [r for r in found.collect() if all(c != 0 or min(40, max(0, 300 - p)) < r.plen for c, p in ((r.ctg_a, r.pos_a), (r.ctg_b, r.pos_b)))]
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, want))


def test_ranks_may_be_given(spark):
    rng = random.Random(1)
    data = spark.createDataFrame([(1, "".join(rng.choice("0123") for _ in range(200)))], "ctg long, seq string")
    rule = [(c * 167 + 13) % 256 for c in range(256)]
    assert {tuple(r) for r in S.records(data).collect()} == {tuple(r) for r in S.records(data, rule).collect()}
    assert {tuple(r) for r in S.records(data).collect()} != {tuple(r) for r in S.records(data, list(range(256))).collect()}


def test_text_reports_round_trip(spark, tmp_path):
    tasks = spark.createDataFrame([(1, "N", 0.5), (2, "C", 1.25)], "tid long, type string, seconds double")
    for k in range(2):
        reports.write_table(tasks, str(tmp_path / "tasks"), add=k > 0)
    assert sorted(map(tuple, reports.read_table(spark, str(tmp_path / "tasks"), "tid long, type string, seconds double").collect())) == [(1, "N", 0.5)] * 2 + [(2, "C", 1.25)] * 2
    (tmp_path / "log").write_text("[x] rank 0: seeds=10 align_s=2.5, note=ok\nnothing here=1\n[x] rank 1: seeds=30 align_s=1.5\n")
    log = reports.read_log(spark, str(tmp_path / "log"))
    assert {(r.key, r.n, r.total, r.most, r.imbalance) for r in reports.rank_totals(log).collect()} == {("seeds", 2, 40.0, 30.0, 1.5), ("align_s", 2, 4.0, 2.5, 1.25)}
    masks = spark.createDataFrame([(1, 10 * k, 10 * k + 5) for k in range(7)] + [(2, 3, 4)], "ctg long, beg long, end long")
    reports.write_annotations(masks, str(tmp_path / "masks"))
    assert sorted(len(r.value.split()) for r in spark.read.text(str(tmp_path / "masks")).collect()) == [2, 3, 6]
    assert sorted(map(tuple, reports.read_annotations(spark, str(tmp_path / "masks")).collect())) == sorted(map(tuple, masks.collect()))
    recs = spark.createDataFrame([(3, 7, 1, 12, "0123" * 10)], "ctg long, pos int, strand int, lcp int, kmer string")
    fasta.write_kmers(recs, str(tmp_path / "k"))
    assert list(map(tuple, fasta.read_kmers(spark, str(tmp_path / "k")).collect())) == [(3, 7, 1, 12, "0123" * 10)]
    bases = spark.createDataFrame([("acGTn",)], "b string")
    assert bases.select(digits(F.col("b")), letters(digits(F.col("b")))).first()[:] == ("01230", "ACGTA")


def test_spans_move_to_the_parts_that_hold_them(spark):
    parts = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 20, 5)], "name string, k int, sbeg int, clen int")
    spans = spark.createDataFrame([("a", 2, 4), ("a", 12, 14), ("a", 20, 22), ("b", 0, 1)], "name string, beg int, end int")
    assert sorted(map(tuple, ranges.in_parts(spans, parts, "name").collect())) == [("a", 1, 2, 4), ("a", 2, 0, 2)]


def test_empty_tables_give_no_rows(spark):
    contigs = spark.createDataFrame([], "ctg long, seq string")
    packed = S.packed_records(contigs)
    assert S.seeds(packed).count() == S.kmer_table(packed).count() == S.lcp_histogram(packed).where("lcp > 0").count() == 0
    assert S.chains(S.banded(S.seeds(packed), 0)).count() == kmers.prefix_cumulative(packed).count() == kmers.kmers_at(kmers.kmer_counts(packed), 10).count() == 0
    pairs = spark.createDataFrame([], "k string, x int, y int, v int")
    assert order.self_values(pairs, "k", "x", "y", "v").count() == order.average_ranks(pairs, "k", "v", "r").count() == order.lower_medians(pairs, "k", "v").count() == 0
