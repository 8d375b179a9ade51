"""Rows dealt out where they are made: blocks, pairs, chains and counts by contig, against plain sums and Spark's windows."""

import bisect
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_dealing import contigs_of

from braidwork.functions.bases import reverse_complement
from braidwork.operators import dealing
from braidwork.operators import kmers as K
from braidwork.operators import seeding as S
from braidwork.sources import sequences


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def more_contigs(spark):
    """contigs_of with turned copies and a stretch twice in one, for chains on both strands and with itself."""
    contigs = contigs_of(spark)
    turned = contigs.where("ctg < 0").select(F.col("ctg") + 1000, reverse_complement(F.col("seq")))
    twice = contigs.where("ctg = -13").selectExpr("ctg + 2000", "repeat(substr(seq, 1, 150), 2)")
    shifted = contigs.where("ctg in (-20, -13)").selectExpr("ctg + 3000", "concat(substr(seq, 1, 120), '0123', substr(seq, 121, 120), '01', substr(seq, 241))")
    return contigs.unionAll(turned).unionAll(twice).unionAll(shifted)


def test_blocks_give_their_rows_back_in_order():
    rng = np.random.default_rng(0)
    for n in (*range(1, 70), 1000):
        for most in ((5, 5, 5, 5), (1 << 40, 1 << 40, 9, 9), (3, 1 << 55, 1 << 55, 3), (1 << 60, 2, 3, 4)):
            cols = [rng.integers(-x // 2, x // 2 + 1, n) for x in most]
            for c in cols:
                c[rng.random(n) < 0.5] = c[0]
            want = [c[np.lexsort(cols[::-1])] for c in cols]
            got = [c[dealing.in_order(cols)] for c in cols]
            planes, wide, least = dealing._planes([np.diff(got[0], prepend=got[0][0]), *got[1:]])
            back = dealing._unpacked(dealing._packed(n, wide, int(got[0][0]), least, planes.T.tobytes()))
            assert all((x == y).all() and (x == z).all() for x, y, z in zip(want, got, back, strict=True))


def test_chains_are_found_where_seeds_meet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("braidwork.store.shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(dealing, "BATCH_ROWS", 500)
    contigs = more_contigs(spark).cache()
    made, mixed = S.packed(contigs), set()
    for longest in (448, 437):  # chains on one band, and over two
        want = sorted(map(tuple, S.chains(S.banded(S.chain_seeds(made), longest), block=None).select("ctg_a", "ctg_b", "comp", "base", "cid", "alow", "ahgh", "dlow", "dhgh", "mix", "cov").collect()))
        assert len(want) > 20 and {r[2] for r in want} == {False, True} and any(r[0] == r[1] for r in want)
        mixed |= {r[9] for r in want}
        for size in (1 << 20, 200):
            monkeypatch.setattr(dealing, "RANGE_ROWS", size)
            monkeypatch.setattr(S, "STRETCH", size // 3)
            found = S.short_chains(made, longest)
            assert sorted(map(tuple, found.collect())) == want
    assert mixed == {1, 3}
    # k-mers and seeds are shuffled, and nothing else is; no Python but what makes, deals and scans them
    held = plan(S.short_chains(made, 400))
    assert held.count("REPARTITION_BY_NUM") == 2 and "Window" not in held and "Aggregate" not in held
    assert S.short_chains(S.packed(contigs.where("false")), 0).count() == 0
    assert not any(tmp_path.iterdir())


def test_gaps_and_many_chains_of_a_group(spark, monkeypatch):
    """Chains far apart in one band, each broken from the one before by a gap."""
    rng = np.random.default_rng(3)
    text = lambda n: "".join(map(str, rng.integers(0, 4, n)))
    parts = [text(150) for _ in range(4)]
    long_ = lambda: "".join(p + text(2500) for p in parts)
    contigs = spark.createDataFrame([(k, long_()) for k in range(3)], "ctg long, seq string").cache()
    want = sorted(map(tuple, S.chains(S.banded(S.chain_seeds(S.packed(contigs)), 11000), block=None).select("ctg_a", "ctg_b", "comp", "base", "cid", "alow", "ahgh", "dlow", "dhgh", "mix", "cov").collect()))
    assert sorted(map(tuple, S.short_chains(S.packed(contigs), 11000).collect())) == want and max(r[4] for r in want) >= 4


def test_pairs_and_contigs_are_counted_where_seeds_meet(spark, monkeypatch):
    monkeypatch.setattr(dealing, "BATCH_ROWS", 500)
    contigs = more_contigs(spark).cache()
    made = S.packed(contigs)
    seeds = [tuple(r) for r in S.seeds(S.packed_records(contigs)).collect()]
    n, total, strand, partners = Counter(), Counter(), Counter(), defaultdict(set)
    for a, _, b, _, comp, plen in seeds:
        n[a, b, comp] += 1
        total[a, b, comp] += plen
        strand[a, comp] += 1
        partners[a].add(b)
    for size in (1 << 20, 200):
        monkeypatch.setattr(dealing, "RANGE_ROWS", size)
        monkeypatch.setattr(S, "STRETCH", size // 3)
        pairs = S.pair_counts(made)
        assert sorted(map(tuple, pairs.drop("first").collect())) == sorted((*k, n[k], total[k]) for k in n)
        assert sorted(map(tuple, S.contig_counts(made).collect())) == sorted((a, strand[a, False], strand[a, True], len(b)) for a, b in partners.items())
    # a seed passes Python once only between the two shuffles
    assert plan(pairs).count("MapInArrow") == 3 + plan(made.frame).count("MapInArrow")


def test_frequent_kmers_are_few_where_they_are_dealt(spark, monkeypatch):
    """Copies in 40 contigs make no seeds; of each k-mer a batch deals FREQ rows, and others see the same."""
    rng = np.random.default_rng(5)
    text = lambda n: "".join(map(str, rng.integers(0, 4, n)))
    common, near = text(300), None
    near = common[:100] + text(200)
    contigs = spark.createDataFrame([*((k, common) for k in range(40)), *((100 + k, near) for k in range(3)), *((200 + k, text(20) + near[:130]) for k in range(4))], "ctg long, seq string").coalesce(1).cache()
    recs = S.packed_records(contigs)
    sent = [np.array(c) for c in zip(*sorted((r.hi, r.lo, r.ctg) for r in recs.collect()), strict=True)]
    kept = S._few(sent)
    assert len(kept[0]) < len(sent[0]) / 2 and max(Counter(zip(kept[0].tolist(), kept[1].tolist(), strict=True)).values()) == S.FREQ
    few = sorted(map(tuple, S.seeds(recs).collect()))
    monkeypatch.setattr(S, "_few", lambda cols: cols)
    assert few == sorted(map(tuple, S.seeds(recs).collect())) and few


def test_earlier_partners_meet_in_ranges_of_the_later(spark, monkeypatch):
    monkeypatch.setattr(dealing, "BATCH_ROWS", 500)
    order = {r.ctg: k for k, r in enumerate(more_contigs(spark).orderBy(F.length("seq").desc(), "ctg").select("ctg").collect())}
    numbers = spark.createDataFrame(list(order.items()), "ctg long, nth long")
    contigs = spark.createDataFrame(more_contigs(spark).join(numbers, "ctg").select(F.col("nth").alias("ctg"), "seq").collect())
    lengths = contigs.select("ctg", F.length("seq").alias("length"))
    size = dict(lengths.collect())
    earlier = defaultdict(set)
    for a, _, b, *_ in S.seeds(S.packed_records(contigs)).collect():
        if b < a:
            earlier[a].add(b)
    want = sorted((x, y, k, size[x]) for x in earlier for k, y in enumerate(sorted(earlier[x], reverse=True)))
    one_way = {(x, y) for x in earlier for y in earlier[x]}
    assert len(want) > 50 and len(size) > len(earlier)
    assert any((a, b) not in one_way for b, _, a, *_ in S.seeds(S.packed_records(contigs)).collect() if b < a)  # seeds of the earlier alone
    for rows in (1 << 20, 200):
        monkeypatch.setattr(dealing, "RANGE_ROWS", rows)
        monkeypatch.setattr(S, "STRETCH", rows // 3)
        found = S.earlier_partners(S.packed(contigs), lengths)
        assert sorted(map(tuple, found.collect())) == want
    held = plan(S.earlier_partners(S.packed(contigs), lengths))
    assert "Join" not in held and "Window" not in held  # pairs are shuffled once


def test_prefixes_and_boundaries_are_counted_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(dealing, "BATCH_ROWS", 500)
    contigs = more_contigs(spark).cache()
    table = S.kmer_table(S.packed_records(contigs)).collect()
    n, total, kinds = Counter(), Counter(), Counter()
    for r in table:
        n[r.plen] += 1
        total[r.plen] += r.lcp
        kinds[int(r.lcp < 40), r.strand] += 1
    assert len(n) > 5 and n[40] > 40 and n[0]
    for size in (1 << 20, 200, 40):
        monkeypatch.setattr(dealing, "RANGE_ROWS", size)
        monkeypatch.setattr(S, "STRETCH", size // 3)
        assert sorted(map(tuple, S.plen_counts(S.packed(contigs)).collect())) == sorted((k, n[k], total[k]) for k in n)
        assert sorted(map(tuple, S.boundary_counts(S.packed(contigs)).collect())) == sorted((*k, v) for k, v in kinds.items())
    # no row of a k-mer passes Spark: what makes records deals them out, and what puts them in order counts them
    assert plan(S.plen_counts(S.packed(contigs))).count("MapInArrow") == 2 + plan(S.packed(contigs).frame).count("MapInArrow")


def test_every_kmer_of_the_order(spark, monkeypatch):
    monkeypatch.setattr(dealing, "BATCH_ROWS", 500)
    contigs = more_contigs(spark).cache()
    many = Counter((r.hi, r.lo) for r in S.packed_records(contigs).collect())
    rows = [(k, *x, many[x]) for k, x in enumerate(sorted(many), 1)]
    for size, stretch in ((1 << 20, 1 << 17), (300, 100), (40, 7)):
        monkeypatch.setattr(dealing, "RANGE_ROWS", size)
        monkeypatch.setattr(K, "STRETCH", stretch)
        for step in (1, 7, 1000):
            found = K.every_kmer(S.packed(contigs), step)
            assert sorted(map(tuple, found.collect())) == rows[::step]
    assert len(rows) > 2000


def test_profiles_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(dealing, "BATCH_ROWS", 500)
    contigs = more_contigs(spark).cache()
    want = sorted(map(tuple, K.count_profiles(S.packed_records(contigs)).collect()))
    assert len(want) > 60 and max(r[1] for r in want) > 3 and max(r[2] for r in want) > 40
    for size in (1 << 20, 600, 40):  # in ranges of 40 rows some k-mers fill more than one
        monkeypatch.setattr(dealing, "RANGE_ROWS", size)
        monkeypatch.setattr(K, "STRETCH", size // 3)
        assert sorted(map(tuple, K.profile_runs(S.packed(contigs)).collect())) == want
    monkeypatch.setattr(dealing, "RANGE_ROWS", 1 << 20)
    held = plan(K.profile_runs(S.packed(contigs)))
    assert held.count("REPARTITION_BY_NUM") == 2 and "Window" not in held and "Aggregate" not in held


def test_next_kmers_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(dealing, "BATCH_ROWS", 500)
    contigs = more_contigs(spark).cache()
    recs = S.packed_records(contigs)
    rows = recs.collect()
    have = sorted({(r.hi, r.lo) for r in rows})
    asked = [(hi, lo, 5) for hi, lo in have[::97]]  # as they are, before or beyond others, and with prefixes that none has
    asked += [(hi, max(0, lo - 1), 6) for hi, lo in have[::31]] + [(hi, lo + 1, 7) for hi, lo in have[::17]] + [(hi | 0xFFFF, lo, 8) for hi, lo in have[::41]] + [(k << 30, 3, 9) for k in range(200)]
    want = []
    for hi, lo, ctg in asked:
        k = bisect.bisect_left(have, (hi, lo))
        held = have[k] if k < len(have) and have[k][0] >> 16 == hi >> 16 else (None, None)
        want.append((ctg, hi, lo, *held))
    missing = sum(r[3] is None for r in want)
    assert 50 < missing < len(want) - 50
    key = lambda r: tuple(-1 if x is None else x for x in r)
    table = spark.createDataFrame(asked, "hi long, lo long, ctg long")
    for size in (1 << 20, 200, 20):
        monkeypatch.setattr(dealing, "RANGE_ROWS", size)
        assert sorted(map(tuple, K.next_in_records(table, S.packed(contigs)).collect()), key=key) == sorted(want, key=key)
    assert "Window" not in plan(K.next_in_records(table, S.packed(contigs)))  # which takes a prefix to one task
    assert K.next_in_records(table.where("false"), S.packed(contigs)).count() == 0
    old = K.next_kmers(table, K.kmer_counts(recs))
    assert sorted((tuple(r) for r in old.select("ctg", "hi", "lo", "next_hi", "next_lo").collect()), key=key) == sorted(want, key=key)
    assert "unboundedfollowing" not in plan(old).lower().replace("$", "").replace("()", "")  # quadratic in a prefix


def test_files_are_read_in_small_tasks(spark, tmp_path, monkeypatch):
    rows = [(k, "ab c" * (20 + k), f"s {k % 3}") for k in range(60)]
    path = f"{tmp_path}/a b"
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.partitionBy("source").parquet(f"{path}/documents.parquet")
    want = sequences.sequences_from_documents(spark, path)
    assert "Union" not in plan(want)
    monkeypatch.setattr(sequences, "TASK_BYTES", 500)
    found = sequences.sequences_from_documents(spark, path)
    assert plan(found).count("Scan parquet") > 2 and "Exchange" not in plan(found)
    assert found.schema == want.schema and sorted(found.collect()) == sorted(want.collect()) and found.count() == 60
    assert {r.scaf for r in found.collect()} == {"s 0", "s 1", "s 2"}
