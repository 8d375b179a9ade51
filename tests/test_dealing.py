"""Ranges of k-mers dealt as packed blocks: the rows of plain loops, nothing stored on the way."""

import os
import random
from collections import Counter

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import functions as F

from braidwork.functions.bases import encode, reverse_complement
from braidwork.operators import dealing, kmers
from braidwork.operators import seeding as S
from braidwork.plans import ranges
from braidwork.sources import sequences


def contigs_of(spark):
    """Contigs with copies, and a stretch so frequent that its prefix is many ranges."""
    rng = random.Random(4)
    made = ["".join(rng.choice("0123") for _ in range(400)) for _ in range(3)]
    made += [made[0][100:300], made[1]] + [made[2][:60] + "".join(rng.choice("0123") for _ in range(60)) for _ in range(40)]
    return spark.createDataFrame([(7 * k - 20, s) for k, s in enumerate(made)], "ctg long, seq string")


def neighbours(recs):
    """Rows in order with prefixes shared with the row before and the longest with either side; seeds by all pairs of near rows."""
    rows = sorted((f"{r.hi:040b}{r.lo:040b}", r.ctg, r.place) for r in recs.collect())
    both = lambda a, b: len(os.path.commonprefix([a[0], b[0]])) // 2
    lcp = [0] + [n if (n := both(a, b)) >= 12 else 0 for a, b in zip(rows, rows[1:], strict=False)] + [0]
    plen = [max(x) for x in zip(lcp, lcp[1:], strict=False)]
    seeds = []
    for k, row in enumerate(rows):
        near = [x for j in range(max(0, k - 9), min(len(rows), k + 10)) if j != k and both(row, x := rows[j]) >= plen[k]]
        if plen[k] >= 12 and len(near) + 1 < 10:
            seeds += [(row[1], row[2] >> 1, x[1], x[2] >> 1, bool((row[2] ^ x[2]) & 1), plen[k]) for x in near]
    table = [(ctg, place >> 1, place & 1, lcp[k], plen[k]) for k, (_, ctg, place) in enumerate(rows)]
    return table, seeds


def test_ranges_of_kmers_see_their_neighbours(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("braidwork.store.shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(dealing, "BATCH_ROWS", 500)
    recs = S.packed_records(contigs_of(spark)).cache()
    table, seeds = neighbours(recs)
    assert len(seeds) > 500
    for size in (1 << 20, 300, 40):
        monkeypatch.setattr(dealing, "RANGE_ROWS", size)
        monkeypatch.setattr(S, "STRETCH", size // 3)
        got = S.kmer_table(recs)
        assert got.rdd.getNumPartitions() > len(table) // (2 * size)
        assert sorted(map(tuple, got.select("ctg", "pos", "strand", "lcp", "plen").collect())) == sorted(table)
        assert sorted(map(tuple, S.seeds(recs).collect())) == sorted(seeds)
    assert not any(tmp_path.iterdir())


def test_counts_of_kmers_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(dealing, "BATCH_ROWS", 500)
    monkeypatch.setattr(dealing, "RANGE_ROWS", 20)
    monkeypatch.setattr(kmers, "STRETCH", 7)
    recs = S.packed_records(contigs_of(spark)).cache()
    rows = recs.collect()
    many = Counter((r.hi, r.lo) for r in rows)
    assert max(many.values()) > 40  # cut into ranges of 20 rows, so some k-mers fill more than one
    counts = kmers.kmer_counts(recs)
    assert {(r.hi, r.lo): r.n for r in counts.collect()} == many and counts.count() == len(many)
    assert [tuple(r) for r in kmers.numbered_kmers(recs).orderBy("rn").collect()] == [(k, *x, many[x]) for k, x in enumerate(sorted(many), 1)]
    assert sorted(map(tuple, kmers.place_counts(recs).collect())) == sorted((r.ctg, r.place, many[r.hi, r.lo]) for r in rows)
    text = lambda hi, lo: "".join(str(x >> 2 * (19 - k) & 3) for x in (hi, lo) for k in range(20))
    least = Counter(min(k := text(r.hi, r.lo), "".join("3210"[int(c)] for c in k[::-1])) for r in rows)
    assert Counter(text(r.hi, r.lo) for r in kmers.canonical(recs).collect()) == least
    asked = recs.where("ctg = -20").limit(9)
    some = {(r.hi, r.lo) for r in asked.collect()}
    near = kmers.sharing_prefix(recs, asked)
    assert sorted(near.collect()) == sorted(r for r in rows if r.hi >> 16 in {hi >> 16 for hi, _ in some})
    assert sorted(kmers.next_kmers(asked, kmers.kmer_counts(near)).collect()) == sorted(kmers.next_kmers(asked, counts).collect())


def test_texts_are_encoded_in_pieces(spark, monkeypatch):
    held = []
    rng = random.Random(2)
    texts = [(k, "s", None if k % 9 == 3 else "".join(rng.choice("abcxyz é\n") for _ in range(rng.choice([0, 50, 700])))) for k in range(200)]
    batch = pa.record_batch([pa.array(c) for c in zip(*texts, strict=True)], ["ctg", "scaf", "text"])
    for size in (100, 1000, 1 << 20):
        monkeypatch.setattr(sequences, "PIECE_BYTES", size)
        out = list(sequences.digits_of_texts([batch.slice(0, 50), batch.slice(50)], 40))
        rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
        held.append(rows)
        assert all(len(b) == 1 or pa.compute.sum(pa.compute.binary_length(b.column(2))).as_py() <= size for b in out if len(b))
    said = spark.createDataFrame(texts, "ctg long, scaf string, text string")
    want = said.select("ctg", "scaf", encode(F.coalesce("text", F.lit(""))).alias("seq")).where("length(seq) >= 40")
    assert sorted(held[0]) == sorted(held[1]) == sorted(map(tuple, want.collect()))
    assert len(held[0]) > 50


def test_sizes_are_counted_once_and_without_python(spark, tmp_path):
    rng = random.Random(3)
    texts = ["a" * 39, "a" * 40, "É" + "aB" * 20, "\u212a" * 40, "\u0130" * 40, "a\nb " * 20, "é" * 90, "", None, *("".join(rng.choice("abXYZ éß\n1") for _ in range(n)) for n in (50, 80, 3000))]
    rows = [(k, t, s) for k, (t, s) in enumerate((t, s) for t in texts for s in ("one", "two", "", None))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sizes = sequences.sizes_from_documents(spark, str(tmp_path))
    want = sequences.sequences_from_documents(spark, str(tmp_path)).select("ctg", "scaf", F.length("seq").cast("long").alias("n"))
    assert sizes.schema == want.schema
    key = lambda r: r.ctg
    assert sorted(sizes.collect(), key=key) == sorted(want.collect(), key=key) and 20 <= sizes.count() < len(rows)
    total = Counter()
    for r in want.where("scaf is not null").collect():
        total[r.scaf] += r.n
    pairs = ranges.pair_weights(spark, str(tmp_path))
    order = sorted((-total[i] * total[j], i, j) for i in total for j in total if i <= j)
    assert [tuple(r) for r in pairs.orderBy("nth").collect()] == [(i, j, -w, k) for k, (w, i, j) in enumerate(order, 1)]
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan(pairs) and "InArrow" not in plan(pairs) and "InArrow" in plan(want)
    assert plan(sizes).count("regexp_replace(") == 1


def test_pairs_of_contigs_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(dealing, "RANGE_ROWS", 200)
    monkeypatch.setattr(S, "STRETCH", 50)
    recs = S.packed_records(contigs_of(spark)).cache()
    seeds = [tuple(r) for r in S.seeds(recs).collect()]
    n, cover = Counter(), Counter()
    for a, _, b, _, comp, plen in seeds:
        n[a, b, comp] += 1
        cover[a, b, comp] += plen
    pairs = S.pair_counts(recs).collect()
    assert sorted((r.ctg_a, r.ctg_b, r.comp, r.n_seeds, r.sum_plen) for r in pairs) == sorted((*k, n[k], cover[k]) for k in n)
    assert Counter((r.ctg_a, r.ctg_b) for r in pairs if r["first"]) == Counter({(a, b) for a, b, _ in n})
    want = [r for r in seeds if 2 * cover[r[0], r[2], r[4]] >= 170]
    assert sorted(map(tuple, S.chain_seeds(recs).collect())) == sorted(want) and 0 < len(want) < len(seeds)


def test_bands_of_pairs_in_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("braidwork.store.shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(dealing, "BATCH_ROWS", 500)
    contigs = contigs_of(spark)
    turned = contigs.where("ctg < 0").select(F.col("ctg") + 1000, reverse_complement(F.col("seq")))
    twice = contigs.where("ctg = -13").selectExpr("ctg + 2000", "repeat(substr(seq, 1, 150), 2)")
    recs = S.packed_records(contigs.unionAll(turned).unionAll(twice)).cache()
    for longest in (400, 437):  # bands of a with b and of b with a are cut alike in one, and not in the other
        bands = Counter(tuple(r) for r in S.banded(S.seeds(recs), longest).select("ctg_a", "ctg_b", "comp", "band").collect())
        pairs = {k[:3]: [n for q, n in bands.items() if q[:3] == k[:3]] for k in bands}
        want = sorted((*k, sum(n), len(n), max(n)) for k, n in pairs.items())
        assert any(a == b for a, b, _ in pairs) and any(comp for *_, comp in pairs) and max(w[4] for w in want) > 1
        assert any(sum(n) != sum(pairs.get((b, a, comp), [])) for (a, b, comp), n in pairs.items())  # seeds of a with b alone
        for size in (1 << 20, 200, 40):
            monkeypatch.setattr(dealing, "RANGE_ROWS", size)
            monkeypatch.setattr(S, "STRETCH", size // 3)
            got = S.band_counts(recs, longest)
            assert sorted(map(tuple, got.collect())) == want
            assert size > 1000 or got.rdd.getNumPartitions() > 10
    assert not any(tmp_path.iterdir())


def test_seeds_outside_masks_in_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("braidwork.store.shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(dealing, "BATCH_ROWS", 500)
    contigs = contigs_of(spark).cache()
    rng, made = random.Random(8), []
    for ctg, seq in contigs.collect():  # masks that touch, that go beyond the end, and none
        cuts = sorted(rng.sample(range(0, len(seq) + 60, 5), 6))
        made += [] if ctg % 3 == 0 else [(ctg, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if k != ctg % 5]
    masks = spark.createDataFrame(made, "ctg long, beg int, end int")
    ahead = lambda c, p: max([0, *(min(40, b - p) for x, a, b in made if x == c and a <= p < b)])
    for width in (70, 1 << 20):
        recs = S.packed_records(contigs, width=width, masks=masks)
        assert sorted(map(tuple, recs.drop("mask").collect())) == sorted(map(tuple, S.packed_records(contigs).collect()))
        assert all(r["mask"] == ahead(r.ctg, r.place >> 1) for r in recs.collect())
    said = S.seeds(S.packed_records(contigs)).collect()
    n, total = Counter(), Counter()
    for a, i, b, j, comp, plen in said:
        if ahead(a, i) < plen and ahead(b, j) < plen:
            n[a, comp] += 1
            total[a, comp] += plen
    assert 0 < sum(n.values()) < len(said)
    for size in (1 << 20, 200):
        monkeypatch.setattr(dealing, "RANGE_ROWS", size)
        monkeypatch.setattr(S, "STRETCH", size // 3)
        assert sorted(map(tuple, S.unmasked_counts(contigs, masks).collect())) == sorted((*k, n[k], total[k]) for k in n)
    assert not any(tmp_path.iterdir())
