"""Windows and tiles of sequences; waves and alignments against plain loops and full tables of edit distances."""

import random

import numpy as np
import pytest

from braidwork.operators import alignment, seeding, tiles, waves
from braidwork.sources import fasta


def digits(rng, n, weights=(1, 1, 1, 1)):
    return rng.choices(range(4), weights, k=n)


def worn(rng, a, rate):
    return [x if rng.random() > rate else rng.randrange(4) for x in a if rng.random() > rate / 3]


def test_windows_hold_each_place_once(spark):
    rows = [(1, "0123" * 9), (2, "01"), (3, ""), (4, None), (5, "3" * 10), (6, "2" * 11)]
    contigs = spark.createDataFrame([(*r, 0) for r in rows], "ctg long, seq string, start int")
    got = tiles.windows(contigs, 10, before=3, after=4).collect()
    for ctg, seq in rows:
        mine = sorted((r for r in got if r.ctg == ctg), key=lambda r: r.start)
        assert "".join(r.seq[r.lead : r.lead + r.own] for r in mine) == (seq or "")
        for r in mine:
            assert r.seq == seq[max(0, r.start - 3) : r.start + r.own + 4] and r.lead == min(3, r.start)


@pytest.mark.parametrize("width", [1, 7, 40, 333, 5000])
def test_syncmers_and_kmers_do_not_depend_on_windows(spark, width):
    rng = random.Random(width)
    seqs = ["".join(map(str, digits(rng, n))) for n in (11, 12, 39, 40, 41, 52, 700, 900 if width > 1 else 100)] + ["0" * 300, "01" * 200]
    contigs = spark.createDataFrame(list(enumerate(seqs)), "ctg long, seq string")
    for made in (seeding.syncmers, seeding.records, seeding.packed_records):
        whole = made(contigs, width=10**6).collect()
        assert len(whole) and sorted(made(contigs, width=width).collect()) == sorted(whole)


def test_ranges_read_the_tiles_they_touch(spark):
    rng = random.Random(2)
    seqs = ["".join(map(str, digits(rng, n))) for n in (95, 100, 7)]
    tiled = tiles.tiles(spark.createDataFrame(list(enumerate(seqs)), "ctg long, seq string"), 10)
    asked = spark.createDataFrame([(1, 0, 12, 31), (1, 0, -50, 9), (1, 0, 28, 32), (2, 1, 90, 400), (3, 2, 3, 3), (4, 9, 0, 5)], "q long, ctg long, beg long, end long")
    from pyspark.sql import functions as F

    got = tiles.read_ranges(asked, tiled, 10, ["q"], F.col("beg"), F.col("end")).collect()
    assert sorted((r.q, r.tile) for r in got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 9), (3, 0)]
    assert all(r.seq == seqs[r.ctg][10 * r.tile : 10 * r.tile + 10] for r in got)
    parts = tiles.Parts([(r.tile, r.seq) for r in got if r.q == 1], 10, 95)
    start, held, before, beyond = parts.around(12, 40)
    assert (start, before, beyond) == (0, False, True) and "".join(map(chr, held)) == seqs[0][:40] and parts.around(12, 41) is None
    turned = tiles.Parts([(9, seqs[0][90:])], 10, 95, turned=True).around(0, 5)
    assert turned[0] == 0 and turned[2:] == (False, True) and "".join(map(chr, turned[1])) == seqs[0][90:][::-1].translate(str.maketrans("0123", "3210"))


def plain_wave(a, b, low, high, anti, spec, floor, ceiling):
    """The rule of waves.grow in loops over a dictionary: the tip and its differences."""
    state, best, good = {}, anti, anti
    for k in range(low, high + 1):
        i = (anti + k) // 2
        if 0 <= i <= len(a) and 0 <= i - k <= len(b):
            state[k] = (i, [1] * 60)
    if not state:
        return None
    k = max(state)
    tip, d = ((anti + k) // 2, k, 0), 0
    at0 = dict(state)
    while True:
        for k in list(state):
            i, bits = state[k]
            while i < len(a) and i - k < len(b) and a[i] == b[i - k]:
                i, bits = i + 1, bits[1:] + [1]
            state[k] = (i, bits)
        done = False
        for k in sorted(state, reverse=True):
            i, bits = state[k]
            if 2 * i - k > best:
                best, done = 2 * i - k, i >= len(a) or i - k >= len(b)
                if sum(bits) >= spec.least:
                    good, total, fine = best, 0, True
                    for x in bits[: 60 - 31 : -1]:
                        total += spec.gain if x else -spec.loss
                        fine &= total >= 0
                    if fine:
                        tip = (i, k, d)
        if done:
            break
        over, under = [k for k, (i, _) in state.items() if i >= len(a)], [k for k, (i, _) in state.items() if i - k >= len(b)]
        state = {k: v for k, v in state.items() if (not over or k < min(over)) and (not under or k > max(under))}
        fit = [k for k, (i, _) in state.items() if 2 * i - k >= best - 70]
        if not fit or good < best - 250:
            break
        state = {k: v for k, v in state.items() if min(fit) <= k <= max(fit)}
        grown = {}
        for k in range(min(fit) - 1, max(fit) + 2):
            if k in (min(fit) - 1, max(fit) + 1) and ((floor is not None and k < floor) or (ceiling is not None and k > ceiling)):
                continue
            steps = [(2 * state[w][0] - w + n, -m, w) for m, (w, n) in enumerate([(k, 2), (k - 1, 1), (k + 1, 1)]) if w in state]
            steps = [s for s in steps if (s[0] + k) // 2 <= len(a) and (s[0] - k) // 2 <= len(b)]
            if steps:
                c, _, w = max(steps)
                grown[k] = ((c + k) // 2, state[w][1][1:] + [0])
        state, d = grown, d + 1
        if not state:
            break
    i, k, d = tip
    if d == 0:
        i = at0[k][0]
        while i < len(a) and i - k < len(b) and a[i] == b[i - k]:
            i += 1
    return i, i - k, d


@pytest.mark.parametrize("weights", [(1, 1, 1, 1), (8, 1, 1, 8), (1, 9, 9, 1)])
def test_waves_follow_the_rule(weights):
    rng = random.Random(sum(weights))
    share = tuple(w / sum(weights) for w in weights)
    for _ in range(60):
        spec = waves.wave_spec(rng.choice([0.7, 0.85]), share)
        core = digits(rng, rng.randrange(1, 300), weights)
        a = core + digits(rng, rng.randrange(0, 200), weights)
        b = worn(rng, core, rng.choice([0, 0.1, 0.2])) + digits(rng, rng.randrange(0, 200), weights)
        low, width, anti = rng.randrange(-6, 2), rng.randrange(0, 9), rng.randrange(0, 40)
        floor, ceiling = (low - rng.randrange(5), low + width + rng.randrange(5)) if rng.random() < 0.5 else (None, None)
        got = waves.grow(np.array(a, np.uint8), np.array(b, np.uint8), low, low + width, anti, spec, floor=floor, ceiling=ceiling)
        want = plain_wave(a, b, low, low + width, anti, spec, floor, ceiling)
        assert (None if got is None else (got.i, got.j, got.diffs)) == want
        if got is not None and floor is not None:
            assert got.diagonals.min() >= min(floor, low) and got.diagonals.max() <= max(ceiling, low + width)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j - 1] + (x != y), prev[j] + 1, row[-1] + 1))
    return row[-1]


def test_uneven_bases_ask_for_more(spark):
    even, uneven = waves.wave_spec(0.7), waves.wave_spec(0.7, (0.05, 0.45, 0.45, 0.05))
    assert uneven.least > even.least and uneven.loss > even.loss and waves.wave_spec(0.7, (0, 0, 0, 0)) == even
    contigs = spark.createDataFrame([(1, "0011222333"), (2, "33")], "ctg long, seq string")
    assert alignment.base_shares(contigs) == (2 / 12, 2 / 12, 3 / 12, 5 / 12)


def test_local_alignments_end_where_likeness_does_and_traces_add_up():
    rng = random.Random(6)
    spec = waves.wave_spec(0.7)
    for n in range(25):
        core = digits(rng, rng.randrange(250, 500))
        other = worn(rng, core, 0.06)
        head = [digits(rng, rng.randrange(0, 200)) for _ in "ab"]
        a, b = (np.array(h + c + digits(rng, 150), np.uint8) for h, c in zip(head, (core, other), strict=True))
        k, anti = len(head[0]) - len(head[1]), len(head[0]) + len(head[1]) + 150
        found = waves.local_alignment(a, b, k - 10, k + 10, anti, spec)
        assert abs(found.first - len(head[0])) < 30 and abs(found.end - len(head[0]) - len(core)) < 30
        y, done = found.at(np.arange(found.first, found.end + 1))
        assert (np.diff(y) >= 0).all() and (np.diff(done) >= 0).all() and (y[0], y[-1], done[0], done[-1]) == (found.low, found.high, 0, found.diffs)
        step = 40
        for s in range(0, found.end - found.first - step, step):  # a stretch never takes fewer differences than it must
            p = slice(found.first + s, found.first + s + step)
            assert edits(a[p].tolist(), b[y[s] : y[s + step]].tolist()) <= done[s + step] - done[s] + 1
        cut = found.end - 60  # what lies beyond is not read
        with pytest.raises(waves.Beyond):
            waves.local_alignment(a[:cut], b, k - 10, k + 10, anti, spec, open_ends=(False, False, True, False))


def test_a_start_beside_the_path_grows_from_the_other_tip():
    rng = random.Random(11)
    core = digits(rng, 400)
    a, b = (np.array(digits(rng, 100) + core + digits(rng, 100), np.uint8) for _ in "ab")
    found = waves.local_alignment(a, b, 0, 0, 200, waves.wave_spec(0.7))  # the repeat's very begin
    assert abs(found.first - 100) < 25 and abs(found.end - 500) < 25
    assert waves.local_alignment(a, b, 60, 63, 500, waves.wave_spec(0.7)) is None
    assert waves.local_alignment(a, b, 5000, 5001, 100, waves.wave_spec(0.7)) is None


@pytest.mark.parametrize("tile", [64, 500, 10**6])
def test_alignments_do_not_depend_on_tiles(spark, tile):
    rng = random.Random(1)
    text = lambda x: "".join(map(str, x))
    shared, twice = digits(rng, 2500), digits(rng, 700)
    turned = [3 - x for x in worn(rng, shared, 0.04)[::-1]]
    seqs = [digits(rng, 300) + shared + digits(rng, 200), digits(rng, 900) + turned, worn(rng, shared[300:2100], 0.08) + digits(rng, 1500), digits(rng, 500) + twice + digits(rng, 300) + worn(rng, twice, 0.03)]
    contigs = spark.createDataFrame([(k, text(s)) for k, s in enumerate(seqs)], "ctg long, seq string")
    longest = max(map(len, seqs))
    chains = seeding.chains(seeding.banded(seeding.seeds(seeding.packed_records(contigs)), longest))
    got = sorted(map(str, alignment.align_chains(chains, contigs, longest, tile=tile).collect()))
    assert got == sorted(map(str, alignment.align_chains(chains, contigs, longest).collect()))
    made = alignment.drop_redundant(alignment.fuse_paths(alignment.align_chains(chains, contigs, longest, tile=tile)))
    assert alignment.trace_faults(made).count() == 0
    assert {(r.ctg_a, r.ctg_b, r.comp) for r in made.collect()} == {(0, 1, True), (0, 2, False), (1, 2, True), (3, 3, False)}
    own = made.where("ctg_a = ctg_b").collect()
    assert len(own) == 1 and abs(own[0].abpos - 500) < 25 and abs(own[0].bbpos - 1500) < 25


def test_fasta_is_read_by_lines_in_tiles(spark, tmp_path):
    rng = random.Random(8)
    for k in range(2):
        with open(tmp_path / f"{k}.fa", "w") as f:
            f.write("no record\n")
            for r in range(4):
                f.write(f">  rec{k}{r} x\r\n" if r % 2 else f">rec{k}{r} x\n")
                for _ in range(rng.choice([0, 1, 400])):
                    f.write("".join(rng.choice("ACGTN") for _ in range(rng.randrange(70))) + rng.choice(["\n", "\r\n", "\n\n"]))
    want = {r.name: r.bases for r in fasta.read_scaffolds(spark, str(tmp_path / "*.fa")).collect() if r.name.startswith("rec")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
    try:
        got = fasta.read_tiles(spark, str(tmp_path), 50).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    made = {}
    for r in sorted(got, key=lambda r: (r.name, r.tile)):
        made[r.name] = made.get(r.name, "") + r.bases
    assert made == {k: v for k, v in want.items() if v} and len(made) > 3
    assert all(len(r.bases) == 50 or r.tile == len(made[r.name]) // 50 for r in got)
