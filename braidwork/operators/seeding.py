"""Syncmer sampling, the k-mer table, adaptive seeds, and chains of seeds.

k-mers are packed into two longs, hi and lo, of 20 bases each, so that they compare as numbers, and a record's
position and strand into place = 2 * pos + strand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import BAND_BITS, CHAIN_BREAK, CHAIN_MIN, FREQ, KMER, SMER, TMER, WINDOW, rank4, shared_symbols
from ..store import stored
from .dealing import Made, blocks_of, cuts_of, dealt, drawn, gathered, in_order, in_ranges, lower_bounds, made_of, new_at, ranged, summed
from .order import Scan, carried_scans
from .ranges import mask_ahead
from .tiles import windows

HALF = KMER // 2  # bases of hi and of lo
BLOCK = 1 << 21  # antidiagonals of a pair of bands that one step scans
STRETCH = 1 << 17  # records in order that one step looks at
READ_WIDTH = 1 << 20  # syncmers of a window of a contig that one step looks for
_ORDER = ["hi", "lo", "ctg", "place"]


def _ranks(seq: np.ndarray, ranks: np.ndarray | None = None) -> np.ndarray:
    """Order of the 8-mer at each place of a sequence of digits, the same for its reverse complement."""
    d = seq.astype(np.int64)
    n = len(d) - 3
    code = d[:n] * 64 + d[1 : n + 1] * 16 + d[2 : n + 2] * 4 + d[3 : n + 3]
    back = (3 - d[3 : n + 3]) * 64 + (3 - d[2 : n + 2]) * 16 + (3 - d[1 : n + 1]) * 4 + (3 - d[:n])
    rank, other = (rank4(code), rank4(back)) if ranks is None else (ranks[code], ranks[back])
    return np.minimum(rank[:-4] * 256 + rank[4:], other[4:] * 256 + other[:-4])


def _selected(seq: np.ndarray, ranks: np.ndarray | None = None) -> np.ndarray:
    mz = _ranks(seq, ranks)
    ends = np.minimum(mz[: 1 - WINDOW], mz[WINDOW - 1 :])
    return np.flatnonzero(ends == np.lib.stride_tricks.sliding_window_view(mz, WINDOW).min(axis=1))


def _checked(ranks: list[int] | None) -> np.ndarray | None:
    """A table of 4-mer ranks from outside: a permutation of 0-255, by the 4-mer's code."""
    if ranks is not None and sorted(ranks) != list(range(256)):
        raise ValueError("ranks must be a permutation of 0-255")
    return None if ranks is None else np.array(ranks, np.int64)


def _with_masks(cut: DataFrame, masks: DataFrame, width: int) -> DataFrame:
    """Windows with the bounds, in order, of the masks that may hold a record's start: at a place they own, or TMER beyond."""
    low, high = F.floor((F.col("beg") - TMER) / width), F.floor((F.least(F.col("end"), F.lit(1 << 31)) - 1) / width)
    starts = F.transform(F.sequence(F.greatest(low, F.lit(0).cast("long")), high), lambda k: k * width)
    held = masks.where("beg < end and end > 0 and beg < 2147483648").select(F.col("ctg").cast("long").alias("ctg"), F.explode(starts).alias("start"), F.struct(F.col("beg").cast("long").alias("beg"), F.col("end").cast("long").alias("end")).alias("mask"))
    held = held.groupBy("ctg", "start").agg(F.sort_array(F.collect_list("mask")).alias("masks")).select("ctg", "start", "masks.beg", "masks.end")
    return cut.join(held, ["ctg", "start"], "left").select(*cut.columns, "beg", "end")


def _masked(at: np.ndarray, beg: pa.Scalar, end: pa.Scalar) -> np.ndarray:
    """How far, KMER at most, the mask that holds a place still goes, else 0."""
    if not beg.is_valid:
        return np.zeros(len(at), np.int64)
    begs, ends = (x.values.to_numpy() for x in (beg, end))
    k = np.searchsorted(begs, at, "right") - 1
    return np.where(k < 0, 0, np.clip(ends[k] - at, 0, KMER))


def _by_window(contigs: DataFrame, make, width: int, masks: DataFrame | None = None) -> Made:
    """ctg and make(digits, raw bytes, places) of each window of contigs as columns.

    places are the syncmers that the window owns, and make's first column is by place: where they begin in the contig
    is added. A window sees what a k-mer at its first and its last place needs, so cuts change nothing. Given masks,
    make also gets the bounds of those of the window.
    """

    def columns(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            for ctg, start, lead, own, seq, *bounds in zip(*batch.columns, strict=True):
                raw = np.frombuffer(seq.as_buffer(), np.uint8)
                if len(raw) < SMER + WINDOW - 1:
                    continue
                found = make(raw - 48, raw, lead.as_py(), lead.as_py() + own.as_py(), start.as_py() - lead.as_py(), *bounds)
                if len(found[0]):
                    yield [np.full(len(found[0]), ctg.as_py()), *found]

    cut = windows(contigs, width, before=KMER - TMER, after=KMER - 1)
    return Made(cut if masks is None else _with_masks(cut, masks, width), columns)


def _joined(columns: Iterator[list], *, least: int = 50_000) -> Iterator[list]:
    """Columns of a few rows as columns of many."""
    held: list[list] = []
    size = 0
    whole = lambda c: np.concatenate(c) if isinstance(c[0], np.ndarray) else pa.concat_arrays(c)
    for cols in columns:
        held.append(cols)
        size += len(cols[0])
        if size > least:
            yield [whole(c) for c in zip(*held, strict=True)]
            held, size = [], 0
    if held:
        yield [whole(c) for c in zip(*held, strict=True)]


def _frame(made: Made, schema: str) -> DataFrame:
    columns = made.columns
    return Made(made.frame, lambda batches: _joined(columns(batches))).rows(schema)


def syncmers(contigs: DataFrame, ranks: list[int] | None = None, *, width: int = READ_WIDTH) -> DataFrame:
    """(ctg, j): closed syncmers, the runs of WINDOW 8-mers whose least is the first or last.

    ranks: the order of the 256 4-mers, in place of the linear rule. width: places of a window (see ``windows``); nothing
    but the windows of longer contigs is shuffled.
    """
    given = _checked(ranks)

    def make(digits: np.ndarray, raw: np.ndarray, low: int, high: int, shift: int) -> list[np.ndarray]:
        j = _selected(digits, given)
        return [(j[(j >= low) & (j < high)] + shift).astype(np.int32)]

    return _frame(_by_window(contigs, make, width), "ctg long, j int")


def _kmers(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, KMER)[at])
    return pa.StringArray.from_buffers(len(at), pa.py_buffer((np.arange(len(at) + 1) * KMER).astype(np.int32)), pa.py_buffer(flat))


def _packed(digits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hi and lo of the k-mers at given places: doubling packs 1, 2, 4, 8 and 16 bases, and 4 more."""
    one = digits.astype(np.int64)
    run = {1: one}
    for n in (1, 2, 4, 8):
        run[2 * n] = (run[n][:-n] << (2 * n)) | run[n][n:]
    whole = (run[16][:-4] << 8) | run[4][16:]
    return whole[at], whole[at + HALF]


def _places(digits: np.ndarray, ranks: np.ndarray | None, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the forward k-mers begin, and the reverse ones' syncmers, of those from low to high that fit."""
    j, n = _selected(digits, ranks), len(digits)
    j = j[(j >= low) & (j < high)]
    return j[j <= n - KMER], j[(j >= KMER - TMER) & (j + TMER <= n)]


def records(contigs: DataFrame, ranks: list[int] | None = None, *, width: int = READ_WIDTH) -> DataFrame:
    """(ctg, pos, strand, kmer): a forward and a reverse k-mer at each syncmer, where they fit; k-mers as digits."""
    given = _checked(ranks)

    def make(digits: np.ndarray, raw: np.ndarray, low: int, high: int, shift: int) -> list:
        if len(raw) < KMER:
            return [np.zeros(0, np.int32)]
        (ahead, back), n = _places(digits, given, low, high), len(raw)
        # place p of the reverse complement is place n - 1 - p of the sequence
        turned = (3 - digits[::-1]).astype(np.uint8) + np.uint8(48)
        kmers = pa.concat_arrays([_kmers(raw, ahead), _kmers(turned, n - TMER - back)])
        pos, strand = np.concatenate([ahead, back + TMER]), np.repeat([0, 1], [len(ahead), len(back)])
        return [(pos + shift).astype(np.int32), strand.astype(np.int32), kmers]

    return _frame(_by_window(contigs, make, width), "ctg long, pos int, strand int, kmer string")


def packed(contigs: DataFrame, ranks: list[int] | None = None, *, width: int = READ_WIDTH, masks: DataFrame | None = None) -> Made:
    """hi, lo, ctg, place: the rows of records, packed, made where they are dealt out.

    Given masks (ctg, beg, end), disjoint, also mask: how far, KMER at most, the one that holds a record's start still goes, else 0.
    """
    given = _checked(ranks)

    def make(digits: np.ndarray, raw: np.ndarray, low: int, high: int, shift: int, *bounds: pa.Scalar) -> list[np.ndarray]:
        if len(raw) < KMER:
            return [np.zeros(0, np.int64)]
        ahead, back = _places(digits, given, low, high)
        forward, reverse = _packed(digits, ahead), _packed(3 - digits[::-1], len(raw) - TMER - back)
        place = np.concatenate([2 * ahead, 2 * (back + TMER) + 1]) + 2 * shift
        found = [place, *(np.concatenate(x) for x in zip(forward, reverse, strict=True))]
        return found + [_masked(place >> 1, *bounds)] if bounds else found

    return _by_window(contigs, make, width, masks).mapped(lambda ctg, place, hi, lo, *mask: [hi, lo, ctg, place, *mask])


def packed_records(contigs: DataFrame, ranks: list[int] | None = None, *, width: int = READ_WIDTH, masks: DataFrame | None = None) -> DataFrame:
    """(hi, lo, ctg, place), given masks also mask: the rows of packed."""
    schema = "hi long, lo long, ctg long, place long" + (", mask long" if masks is not None else "")
    return _frame(packed(contigs, ranks, width=width, masks=masks), schema)


def in_kmer_order(recs: Made, cuts: np.ndarray, reach: int, make: Callable[..., list[np.ndarray]], *, merge: Callable[[list[np.ndarray]], list[np.ndarray]] | None = None) -> Made:
    """make over all records (hi, lo, any others) in the order of their columns, where each row sees reach rows on either side.

    make(hi, lo, *others, use) gives columns for the rows that the mask use selects. Records are cut into ranges of whole
    rows, so neither a frequent k-mer nor a frequent prefix lands in one task, but where rows are alike: merge(columns)
    may make fewer of these in a batch. Each batch that is dealt gives a range the reach rows on either side as well,
    among which are the nearest of all; neighbours that don't share TMER bases needn't be seen, so few rows go twice.
    """

    def near(cols: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pre, shift = cuts[:, 0] >> 2 * (HALF - TMER), 2 * (HALF - TMER)
        low, high = np.searchsorted(cols[0], pre << shift), np.searchsorted(cols[0], (pre + 1) << shift)
        return np.maximum(at - reach, low), np.minimum(at + reach, high)

    def work(part: int, cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        inner = cuts[max(part - 1, 0) : part + 1]
        bounds = lower_bounds(cols, inner)
        n = len(cols[0])
        first, last = bounds[0] if part else 0, bounds[-1] if part < len(cuts) else n
        for a in range(first, last, STRETCH):
            b = min(a + STRETCH, last)
            low, high = max(0, a - reach), min(n, b + reach)
            use = np.zeros(high - low, bool)
            use[a - low : b - low] = True
            yield make(*(c[low:high] for c in cols), use)

    return ranged(dealt(recs, cuts, near=near, merge=merge), work)


def _shared(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the row before (the first: 0); under TMER it counts as none."""
    out = np.zeros(len(hi) + 1, np.int8)  # one more: nothing follows the last
    length = lambda x: np.frexp(x.astype(np.float64))[1]  # noqa: E731  bits of x, exact below 2**53
    top, low = hi[1:] ^ hi[:-1], lo[1:] ^ lo[:-1]
    out[1:-1] = np.where(top > 0, HALF - (length(top) + 1) // 2, KMER - (length(low) + 1) // 2)
    return np.where(out < TMER, 0, out)


def kmer_table(recs: DataFrame | Made) -> DataFrame:
    """(ctg, pos, strand, hi, lo, lcp, plen) of packed records: prefixes shared with the k-mer before, and the longest
    shared with either neighbour; under TMER they count as 0."""

    def make(hi, lo, ctg, place, use):
        lcp = _shared(hi, lo)
        plen = np.maximum(lcp[:-1], lcp[1:])
        return [ctg[use], (place[use] >> 1).astype(np.int32), (place[use] & 1).astype(np.int32), hi[use], lo[use], lcp[:-1][use].astype(np.int32), plen[use].astype(np.int32)]

    recs = made_of(recs, _ORDER)
    return in_kmer_order(recs, cuts_of(drawn(recs, _ORDER)), 1, make).rows("ctg long, pos int, strand int, hi long, lo long, lcp int, plen int")


def plen_counts(recs: DataFrame | Made) -> DataFrame:
    """(plen, n, sum_lcp): rows of kmer_table by plen, and their lcp in all; a k-mer is a row a batch."""
    recs = made_of(recs, _ORDER)

    def make(hi, lo, n, use):
        lcp = _shared(hi, lo)
        plen = np.where(n > 1, KMER, np.maximum(lcp[:-1], lcp[1:]))[use]
        total = (lcp[:-1] + (n - 1) * KMER)[use]
        count = lambda w: np.bincount(plen, w, KMER + 1).astype(np.int64)
        return [np.arange(KMER + 1, dtype=np.int32), count(n[use]), count(total)]

    merged = in_kmer_order(recs.mapped(lambda hi, lo, *_: [hi, lo, np.ones(len(hi), np.int64)]), cuts_of(drawn(recs, _ORDER)[:2]), 1, make, merge=summed(2))
    parts = merged.rows("plen int, n long, sum_lcp long").where("n > 0")
    return parts.groupBy("plen").agg(F.sum("n").alias("n"), F.sum("sum_lcp").alias("sum_lcp"))


def boundary_counts(recs: DataFrame | Made) -> DataFrame:
    """(boundary, strand, n): records by whether a new k-mer begins there (1) in the order of kmer_table."""
    recs = made_of(recs, _ORDER)

    def make(hi, lo, ctg, place, use):
        new = np.zeros(len(hi), np.int64)
        new[new_at([hi, lo])] = 1
        kind = (2 * new + (place & 1))[use]
        return [np.array([0, 0, 1, 1], np.int32), np.array([0, 1, 0, 1], np.int32), np.bincount(kind, minlength=4)]

    parts = in_kmer_order(recs, cuts_of(drawn(recs, _ORDER)), 1, make).rows("boundary int, strand int, n long").where("n > 0")
    return parts.groupBy("boundary", "strand").agg(F.sum("n").alias("n"))


def lcp_histogram(recs: DataFrame | Made) -> DataFrame:
    """(lcp, n): how many k-mers share how long a prefix with the one before in the order of all (the first: 0).

    Inside a prefix of TMER bases from the k-mer table; between such prefixes from the prefixes alone, first
    within their halves, then between the halves, which are 4^(TMER / 2) at most: no window spans all rows.
    """
    half = TMER // 2
    pre = F.when(F.col("lcp") < TMER, F.shiftright("hi", 2 * (HALF - TMER)))  # of the first k-mer of each prefix alone
    table = stored(kmer_table(recs).groupBy("lcp", pre.alias("pre")).agg(F.count("*").alias("n")))
    inside = table.where("pre is null").select("lcp", "n")
    heads = table.where("pre is not null").select("pre").withColumn("stem", F.shiftright("pre", 2 * half))
    within = heads.withColumn("last", F.lag("pre").over(Window.partitionBy("stem").orderBy("pre"))).where("last is not null")
    stems = heads.select("stem").distinct().withColumn("last", F.lag("stem").over(Window.orderBy("stem")))
    between = F.when(F.col("last").isNull(), 0).otherwise(shared_symbols(F.col("stem"), F.col("last"), half))
    one = F.lit(1).cast("long")
    lcps = inside.unionAll(within.select(shared_symbols(F.col("pre"), F.col("last"), TMER), one)).unionAll(stems.select(between, one))
    return lcps.groupBy("lcp").agg(F.sum("n").alias("n"))


def _links(hi: np.ndarray, lo: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """plen of rows in k-mer order; and for k = 1, 2, ... of each row i and row i + k, whether i makes a seed with the other, and the other with i."""
    lcp, n = _shared(hi, lo), len(hi)
    plen = np.maximum(lcp[:-1], lcp[1:])
    count, fits = np.zeros(n, np.int8), []
    ahead, back = np.full(n, KMER, np.int8), np.full(n, KMER, np.int8)
    for k in range(1, min(FREQ, n)):  # least common prefix on the way to the k-th row after, and before
        ahead = np.minimum(ahead[: n - k], lcp[k:n])
        back[k:] = np.minimum(back[k:], lcp[1 : n - k + 1])
        fits.append((ahead >= plen[: n - k], back[k:] >= plen[k:]))
        count[: n - k] += fits[-1][0]
        count[k:] += fits[-1][1]
    kept = use & (plen >= TMER) & (count + 1 < FREQ)
    return plen, [(after & kept[: n - k], before & kept[k:]) for k, (after, before) in enumerate(fits, 1)]


def _few(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Rows in order, FREQ at most of a k-mer: one that as many share makes no seed, and FREQ of it tell the same of others."""
    at = new_at(cols[:2])
    nth = np.arange(len(cols[0])) - np.repeat(at, np.diff(at, append=len(cols[0])))
    return cols if nth.max() < FREQ else [c[nth < FREQ] for c in cols]


def _ends(links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows a and b of all seeds."""
    a, b = [], []
    for k, (after, before) in enumerate(links, 1):
        i, j = np.flatnonzero(after), np.flatnonzero(before) + k
        a += [i, j]
        b += [i + k, j - k]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))


def seeds(recs: DataFrame | Made) -> DataFrame:
    """(ctg_a, pos_a, ctg_b, pos_b, comp, plen): occurrences (packed records) that share their longest common prefix.

    An occurrence whose prefix FREQ or more share makes none; partners stand within FREQ - 1 places
    in k-mer order, so a bounded frame replaces the join on prefixes, whatever the prefix's frequency.
    """

    def make(hi, lo, ctg, place, use):
        plen, links = _links(hi, lo, use)
        a, b = _ends(links)
        return [ctg[a], (place[a] >> 1).astype(np.int32), ctg[b], (place[b] >> 1).astype(np.int32), ((place[a] ^ place[b]) & 1).astype(bool), plen[a].astype(np.int32)]

    recs = made_of(recs, _ORDER)
    found = in_kmer_order(recs, cuts_of(drawn(recs, _ORDER)), FREQ - 1, make, merge=_few)
    return found.rows("ctg_a long, pos_a int, ctg_b long, pos_b int, comp boolean, plen int")


def _by_strand(recs: DataFrame | Made) -> Made:
    """hi, lo and 2 * ctg + strand of records: all that counts by contig need."""
    return made_of(recs, _ORDER).mapped(lambda hi, lo, ctg, place, *more: [hi, lo, ctg * 2 + (place & 1), *more])


def _strand_cuts(keys: list[np.ndarray]) -> np.ndarray:
    return cuts_of([*keys[:2], keys[2] * 2 + (keys[3] & 1)])


def _pairs_of(hi: np.ndarray, lo: np.ndarray, ctg: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows own and other, way and plen of seeds, those of a with b and of b with a as one.

    way is 1 for a seed of own with other, 2 for one of other with own, 3 for both. Own is of one and the same of two contigs.
    """
    plen, links = _links(hi, lo, use)
    x = [np.flatnonzero(after | before) for after, before in links]
    y = [i + k for k, i in enumerate(x, 1)]
    way = [after[i] + 2 * before[i] for i, (after, before) in zip(x, links, strict=True)]
    x, y, way = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (x, y, way))
    shared = np.where(way & 1, plen[x], plen[y])
    # the lesser contig's range or, where one is odd and one even, the greater's: else the first ranges get most
    other_way = (ctg[x] > ctg[y]) ^ ((ctg[x] ^ ctg[y]) & 1).astype(bool)
    own, other = np.where(other_way, y, x), np.where(other_way, x, y)
    return own, other, np.where(other_way & (way < 3), 3 - way, way).astype(np.int64), shared.astype(np.int64)


def _by_pair(make: Callable[..., list[np.ndarray]]) -> Callable[[int, list[np.ndarray]], Iterator[list[np.ndarray]]]:
    """make over rows in order, some STRETCH at once, where those with equal first two columns stay together."""

    def work(part: int, cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        at = new_at(cols[:2])
        ends = np.unique([*at[np.searchsorted(at, np.arange(0, at[-1] + 1, STRETCH))], len(cols[0])])
        for a, b in zip(ends, ends[1:], strict=False):
            yield make(*(c[a:b] for c in cols))

    return work


def _both_ways(way: np.ndarray, own: list[np.ndarray], other: list[np.ndarray], same: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of own with other and of other with own, as way says: their columns in this order, then the same ones."""
    there, here = (way & 1) > 0, (way & 2) > 0
    return [np.concatenate([p[there], q[here]]) for p, q in zip([*own, *other, *same], [*other, *own, *same], strict=True)]


def _counted_pairs(recs: DataFrame | Made, keys: list[np.ndarray]) -> Made:
    """ctg_a, ctg_b, comp, n_seeds, sum_plen, first of pairs of short contigs: see pair_counts.

    A contig has at most FREQ - 1 seeds a record, so the records' contigs say where to cut.
    """

    def make(hi, lo, side, use):
        own, other, way, plen = _pairs_of(hi, lo, side >> 1, use)
        return [side[own] >> 1, side[other] >> 1, ((side[own] ^ side[other]) & 1) * 3 + way - 1, np.ones(len(own), np.int64), plen]

    def counted(own, other, code, n, total):
        cols = _both_ways(code % 3 + 1, [own], [other], [code // 3, n, total])
        order = in_order(cols[:3])
        a, b, comp, n, total = summed(3)([c[order] for c in cols])
        first = np.zeros(len(a), bool)
        first[new_at([a, b])] = True
        return [a, b, comp.astype(bool), n, total, first]

    found = in_kmer_order(_by_strand(recs), _strand_cuts(keys), FREQ - 1, make, merge=_few)
    return ranged(dealt(found, cuts_of([keys[2]]), merge=summed(3)), _by_pair(counted))


def pair_counts(recs: DataFrame | Made) -> DataFrame:
    """(ctg_a, ctg_b, comp, n_seeds, sum_plen, first): pairs of short contigs by their seeds; first: of both comp, if there are both."""
    found = _counted_pairs(recs, drawn(recs, _ORDER))
    return found.rows("ctg_a long, ctg_b long, comp boolean, n_seeds long, sum_plen long, first boolean")


def contig_counts(recs: DataFrame | Made) -> DataFrame:
    """(ctg_a, n_same, n_opposite, partners): seeds of short contigs by strand, and how many contigs they are with."""
    keys = drawn(recs, _ORDER)
    of = lambda a, b, comp, n, total, first: [a, np.where(comp, 0, n), np.where(comp, n, 0), first.astype(np.int64)]
    found, counted = _counted_pairs(recs, keys).mapped(of), summed(1)
    return in_ranges(dealt(found, cuts_of([keys[2]]), merge=counted), "ctg_a long, n_same long, n_opposite long, partners long", lambda part, cols: iter([counted(cols)]))


def earlier_partners(recs: DataFrame | Made, lengths: DataFrame) -> DataFrame:
    """(x, y, nearness, length): contigs y before x that x has a seed with, the nearest first, from 0, and the length of x.

    Contigs are numbers from 0, lengths is (ctg, length) of them all. A pair is dealt once, to the range of x, where its length goes too.
    """
    recs = made_of(recs, _ORDER)
    keys = drawn(recs, _ORDER)

    def make(hi, lo, ctg, use):
        own, other, way, _ = _pairs_of(hi, lo, ctg, use)
        own, other = ctg[own], ctg[other]
        x, y = np.maximum(own, other), np.minimum(own, other)
        kept = np.where(own > other, way & 1, way & 2) * (x - y) > 0
        return [x[kept], y[kept], np.zeros(kept.sum(), np.int64)]

    def work(part: int, cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        x, y, length = summed(2)(cols)  # of each x the first row, with y -1, tells the length
        heads = new_at([x])
        count = np.diff(heads, append=len(x))
        nearness = np.repeat(heads + count - 1, count) - np.arange(len(x))
        length = np.repeat(length[heads], count)
        use = np.flatnonzero(y >= 0)
        for k in range(0, len(use), STRETCH):
            yield [c[use[k : k + STRETCH]] for c in (x, y, nearness.astype(np.int32), length)]

    found = in_kmer_order(recs.mapped(lambda hi, lo, ctg, place: [hi, lo, ctg]), cuts_of(keys[:3]), FREQ - 1, make, merge=_few)
    cuts = cuts_of([np.maximum(keys[2], np.random.default_rng(7).permutation(keys[2]))])
    sizes = blocks_of(lengths.select("ctg", F.lit(-1).cast("long"), F.col("length").cast("long")), cuts)
    return ranged(gathered(blocks_of(found, cuts, merge=summed(2)).unionAll(sizes), cuts), work).rows("x long, y long, nearness int, length long")


def band_counts(recs: DataFrame | Made, longest: int) -> DataFrame:
    """(ctg_a, ctg_b, comp, n_seeds, n_bands, max_band): pairs of short contigs by their seeds, the bands these lie in, and the most in one.

    Seeds of a with b and of b with a are dealt as one row, to the range of a or of b, with their band. longest: of all
    contigs, as for ``banded``.
    """
    recs = made_of(recs, _ORDER)
    keys = drawn(recs, _ORDER)

    def make(hi, lo, ctg, place, use):
        own, other, way, _ = _pairs_of(hi, lo, ctg, use)
        i, j, comp = place[own] >> 1, place[other] >> 1, (place[own] ^ place[other]) & 1
        diag = np.where(comp, 2 * longest - (i + j), longest + i - j)
        band = diag >> BAND_BITS
        odd = np.where(comp, 0, (2 * longest - diag >> BAND_BITS) - _turned_band(band))
        return [ctg[own], ctg[other], ((band * 2 + odd) * 2 + comp) * 3 + way - 1, np.ones(len(own), np.int64)]

    def _turned_band(band: np.ndarray) -> np.ndarray:
        """The lower of the two bands that seeds of a band lie in when their contigs change places."""
        return 2 * longest - (band << BAND_BITS) - ((1 << BAND_BITS) - 1) >> BAND_BITS

    def counted(own, other, code, n):
        comp, odd, band = code // 3 & 1, code // 6 & 1, code // 12
        back = np.where(comp, band, _turned_band(band) + odd)
        a, band, b, _, comp, n = _both_ways(code % 3 + 1, [own, band], [other, back], [comp, n])
        order = in_order([a, b, comp, band])
        a, b, comp, _, n = summed(4)([c[order] for c in (a, b, comp, band, n)])
        at = new_at([a, b, comp])
        return [a[at], b[at], comp[at].astype(bool), np.add.reduceat(n, at), np.diff(at, append=len(n)), np.maximum.reduceat(n, at)]

    found = in_kmer_order(recs, cuts_of(keys), FREQ - 1, make, merge=_few)
    return in_ranges(dealt(found, cuts_of([keys[2]]), merge=summed(3)), "ctg_a long, ctg_b long, comp boolean, n_seeds long, n_bands long, max_band long", _by_pair(counted))


def _covered_seeds(recs: DataFrame | Made) -> Made:
    """ctg_a, ctg_b, comp, pos_a, pos_b, plen, in order: the seeds of pairs of short contigs that cover CHAIN_MIN in all.

    A pair's come at once. Seeds of a with b and of b with a are dealt as one row.
    """
    recs = made_of(recs, _ORDER)
    keys = drawn(recs, _ORDER)

    def make(hi, lo, ctg, place, use):
        own, other, way, plen = _pairs_of(hi, lo, ctg, use)
        code = (plen * 2 + ((place[own] ^ place[other]) & 1)) * 3 + way - 1
        return [ctg[own], ctg[other], place[own] >> 1, place[other] >> 1, code]

    def covered(own, other, i, j, code):
        a, i, b, j, comp, plen = _both_ways(code % 3 + 1, [own, i], [other, j], [code // 3 & 1, code // 6])
        order = in_order([a, b, comp])
        cols = [c[order] for c in (a, b, comp, i, j, plen)]
        at = new_at(cols[:3])
        use = np.repeat(np.add.reduceat(2 * cols[5], at) >= CHAIN_MIN, np.diff(at, append=len(order)))
        return [c[use] for c in cols]

    found = in_kmer_order(recs, cuts_of(keys), FREQ - 1, make, merge=_few)
    return ranged(dealt(found, cuts_of([keys[2]])), _by_pair(covered))


def chain_seeds(recs: DataFrame | Made) -> DataFrame:
    """The seeds of pairs of short contigs that cover CHAIN_MIN in all: those that chains looks at."""
    found = _covered_seeds(recs).mapped(lambda a, b, comp, i, j, plen: [a, i.astype(np.int32), b, j.astype(np.int32), comp.astype(bool), plen.astype(np.int32)])
    return found.rows("ctg_a long, pos_a int, ctg_b long, pos_b int, comp boolean, plen int")


def short_chains(recs: DataFrame | Made, longest: int) -> DataFrame:
    """chains(banded(chain_seeds(recs), longest), block=None), in the tasks where the seeds of pairs meet."""

    def make(a, b, comp, i, j, plen):
        if not len(a):
            return [a]
        pair = np.zeros(len(a), np.int64)
        pair[new_at([a, b, comp])[1:]] = 1
        pair, w = np.cumsum(pair), 2 * plen
        diag, ad = np.where(comp, 2 * longest - (i + j), longest + i - j), np.where(comp, longest - (i - j), i + j)
        band, dg = diag >> BAND_BITS, diag & ((1 << BAND_BITS) - 1)
        at = lambda p, x: p * (2 * longest + 2 >> BAND_BITS << 1) + x + 1  # noqa: E731  one number of pair and band
        held = np.unique(at(pair, band))
        below = held[np.maximum(np.searchsorted(held, at(pair, band - 1), "right") - 1, 0)] == at(pair, band - 1)
        # a seed is one of its own band's and, where there is one below, of that one's
        row, role = np.concatenate([np.arange(len(a)), np.flatnonzero(below)]), np.repeat([1, 2], [len(a), below.sum()])
        base = band[row] + 1 - role
        group, ad, dg, w = at(pair[row], base), ad[row], dg[row] + (role - 1 << BAND_BITS), w[row]
        order = in_order([group, ad, role, dg, w])
        row, role, base, group, ad, dg, w = (c[order] for c in (row, role, base, group, ad, dg, w))
        starts = np.zeros(len(row), bool)
        starts[new_at([group])] = True
        nth, ends = np.cumsum(starts), ad + w
        far = int(ends.max()) - min(0, int(ad.min())) + 1  # so that no group reaches into the next
        before = np.concatenate([[0], np.maximum.accumulate(ends + nth * far)[:-1]]) - nth * far
        new = starts | (ad >= before + CHAIN_BREAK)
        cov = np.where(new, w, np.maximum(0, ends - np.maximum(ad, before)))
        first = np.flatnonzero(new)
        head = np.flatnonzero(starts)  # chains are numbered from 1 in each group
        count = np.cumsum(new)
        cid = (count - (count[head] - 1)[nth - 1])[first]
        of = lambda f, c: f.reduceat(c, first)
        mix, cov, own_below = of(np.bitwise_or, role), of(np.add, cov), of(np.logical_or, (role == 1) & below[row])
        # a chain of one band's own seeds only is kept where no band lies below: else that one holds it too
        kept = (cov >= CHAIN_MIN) & ((mix != 1) | ~own_below)
        found = [a[row][first], b[row][first], comp[row][first].astype(bool), base[first], cid, of(np.minimum, ad), of(np.maximum, ends), of(np.minimum, dg), of(np.maximum, dg), mix.astype(np.int32), cov]
        return [c[kept] for c in found]

    return _covered_seeds(recs).mapped(make).rows("ctg_a long, ctg_b long, comp boolean, base long, cid long, alow long, ahgh long, dlow long, dhgh long, mix int, cov long")


def unmasked(found: DataFrame, masks: DataFrame) -> DataFrame:
    """Seeds whose shared prefix reaches beyond the mask, if any, that holds its start on either side; masks (ctg, beg, end), disjoint."""
    for side in ("a", "b"):
        own = masks.select(F.col("ctg").alias(f"ctg_{side}"), "beg", "end")
        found = mask_ahead(found, own, f"ctg_{side}", f"pos_{side}", most=KMER).where(F.col("mask") < F.col("plen")).drop("mask")
    return found


def unmasked_counts(contigs: DataFrame, masks: DataFrame) -> DataFrame:
    """(ctg_a, comp, n, sum_plen): the seeds of contigs (ctg, seq) that ``unmasked`` keeps, by the first contig and strand.

    Records carry their masks into the order of k-mers, where both ends of a seed are seen; a batch counts its own seeds
    before they are dealt. Masks go to windows of contigs, not to seeds.
    """
    keys = drawn(packed(contigs), _ORDER)
    counted = summed(2)

    def make(hi, lo, side, mask, use):
        plen, links = _links(hi, lo, use)
        a, b = _ends(links)
        kept = np.maximum(mask[a], mask[b]) < plen[a]
        a, b = a[kept], b[kept]
        return [side[a] >> 1, (side[a] ^ side[b]) & 1, np.ones(len(a), np.int64), plen[a].astype(np.int64)]

    def work(part: int, cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        ctg, comp, n, total = counted(cols)
        for k in range(0, len(ctg), STRETCH):
            yield [c[k : k + STRETCH] for c in (ctg, comp.astype(bool), n, total)]

    found = in_kmer_order(_by_strand(packed(contigs, masks=masks)), _strand_cuts(keys), FREQ - 1, make, merge=_few)
    return in_ranges(dealt(found, cuts_of([keys[2]]), merge=counted), "ctg_a long, comp boolean, n long, sum_plen long", work)


def banded(found: DataFrame, longest: int) -> DataFrame:
    """Seeds with ad (antidiagonal), band and dg (place in the band); longest: of all contigs."""
    i, j = F.col("pos_a").cast("long"), F.col("pos_b").cast("long")
    diag = F.when(F.col("comp"), 2 * longest - (i + j)).otherwise(longest + i - j)
    ad = F.when(F.col("comp"), longest - (i - j)).otherwise(i + j)
    return found.withColumn("ad", ad).withColumn("diag", diag).withColumn("band", F.shiftright("diag", BAND_BITS)).withColumn("dg", F.col("diag").bitwiseAND((1 << BAND_BITS) - 1)).drop("diag")


def block_for(longest: int) -> int | None:
    """What chains takes as block for contigs of this length at most: None where all antidiagonals lie in one."""
    return BLOCK if 4 * longest > BLOCK else None


def chains(with_bands: DataFrame, *, block: int | None = BLOCK) -> DataFrame:
    """Chains of seeds of a pair of contigs over two neighbouring bands, broken by antidiagonal gaps.

    Pairs whose seeds don't cover CHAIN_MIN in all have none; most go so, before they are sorted. block None: contigs
    are short (see ``block_for``), which bounds the seeds of a pair, and a pair is one task's. Else its bands are
    weighed, and those that with the one above hold seeds enough are scanned in blocks of antidiagonals, with what
    earlier blocks carry, so that one pair of long contigs is the work of many tasks. The chains are the same.
    """
    key = ["ctg_a", "ctg_b", "comp"]
    s = with_bands.select(*key, "band", "ad", "dg", (2 * F.col("plen")).alias("w"))
    near, up = (Window.partitionBy(*key).orderBy("band").rangeBetween(k, k) for k in (-1, 1))
    if block is None:
        s = s.withColumn("all", F.sum("w").over(Window.partitionBy(*key))).where(F.col("all") >= CHAIN_MIN).drop("all")
        s = s.withColumn("below", F.count("*").over(near) > 0).withColumn("role1", F.lit(True)).withColumn("role2", F.col("below"))
    else:
        none = lambda x: F.coalesce(x, F.lit(0))
        bands = s.groupBy(*key, "band").agg(F.sum("w").alias("own")).select("*", F.sum("own").over(near).alias("down"), F.sum("own").over(up).alias("above"))
        role1, role2 = F.col("own") + none(F.col("above")) >= CHAIN_MIN, none(F.col("own") + F.col("down")) >= CHAIN_MIN
        below = F.col("down").isNotNull()
        # stored, so that its size is known, and Spark broadcasts it if that is within its bound
        bands = stored(bands.select(*key, "band", role1.alias("role1"), (role2 & below).alias("role2"), below.alias("below")).where("role1 or role2"))
        s = s.join(bands, [*key, "band"])
    own = F.when(F.col("role1"), F.struct(F.col("band").alias("base"), F.col("ad"), F.col("dg"), F.col("w"), F.lit(1).alias("role"), F.col("below")))
    low = F.when(F.col("role2"), F.struct((F.col("band") - 1).alias("base"), F.col("ad"), (F.col("dg") + 64).alias("dg"), F.col("w"), F.lit(2).alias("role"), F.col("below")))
    x = s.select(*key, F.inline(F.array_compact(F.array(own, low))))
    group, order = [*key, "base"], ["ad", "role", "dg", "w"]
    ends = F.col("ad") + F.col("w")
    fresh = F.when(F.col("pe").isNull() | (F.col("ad") >= F.col("pe") + CHAIN_BREAK), 1).otherwise(0)
    if block is None:
        rows = Window.partitionBy(*group).orderBy(*order)
        x = x.withColumn("pe", F.max(ends).over(rows.rowsBetween(Window.unboundedPreceding, -1))).withColumn("new", fresh)
        x = x.withColumn("cid", F.sum("new").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        at = F.floor(F.col("ad") / block)
        x = carried_scans(x, group, order, {"pe": Scan("max", ends)}, block=at).withColumn("new", fresh)
        x = x.withColumn("old", 1 - F.col("new"))  # of equal seeds the first is the new one
        x = carried_scans(x, group, [*order, "old"], {"cid": Scan("sum", F.col("new"), upto=True)}, block=at)
    cover = F.when(F.col("new") == 1, F.col("w")).otherwise(F.greatest(F.lit(0), ends - F.greatest("ad", "pe")))
    g = x.groupBy(*group, "cid").agg(
        F.min("ad").alias("alow"), F.max(ends).alias("ahgh"), F.min("dg").alias("dlow"), F.max("dg").alias("dhgh"),
        F.bit_or("role").alias("mix"), F.sum(cover).alias("cov"), F.bool_or((F.col("role") == 1) & F.col("below")).alias("below"),
    )
    # a chain of one band's own seeds only is kept where no band lies below: else that one holds it too
    return g.where((F.col("cov") >= CHAIN_MIN) & ((F.col("mix") != 1) | ~F.col("below"))).drop("below")
