"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Two documents link when the Jaccard similarity of their sets of word shingles is at least num/den.
Then their sets differ in at most H elements, H following from the sizes. The universe of shingles is
cut by hash into segments, as many as the size band of the larger set needs: each segment has one unit
(both sides index the segment's subset) or two (they also index every subset with one element left
out). If the units of the segments add up to H + 1 or more, a linking pair agrees in a segment with
one unit or differs by one element at most in a segment with two, so it meets under an index key.

* Bands: a set is indexed for its own band and, where a larger partner may lie in the next, for that.
* Allocation: how many segments of either kind a band has is chosen by cost, from the measured number
  of sets and their mean size (see ``plan_bands``). ``slack`` more units than needed are allotted, so a
  set may leave out its emptiest and most frequent keys. Leaving out depends on the key alone, and a set
  whose keys of that kind exceed the slack keeps all of them; so no pair is lost.
* Thinning: a set's parity bitmap has a bit for each shingle or more, which every shingle that hashes
  there flips. Where two bitmaps differ in more bits than linking sets may in shingles, the sets don't
  link; so the sets of a key fall into parts by bitmap, a small share of the shingles' bytes, and only
  parts of two sets or more go on.
* Equal sets are one class from the start. Keys whose sets overlap are searched together inside tasks,
  which compare only sets that aren't connected yet and return links that span all links; pairs are
  never written out. A family of more than ``load`` shingles is dealt out by key, and a key with more
  than ``group_limit`` sets by pairs of blocks.
* Verification counts the common shingles (48 bits of their hashes) exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._store import cleared, only, small_batches, stored
from ._text import Words, chunks, join_hashes, mix, set_hash, shingles

RATIO = 1.5  # of the upper and lower size of a band
_U = np.uint64


@dataclass(frozen=True)
class Band:
    """Sizes low to high - 1 of the larger set, and how its segments are allotted."""

    low: int
    high: int
    need: int  # units that a linking pair can't all miss: H + 1
    single: int
    double: int

    @property
    def slack(self) -> int:
        return self.single + 2 * self.double - self.need


def largest_difference(total: int, num: int, den: int) -> int:
    """The most elements by which two linking sets whose sizes add up to total differ."""
    return total * (den - num) // (den + num)


def plan_bands(sizes: dict[int, tuple[int, float]], top: int, num: int, den: int, share: float = 0.001, own: float = 0.5) -> list[Band]:
    """Bands up to size top with the cheapest allocation of single and double segments.

    sizes: number of sets and their mean size by band. The cost of a set is the keys it gives plus the
    sets that it meets by chance: of the others in the band, the given share has the same common
    passage, and own is the part of a set's shingles that lie outside it.
    """
    bands, low = [], 1
    while low <= top:
        high = max(low + 1, math.ceil(low * RATIO))
        number, mean = sizes.get(len(bands), (0, (low + high) / 2))
        need = largest_difference(2 * (high - 1), num, den) + 1
        units = need + 2 + need // 10
        best = None
        for double in range(0, units // 2 + 1, max(1, units // 200)):  # a hundred allocations of large bands are near enough
            single = units - 2 * double
            x = own * mean / (single + double)
            met = single * math.exp(-2 * x) + double * ((1 + x) * math.exp(-x)) ** 2
            cost = single + double + mean * double / (single + double) + share * number * met
            if best is None or cost < best[0]:
                best = (cost, single, double)
        bands.append(Band(low, high, need, best[1], best[2]))
        low = high
    return bands


def band_of(n: int) -> int:
    """Index of the band whose sizes hold n."""
    k, low = 0, 1
    while True:
        high = max(low + 1, math.ceil(low * RATIO))
        if n < high:
            return k
        k, low = k + 1, high


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, j, data, offs in chunks(column):
        words = Words(data, offs)
        joined = join_hashes(words.hash, width)
        for row in range(i, j):
            yield row, shingles(words, row - i, joined, width)


def bitmap(items: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set in 64-bit words; it has a power of two of bits, at least one an element."""
    words = 1 << max(0, (len(items) - 1).bit_length() - 6)
    odd = np.bincount((items & _U(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer words."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, bits) for every row of docs; set_id and bits are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, bits = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), [None] * len(batch)
            for row, items in _sets(batch.column(1), width):
                if len(items):
                    n[row], ids[row], bits[row] = len(items), set_hash(items), bitmap(items).tobytes()
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(ids, mask=n == 0), pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "set_id", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id long, bits binary")


def _keys_of(items: np.ndarray, scheme: int, band: Band) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of a set under a band, the units that each would cost to leave out, and the slack left."""
    salt = mix(np.array([scheme + 1], np.uint64))[0]
    spread = mix(items ^ salt)
    m = band.single + band.double
    seg = ((spread >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
    count = np.bincount(seg, minlength=m)
    total = np.zeros(m, np.uint64)
    np.add.at(total, seg, spread)
    lead = mix(np.arange(m, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + salt)
    unit = np.ones(m, np.int8)
    unit[band.single :] = 2
    lost = (count == 0) | ((count == 1) & (unit == 2))
    free = band.slack - int(unit[lost].sum())
    shown = count > 0 if free >= 0 else np.ones(m, bool)
    keys, units = [mix(total[shown] + lead[shown])], [unit[shown]]
    if band.double:
        inner = (seg >= band.single) & ((count[seg] > 1) | (free < 0))
        keys.append(mix(total[seg[inner]] - spread[inner] + lead[seg[inner]]))
        units.append(np.full(len(keys[-1]), 2, np.int8))
    return np.concatenate(keys), np.concatenate(units), free


def index_keys(docs: DataFrame, bands: list[Band], width: int, num: int, den: int) -> DataFrame:
    """(key, set_id, scheme, unit, free) of every set; a task gives the keys of equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for _, items in _sets(batch.column(0), width):
                n = len(items)
                if not n or (own := set_hash(items)) in seen:
                    continue
                seen.add(own)
                first = band_of(n)
                for scheme in range(first, len(bands)):
                    band = bands[scheme]
                    if den * n < num * band.low:
                        break
                    if band.need > 1:  # else only equal sets link
                        keys, units, free = _keys_of(items, scheme, band)
                        out.append((keys, units, own, scheme, free))
                        held += len(keys)
                if held > 100_000:
                    yield _key_batch(out)
                    out, held = [], 0
            if out:
                yield _key_batch(out)
            if len(seen) > 1_000_000:
                seen.clear()

    return docs.select("text").mapInArrow(run, "key long, set_id long, scheme short, unit byte, free int")


def _key_batch(out: list[tuple]) -> pa.RecordBatch:
    sizes = [len(x[0]) for x in out]
    spread = lambda k, kind: pa.array(np.repeat(np.array([x[k] for x in out], kind), sizes))
    return pa.record_batch(
        [pa.array(np.concatenate([x[0] for x in out]).view(np.int64)), spread(2, np.int64), spread(3, np.int16), pa.array(np.concatenate([x[1] for x in out])), spread(4, np.int32)],
        ["key", "set_id", "scheme", "unit", "free"],
    )


def _pack(items: np.ndarray) -> bytes:
    """Sorted 64-bit values to six bytes each, their upper ones: 48 bits tell a pair's shingles apart."""
    return np.ascontiguousarray(items.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(">u8")[:, 0].astype(np.uint64)


def _with_items(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """The rows of asked (doc_id, deal, set_id, buckets) with the packed shingles of the document."""
    schema = "deal long, set_id long, buckets array<long>, items binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x for _, x in _sets(batch.column(0), width)]
            items, own = [_pack(x) for x in made], np.array([set_hash(x) if len(x) else 0 for x in made], np.int64)
            lists = batch.column(1)
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            row = pa.array(np.repeat(np.arange(len(batch)), n))
            out = pa.record_batch([flat.field(0), flat.field(1), flat.field(2), pa.array(items, pa.binary()).take(row)], ["deal", "set_id", "buckets", "items"])
            # a doc_id may repeat with another text
            yield out.filter(pa.array(own[row.to_numpy()] == flat.field(1).to_numpy(zero_copy_only=False)))

    by_doc = asked.groupBy("doc_id").agg(F.collect_list(F.struct("deal", "set_id", "buckets")).alias("deals"))
    texts = only(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), asked.select("doc_id"), "doc_id")
    return texts.join(by_doc, "doc_id").select("text", "deals").mapInArrow(run, schema)


def _deals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """The rows of each deal (column 0, sorted) as one table, and its buckets as arrays of rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        deal = batch.column(0).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(deal[1:] != deal[:-1]) + 1), len(deal)]
        for x, y in zip(cut, cut[1:], strict=False):
            if held and y > x and held[0].column(0)[0].as_py() != deal[x]:
                yield _with_buckets(held)
                held = []
            if y > x:
                held.append(batch.slice(x, y - x))
    if held:
        yield _with_buckets(held)


def _with_buckets(held: list[pa.RecordBatch]) -> tuple[pa.Table, list[np.ndarray]]:
    table = pa.Table.from_batches(held).combine_chunks()
    lists = table.column("buckets").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(flat, kind="stable")
    return table, np.split(row[order], np.flatnonzero(np.diff(flat[order])) + 1)


def _near_parts(size: np.ndarray, bits: list[np.ndarray], bucket: np.ndarray, num: int, den: int) -> Iterator[np.ndarray]:
    """The parts, of two sets or more, that a bucket falls into when sets too far apart by bitmap aren't joined."""
    words = min(len(bits[k]) for k in bucket)
    flat, n = np.stack([folded(bits[k], words) for k in bucket]), size[bucket]
    rest = np.arange(len(bucket))
    while len(rest) > 1:
        part, todo, rest = [rest[0]], [rest[0]], rest[1:]
        while todo and len(rest):
            s = todo.pop()
            apart = np.bitwise_count(flat[rest] ^ flat[s]).sum(axis=1, dtype=np.int64)
            near = (apart * (den + num) <= (n[rest] + n[s]) * (den - num)) & (den * np.minimum(n[rest], n[s]) >= num * np.maximum(n[rest], n[s]))
            part.extend(rest[near])
            todo.extend(rest[near])
            rest = rest[~near]
        if len(part) > 1:
            yield bucket[part]


def _blocked(groups: DataFrame, group_limit: int) -> DataFrame:
    """groups (members, set_id, n) with a bucket: the group, or of a very large one each pair of blocks that holds the set's."""
    blocks = F.ceil(F.col("n") / group_limit).cast("int")
    own = groups.withColumn("own", F.pmod(F.xxhash64("set_id", F.lit(1)), blocks).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return paired.withColumn("bucket", F.xxhash64("members", F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other")


def thinned(groups: DataFrame, sets: DataFrame, num: int, den: int, group_limit: int) -> DataFrame:
    """groups (members, set_id, n) cut to the parts that bitmaps leave together; sets: (set_id, n_shingles, bits).

    Groups of the same least member are thinned in one task, so that most bitmaps go to few tasks; the
    larger a group, the more tasks its least member is dealt to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, buckets in _deals(batches):
            ids, size = (table.column(k).to_numpy() for k in ("set_id", "n_shingles"))
            bits, spread = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()], mix(ids.view(np.uint64))
            parts, seen = [], set()
            for bucket in buckets:
                for part in _near_parts(size, bits, bucket, num, den):
                    name = int(np.bitwise_xor.reduce(spread[part]).view(np.int64))
                    if name not in seen:
                        seen.add(name)
                        parts.append((name, part))
            if parts:
                n = np.array([len(p) for _, p in parts])
                yield pa.record_batch([pa.array(np.repeat(np.array([k for k, _ in parts], np.int64), n)), pa.array(ids[np.concatenate([p for _, p in parts])]), pa.array(np.repeat(n, n))], ["members", "set_id", "n"])

    least = groups.withColumn("least", F.min("set_id").over(Window.partitionBy("members")))
    deal = F.xxhash64("least", F.pmod(F.xxhash64("bucket"), F.ceil(F.col("n") / 1024)))
    asked = _blocked(least, group_limit).groupBy("set_id", deal.alias("deal")).agg(F.collect_set("bucket").alias("buckets"))
    dealt = asked.join(sets, "set_id").select("deal", "set_id", "buckets", "n_shingles", "bits").repartition("deal").sortWithinPartitions("deal")
    return dealt.mapInArrow(run, "members long, set_id long, n long").dropDuplicates(["members", "set_id"])


def _spanning_links(ids: np.ndarray, items: list[np.ndarray], buckets: list[np.ndarray], num: int, den: int) -> tuple[list[int], list[int]]:
    """Links that connect what the links within the buckets connect.

    In a bucket whose sets aren't connected yet, each set outside the largest connected part is compared
    with all that aren't connected to it.
    """
    size = np.array([len(x) for x in items])
    values, flat = np.unique(np.concatenate(items), return_inverse=True)
    own = np.split(flat, np.cumsum(size)[:-1])
    seen = np.zeros(len(values), bool)
    tried = np.zeros((len(ids), len(ids)), bool) if len(ids) <= 4096 else None
    mark = np.arange(len(ids))
    a, b = [], []
    for bucket in buckets:
        marks, n = np.unique(mark[bucket], return_counts=True)
        if len(marks) < 2:
            continue
        most = marks[n.argmax()]
        part, starts = np.concatenate([own[k] for k in bucket]), np.concatenate([[0], np.cumsum(size[bucket])[:-1]])
        for s in bucket[mark[bucket] != most]:
            open_ = (mark[bucket] != mark[s]) & (den * np.minimum(size[bucket], size[s]) >= num * np.maximum(size[bucket], size[s]))
            if tried is not None:
                open_ &= ~tried[s, bucket]
                tried[s, bucket] = tried[bucket, s] = True
            if not open_.any():
                continue
            if open_.sum() * 4 < len(bucket):
                rest = bucket[open_]
                counted, first = np.concatenate([own[k] for k in rest]), np.concatenate([[0], np.cumsum(size[rest])[:-1]])
            else:
                rest, counted, first = bucket, part, starts
            seen[own[s]] = True
            common = np.add.reduceat(seen[counted], first, dtype=np.int64)
            seen[own[s]] = False
            for t in rest[(common * (num + den) >= num * (size[rest] + size[s])) & (mark[rest] != mark[s])]:
                if mark[t] != mark[s]:
                    mark[mark == mark[t]] = mark[s]
                    a.append(int(ids[s]))
                    b.append(int(ids[t]))
    return a, b


def jaccard_links(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, hot: int = 32, group_limit: int = 4096, load: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """The classes of equal shingle sets, and links between classes that span all links.

    Returns (doc_id, n_shingles, set_id) by document, and (a, b) pairs of set_id. hot: a key with
    more sets is left out where the slack allows it. Any doc_id may repeat; rows count singly.
    """
    small_batches(docs.sparkSession)
    made = stored(shingle_sets(docs, width))
    by_doc = made.drop("bits")
    full = by_doc.where("set_id is not null")
    top = full.agg(F.max("n_shingles")).first()[0] or 0
    edges, low = [], 1
    while low <= top:
        edges.append(low)
        low = max(low + 1, math.ceil(low * RATIO))
    if not edges:
        return by_doc, full.select(F.col("set_id").alias("a"), F.col("set_id").alias("b")).limit(0)
    band = F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x <= F.col("n_shingles"))) - 1
    sizes = {r["k"]: (r["n"], r["mean"]) for r in full.groupBy(band.alias("k")).agg(F.count("*").alias("n"), F.avg("n_shingles").alias("mean")).collect()}
    bands = plan_bands(sizes, math.ceil(top * den / num), num, den)

    keys = index_keys(docs, bands, width, num, den).repartition("key")
    once = keys.dropDuplicates(["key", "set_id"])
    group = Window.partitionBy("key")
    met = once.withColumn("n", F.count("*").over(group)).where("n > 1")
    met = stored(met.withColumn("members", F.bit_xor(F.xxhash64("set_id")).over(group)))

    heavy = met.where(F.col("n") > hot)
    over = heavy.groupBy("set_id", "scheme").agg(F.sum("unit").alias("u"), F.min("free").alias("f")).where("u > f").select("set_id", "scheme")
    kept = heavy.join(over, ["set_id", "scheme"], "left_semi").withColumn("n", F.count("*").over(group)).where("n > 1").withColumn("members", F.bit_xor(F.xxhash64("set_id")).over(group))
    columns = ["members", "set_id", "n"]
    groups = met.where(F.col("n") <= hot).select(columns).unionAll(kept.select(columns)).dropDuplicates(["members", "set_id"])
    sets = made.where("set_id is not null and doc_id is not null").select("set_id", "n_shingles", "bits").dropDuplicates(["set_id"])
    groups = stored(thinned(groups, sets, num, den, group_limit))
    cleared(met)

    # buckets that share sets are searched together, so that a set's shingles go there once; where they
    # are too many, the buckets of such a family are dealt out by hash
    mates = groups.withColumn("least", F.min("set_id").over(Window.partitionBy("members")))
    family = components(mates.select(F.col("set_id").alias("a"), F.col("least").alias("b")))
    leaders = full.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"))
    named = mates.join(family, mates.set_id == F.col("node")).join(leaders, "set_id")
    loads = family.join(leaders, F.col("node") == F.col("set_id")).groupBy("component").agg(F.ceil(F.sum("size") / load).alias("deals"))
    named = _blocked(named.join(loads, "component"), group_limit)
    named = named.withColumn("deal", F.xxhash64("component", F.pmod(F.xxhash64("bucket"), F.col("deals"))))
    asked = stored(named.groupBy("doc_id", "deal", "set_id").agg(F.collect_set("bucket").alias("buckets")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, buckets in _deals(batches):
            a, b = _spanning_links(table.column("set_id").to_numpy(), [_unpack(x) for x in table.column("items").to_pylist()], sorted(buckets, key=len), num, den)
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = _with_items(docs, asked, width).repartition("deal").sortWithinPartitions("deal")
    links = stored(dealt.mapInArrow(search, "a long, b long").distinct())
    cleared(groups, asked)
    return by_doc, links


def link_components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    component_id: the smallest doc_id reachable by links, the row's own included. A null or blank text
    has an empty set and links with nothing; texts shorter than the shingle width are one shingle.
    Rows that repeat a doc_id each get a row. A null doc_id names no component of its own.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    by_doc, links = jaccard_links(docs, **options)
    reach = components(links)
    sets = by_doc.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    # stored, so that the joins after them are of plain tables, which adaptive execution splits at a large group
    sets = stored(sets.join(reach, sets.set_id == reach.node, "left").select("set_id", F.coalesce("component", "set_id").alias("group"), "least"))
    least = stored(sets.groupBy("group").agg(F.min("least").alias("component_id")))
    named = stored(sets.join(least, "group").select("set_id", "component_id"))
    return by_doc.join(named, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that link, directly or by steps, to one with a smaller doc_id."""
    known = stored(link_components(docs, **options).where("doc_id <> component_id").select("doc_id").distinct())
    return only(docs, known, "doc_id", out=True)
