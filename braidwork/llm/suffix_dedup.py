"""Suffix-array dedup: every byte covered by a repeated string of ``length`` bytes, by column-wise
construction of the Burrows-Wheeler transform and common prefixes of many short strings.

A whole text's suffixes can't be sorted a column at a time on a cluster: as many rounds as the longest
text has bytes would each rewrite all. Only prefixes up to ``length`` decide, though, so the texts are
first cut where all equal strings are cut alike: each window of ``length`` bytes has an anchor, its
gram of least hash (the first of those), and neighbouring windows of one anchor form a piece. Equal
windows have equal anchors and lie in pieces of the same anchor. Then

* of pieces equal throughout, the earliest stays and all windows of the others are repeats;
* the pieces of an anchor that differ go to one task. Those that share no string of nearly the length
  with another are done; of the rest it inserts one symbol of each a round,
  from their ends, keeping the transform and the common prefixes (capped at ``length``) in suffix
  order; windows that then share a prefix of ``length`` are repeats of the earliest;
* an anchor with more than ``crowd`` differing pieces is dealt out by the hash of its windows instead.

Pieces and windows are told apart by 64-bit hashes of bytes, anchors also by theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import small_batches, stored
from ._text import BYTE_HASH, chunks, column_bytes, mix, prefix_hash, span_hash

_U = np.uint64
_HIGH = _U(0xFFFFFFFF00000000)


def pieces(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, anchor, hash, start (in its row), place of the anchor and number of windows of each piece."""
    none = np.zeros(0, np.int64)
    size = np.diff(offs)
    if not (size >= length).any():
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    run = prefix_hash(data, BYTE_HASH)
    at = np.arange(len(data) - gram + 1)
    full = span_hash(run, at, at + gram)
    low = (full & _HIGH) | at.astype(np.uint64)
    span, have = length - gram + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if span > have:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    # starts of the windows that lie in one row
    good = size >= length
    row = np.repeat(np.flatnonzero(good), size[good] - length + 1)
    first = np.repeat(offs[:-1][good] - np.concatenate([[0], np.cumsum(size[good] - length + 1)[:-1]]), size[good] - length + 1)
    start = first + np.arange(len(first))
    anchor = (low[start] & ~_HIGH).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(new)
    n = np.diff(np.append(a, len(start)))
    return row[a], full[anchor[a]], span_hash(run, start[a], start[a] + n - 1 + length), start[a] - offs[row[a]], anchor[a] - start[a], n


def sorted_suffixes(texts: list[np.ndarray], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and common prefix with the suffix before (at most cap) of all suffixes, in order.

    Column-wise: a round inserts one more symbol of every text, from the ends. In the order so far, the symbols before
    the suffixes are the transform; where a text's next suffix goes follows from how many symbols less than its own,
    or equal and before it, the transform holds. It shares one symbol more with its new neighbours of equal first
    symbol than the least common prefix between their places in the old order. Ends sort first, by text.
    """
    count = len(texts)
    size = np.array([len(x) for x in texts], np.int64)
    gap = np.zeros(1, np.uint8)  # one place after each text, where its empty suffix stands
    flat = np.concatenate([y for x in texts for y in (x, gap)] or [gap])
    off = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if count else size
    before = np.concatenate([[0], flat[:-1].astype(np.uint16) + np.uint16(1)]).astype(np.uint16)
    before[off] = 0  # nothing stands before a whole text
    who, at = np.arange(count, dtype=np.int32), (off + size).astype(np.int32)
    lcp = np.zeros(count, np.uint8 if cap < 256 else np.int32)
    turn = before[at] if count else before[:0]  # the transform
    place = np.arange(count)  # of the longest suffix so far of each text
    open_ = np.flatnonzero(turn)
    while len(open_):
        p = place[open_]
        order = np.argsort(turn, kind="stable")
        closed = len(turn) - int(np.count_nonzero(turn))
        rank = np.empty(len(turn), np.int32)
        rank[order] = np.arange(len(turn), dtype=np.int32)
        r = rank[p]
        to = count + r - closed
        prev, following = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, len(order) - 1)]
        like, on = np.flatnonzero((r > closed) & (turn[prev] == turn[p])), np.flatnonzero((following != p) & (turn[following] == turn[p]))
        shared = _least(lcp, np.concatenate([prev[like], p[on]]) + 1, np.concatenate([p[like], following[on]])) if len(like) + len(on) else lcp[:0]
        shared = np.minimum(shared, cap - 1) + 1
        old = np.ones(len(turn) + len(open_), bool)
        old[to] = False
        spread = lambda x, new: _merged(x, new, old, to)
        start = at[p] - 1
        who, at, turn, lcp = spread(who, open_), spread(at, start), spread(turn, before[start]), spread(lcp, 0)
        lcp[to[like]] = shared[: len(like)]
        lcp[to[on] + 1] = shared[len(like) :]
        place[open_] = to
        open_ = open_[before[start] > 0]
    return who, at - off[who], lcp


def _merged(x: np.ndarray, new: np.ndarray | int, old: np.ndarray, to: np.ndarray) -> np.ndarray:
    """x where old holds, and new at the places to."""
    out = np.empty(len(old), x.dtype)
    out[old] = x
    out[to] = new
    return out


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo..hi], both included, for each pair."""
    level = np.frexp((hi - lo + 1).astype(np.float32))[1].astype(np.uint8) - np.uint8(1)  # floor of log2
    out = values[lo]
    by = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[by], np.arange(int(level.max()) + 2))
    table = values
    for k in range(1, int(level.max()) + 1):
        half = 1 << (k - 1)
        table = np.minimum(table[:-half], table[half:])
        pick = by[bounds[k] : bounds[k + 1]]
        if len(pick):
            out[pick] = np.minimum(table[lo[pick]], table[hi[pick] - (1 << k) + 1])
    return out


def repeats(texts: list[np.ndarray], doc: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Text and start of the windows that also stand at an earlier (doc, start + place)."""
    who, beg, lcp = sorted_suffixes(texts, length)
    size = np.array([len(x) for x in texts])
    window = size[who] - beg >= length
    # suffixes that share length symbols form a class; ends and short suffixes never do
    group = np.cumsum(lcp < length)[window]
    who, beg = who[window], beg[window]
    place = np.lexsort((start[who] + beg, doc[who], group))
    g, d, p = group[place], doc[who[place]], start[who[place]] + beg[place]
    lead = np.ones(len(g), bool)
    lead[1:] = g[1:] != g[:-1]
    top = np.maximum.accumulate(np.where(lead, np.arange(len(g)), 0))
    late = (d != d[top]) | (p != p[top])
    return np.stack([who[place][late], beg[place][late]])


def may_repeat(raw: np.ndarray, offs: np.ndarray, anchor: np.ndarray, rel: np.ndarray, length: int, gram: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each piece that another of its anchor can share; first > last: none.

    rel: where the anchor stands in the piece. A window with l bytes before the anchor holds the string
    that begins step * (l // step) bytes before it and is length - step + 1 bytes long; at least two
    pieces must hold such a string.
    """
    run, span, windows = prefix_hash(raw, BYTE_HASH), length - step + 1, np.diff(offs) - length
    low, high = windows + 1, np.full(len(rel), -1)
    for back in range(0, length - gram + 1, step):
        first = rel - back
        here = np.flatnonzero((first >= 0) & (first + span <= np.diff(offs)))
        a = offs[here] + first[here]
        key = span_hash(run, a, a + span) ^ anchor[here].view(np.uint64)
        _, back_to, n = np.unique(key, return_inverse=True, return_counts=True)
        hit = here[n[back_to] > 1]
        low[hit] = np.minimum(low[hit], np.maximum(first[hit] - step + 1, 0))
        high[hit] = np.maximum(high[hit], np.minimum(first[hit], windows[hit]))
    return low, high


def _later_copies(whole: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pieces have an equal one here at an earlier (doc, start)."""
    order = np.lexsort((start, doc, whole))
    lead = np.ones(len(order), bool)
    lead[1:] = whole[order[1:]] != whole[order[:-1]]
    first = order[lead][np.cumsum(lead) - 1]
    late = np.zeros(len(order), bool)
    late[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    return late


def _joined_spans(who: np.ndarray, beg: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (who, beg) as maximal spans of bytes: who, first, end."""
    order = np.lexsort((beg, who))
    who, beg = who[order], beg[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (beg[1:] > beg[:-1] + length)
    a = np.flatnonzero(new)
    return who[a], beg[a], beg[np.append(a[1:], len(who)) - 1] + length if len(a) else beg[:0]


def row_key() -> Column:
    """What tells rows (doc_id, text) apart; rows that agree in both are cut alike."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("binary"))


def repeated_spans(docs: DataFrame, *, length: int = 100, gram: int = 32, crowd: int = 65536, load: int = 2048) -> DataFrame:
    """(row, first, end): spans of bytes of docs (doc_id, text) to remove; they may overlap. row: see row_key.

    A byte goes if a string of ``length`` bytes over it also starts earlier: at a smaller doc_id, or
    earlier in the same. Rows that repeat a doc_id stand at the same place, so equal strings at the
    same start of them aren't earlier than each other; each is cut for itself. A null doc_id comes first.
    Texts shorter than length have no spans. 1 <= gram <= length <= 1000; an empty table gives no spans, other
    columns are ignored, whatever their names.
    """
    if not 1 <= gram <= length <= 1000:
        raise ValueError("1 <= gram <= length <= 1000 is needed")
    small_batches(docs.sparkSession)
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    texts = docs.select(row_key().alias("row"), place.alias("doc_id"), F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in chunks(batch.column(2)):
                row, anchor, whole, start, rel, n = pieces(data, offs, length, gram)
                if len(row):
                    at = pa.array(row + i)
                    # what repeats an earlier piece right here needs no meeting: it is dealt anywhere, so copies don't pile up
                    sure = _later_copies(whole, batch.column(1).to_numpy(zero_copy_only=False)[row + i], start)
                    own = batch.column(0).to_numpy(zero_copy_only=False)[row + i].view(np.uint64)
                    anchor = np.where(sure, mix(own + mix(start.astype(np.uint64))), anchor)
                    yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(start << 20 | rel << 10 | n), pa.array(sure)], ["row", "doc_id", "anchor", "whole", "place", "sure"])

    found = texts.mapInArrow(cut, "row long, doc_id long, anchor long, whole long, place long, sure boolean").repartition("anchor")
    here = F.struct("doc_id", F.col("place"))
    piece, group = Window.partitionBy("anchor", "whole"), Window.partitionBy("anchor")
    ranked = found.withColumn("lead", F.min(here).over(piece)).withColumn("lo", F.min("whole").over(group)).withColumn("hi", F.max("whole").over(group))
    copy = F.col("sure") | ~(F.col("lead.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("lead.place") == F.col("place")))
    ranked = ranked.withColumn("copy", copy).where(F.col("copy") | (F.col("lo") != F.col("hi")))
    ranked = stored(ranked.select("row", "doc_id", "anchor", F.shiftright("place", 20).alias("start"), F.shiftright("place", 10).bitwiseAND(1023).alias("rel"), F.col("place").bitwiseAND(1023).alias("n"), "copy"))
    copies = ranked.where("copy").select("row", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1 + length).alias("end"))

    asked = ranked.where("not copy").withColumn("crowd", F.count("*").over(group) > crowd)
    asked = asked.groupBy("row").agg(F.collect_set(F.struct("anchor", "start", "rel", "n", "crowd")).alias("wanted"))
    met = texts.join(asked, "row")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, docs_, data, wanted = (batch.column(k) for k in range(4))
            raw, offs = column_bytes(data)
            rows = np.repeat(np.arange(len(batch)), wanted.value_lengths().to_numpy(zero_copy_only=False))
            anchor, start, rel, n, crowded = (wanted.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(5))
            text = [raw[offs[r] + s : offs[r] + s + k - 1 + length].tobytes() for r, s, k in zip(rows, start, n, strict=True)]
            yield pa.record_batch([docs_.take(pa.array(rows)), pa.array(anchor), pa.array(start), pa.array(rel), pa.array(crowded), pa.array(text, pa.binary()), row.take(pa.array(rows))], ["doc_id", "anchor", "start", "rel", "crowd", "piece", "row"])

    parts = met.select("row", "doc_id", "text", "wanted").mapInArrow(fetch, "doc_id long, anchor long, start long, rel long, crowd boolean, piece binary, row long")
    parts = stored(parts)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_anchor(batches, load):
            doc, anchor, start, rel = (held.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            raw, offs = column_bytes(held.column(4))
            key = held.column(5).to_numpy(zero_copy_only=False)
            low, high = may_repeat(raw, offs, anchor, rel, length, gram)
            some = np.flatnonzero(high >= low)
            key, doc, start, first, end = key[some], doc[some], start[some] + low[some], offs[some] + low[some], offs[some] + high[some] + length
            # pieces that are equal so far as they can repeat: the earliest of them stays, in each row at its place
            _, same = np.unique(span_hash(prefix_hash(raw, BYTE_HASH), first, end), return_inverse=True)
            order = np.lexsort((key, start, doc, same))
            lead = np.ones(len(order), bool)
            lead[1:] = same[order[1:]] != same[order[:-1]]
            whom = order[lead][np.cumsum(lead) - 1] if len(order) else order
            tied = (doc[order] == doc[whom]) & (start[order] == start[whom])
            new = lead.copy()
            new[1:] |= key[order[1:]] != key[order[:-1]]
            stays, copy = order[tied & new], order[~tied]
            late = repeats([raw[a:b] for a, b in zip(first[stays], end[stays], strict=True)], doc[stays], start[stays], length)
            who, a, b = _joined_spans(late[0], late[1], length)
            out = [key[stays][who], key[copy]], [start[stays][who] + a, start[copy]], [start[stays][who] + b, start[copy] + (end - first)[copy]]
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], ["row", "first", "end"])

    quiet = parts.where("not crowd").select("doc_id", "anchor", "start", "rel", "piece", "row").repartition("anchor").sortWithinPartitions("anchor")
    spans = quiet.mapInArrow(search, "row long, first long, end long")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offs in chunks(batch.column(2)):
                run, n = prefix_hash(data, BYTE_HASH), np.diff(offs) - length + 1
                row = np.repeat(np.arange(len(n)), n)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                a = offs[row] + inner
                start = batch.column(1).to_numpy(zero_copy_only=False)[i + row] + inner
                yield pa.record_batch([batch.column(0).take(pa.array(i + row)), pa.array(start), pa.array(span_hash(run, a, a + length).view(np.int64)), batch.column(3).take(pa.array(i + row))], ["doc_id", "start", "window", "row"])

    busy = parts.where("crowd").select("doc_id", "start", "piece", "row").mapInArrow(windows, "doc_id long, start long, window long, row long")
    least = busy.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("lead"))
    late = busy.join(least, "window").where((F.col("lead.doc_id") != F.col("doc_id")) | (F.col("lead.start") != F.col("start")))
    return copies.unionAll(spans).unionAll(late.select("row", F.col("start").alias("first"), (F.col("start") + length).alias("end")))


def _by_anchor(batches: Iterator[pa.RecordBatch], load: int) -> Iterator[pa.RecordBatch]:
    """Rows (sorted by column 1) put together to batches of about load rows, no anchor in two."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows >= load:
            whole = flush(held)
            anchor = whole.column(1).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                yield whole.slice(0, cut)
            held, rows = [whole.slice(cut)], len(whole) - cut
    if rows:
        yield flush(held)


def cut_repeats(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) for every row of docs.

    kept: what is left of the text's UTF-8 bytes; it needn't be valid UTF-8. A null text is empty.
    """
    spans = repeated_spans(docs, **options)
    by_row = spans.groupBy("row").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    texts = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    joined = texts.join(by_row, "row", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = column_bytes(batch.column(1))
            lists = batch.column(2)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            first, end = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
            removed, count, kept = [], [], []
            for r in range(len(batch)):
                text = raw[offs[r] : offs[r + 1]]
                if not n[r]:
                    removed.append(0)
                    count.append(0)
                    kept.append(text.tobytes())
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, first[ends[r] - n[r] : ends[r]], 1)
                np.add.at(edge, end[ends[r] - n[r] : ends[r]], -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                count.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(text[~gone].tobytes())
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
