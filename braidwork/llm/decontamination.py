"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

The index holds the test items; the queries are the passages of every training text, windows of
``window`` words that overlap by half. Items of more than half a window are searched with windows of twice,
four times, ... the length, in which they lie whole; so no item changes another's passages. An item's BM25 impacts are divided by its score against itself,
so a threshold is a share of the item. All items of a passage above it are retrieved, and the item's
question and answer are then looked for in the document, exactly, as word shingles.

Items are indexed in shards of ``shard_items``, each broadcast by itself, so what is broadcast has a
bound however many items there are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import only, small_batches, stored
from ._text import Words, chunks, join_hashes, mix

K1, B_LEN = 1.2, 0.75


@dataclass
class Index:
    """Postings of a shard: for each term (sorted hashes) the items and impacts, with block maxima."""

    items: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    posted: np.ndarray
    impact: np.ndarray
    top: np.ndarray  # greatest impact of each term
    block: int
    block_top: list[np.ndarray]  # by term: greatest impact of each run of block postings
    wide_first: np.ndarray  # by term: where its entries in the two next begin
    wide: np.ndarray  # runs of items (item // block) that hold the term
    wide_top: np.ndarray  # and its greatest impact in each
    question: list[np.ndarray]
    answer: list[np.ndarray]

    def __post_init__(self):
        self.lists, self.first_list, self.top_list = self.posted.tolist(), self.first.tolist(), self.top.tolist()
        self.runs = int(self.wide.max()) + 1 if len(self.wide) else 0
        self.wide_count = np.diff(self.wide_first)
        self.common = self.wide_count > max(4, self.runs // 20)  # terms of so many items that only their maxima are summed


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last line is the answer; of a single line, the last quarter of its words."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)])).hash


def _grams(hashes: np.ndarray, width: int) -> np.ndarray:
    if len(hashes) >= width:
        return np.unique(join_hashes(hashes, width))
    return mix(join_hashes(hashes, len(hashes)) + np.uint64(len(hashes))) if len(hashes) else np.zeros(0, np.uint64)


def build_index(rows: list[tuple[int, str]], idf: dict[int, float], mean: float, width: int, block: int = 2) -> Index:
    """An index of (item_id, text) rows; idf by word hash, mean: words of an item on average."""
    rows = sorted(r for r in rows if r[0] is not None)
    posts: dict[int, list[tuple[int, float]]] = {}
    items, question, answer = [], [], []
    for item, text in rows:
        hashes = _words(text or "")
        if not len(hashes):
            continue
        uniq, tf = np.unique(hashes, return_counts=True)
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B_LEN + B_LEN * len(hashes) / mean)) * np.array([idf.get(int(t), 0.0) for t in uniq])
        if not weight.sum():
            continue
        for t, w in zip(uniq.tolist(), (weight / weight.sum()).tolist(), strict=True):
            posts.setdefault(t, []).append((len(items), w))
        items.append(item)
        q, a = split_item(text)
        question.append(_grams(_words(q), width))
        answer.append(_grams(_words(a), width))
    terms = np.array(sorted(posts), np.uint64)
    lists = [posts[int(t)] for t in terms]
    posted, impact = np.array([p for x in lists for p, _ in x], np.int64), np.array([w for x in lists for _, w in x])
    blocks = [np.array([max(w for _, w in x[k : k + block]) for k in range(0, len(x), block)]) for x in lists]
    wide = [sorted({p // block for p, _ in x}) for x in lists]
    wide_top = [max(w for p, w in x if p // block == b) for x, bs in zip(lists, wide, strict=True) for b in bs]
    return Index(np.array(items, np.int64), terms, np.cumsum([0, *map(len, lists)]), posted, impact, np.array([x.max() for x in blocks]), block, blocks, np.cumsum([0, *map(len, wide)]), np.array([b for x in wide for b in x], np.int64), np.array(wide_top), question, answer)


def wand(index: Index, terms: list[int], least: float) -> list[tuple[int, float]]:
    """All items whose summed impacts over terms (positions in index.terms) reach least.

    Block-max WAND: cursors stand on postings in item order. The pivot is the first item that the
    terms' maxima allow; if the maxima of the blocks that would hold it don't, the cursors move past
    the nearest end of those blocks unscored.
    """
    out = []
    posted, first, top = index.lists, index.first_list, index.top_list
    cursors = sorted([posted[first[t]], t, first[t]] for t in terms)
    while cursors:
        total, last = 0.0, None
        for k, (_, t, _) in enumerate(cursors):
            total += top[t]
            if total >= least:
                last = k
                break
        if last is None:
            break
        pivot = cursors[last][0]
        while last + 1 < len(cursors) and cursors[last + 1][0] == pivot:
            last += 1
        bound, end = 0.0, len(index.items)
        for _, t, at in cursors[: last + 1]:
            lo, hi = first[t], first[t + 1]
            k = bisect_left(posted, pivot, at, hi)
            if k < hi:
                b = (k - lo) // index.block
                bound += index.block_top[t][b]
                end = min(end, posted[min(lo + (b + 1) * index.block, hi) - 1])
        aligned = cursors[0][0] == pivot
        if bound < least:  # no item up to the nearest block end, or the next cursor, can reach it
            to = end + 1 if last + 1 >= len(cursors) else min(end + 1, cursors[last + 1][0])
            to = max(to, pivot + aligned)
        elif aligned:
            score = sum(index.impact[at] for _, _, at in cursors[: last + 1])
            if score >= least:
                out.append((pivot, float(score)))
            to = pivot + 1
        else:
            to = pivot
        moved = []
        for item, t, at in cursors[: last + 1]:
            hi = first[t + 1]
            if item < to:
                at = bisect_left(posted, to, at, hi)
            if at < hi:
                moved.append([posted[at], t, at])
        cursors = sorted(moved + cursors[last + 1 :])
    return out


def _spread(index: Index, terms: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells row * runs + run of items, and the greatest impact there, of each term in its row."""
    lo, n = index.wide_first[terms], index.wide_count[terms]
    at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(rows, n) * index.runs + index.wide[at], index.wide_top[at]


def search_text(index: Index, hashes: np.ndarray, window: int, least: float) -> dict[int, float]:
    """The best share of each item (position) over the passages of a text, of those that reach least."""
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == hashes)
    at = at[known]
    order = np.argsort(at, kind="stable")
    before = np.full(len(at), -1)  # where the term stood last
    same = at[order[1:]] == at[order[:-1]]
    before[order[1:][same]] = known[order[:-1][same]]
    # what each half of a window adds at most, as its second half and as its first: a term counts once
    step = window // 2
    half, parts = known // step, max(1, -(-len(hashes) // step))
    new, newer = before < half * step, before < (half - 1) * step
    common = index.common[at]
    first = np.bincount(half, np.where(new & common, index.top[at], 0), parts)
    second = np.bincount(half, np.where(newer & common, index.top[at], 0), parts)
    bound = first + np.append(second[1:], 0)
    # of the other terms the maxima by run of items: rows are windows
    rare = ~common
    rows = np.concatenate([half[rare & new], half[rare & newer & (half > 0)] - 1])
    cells, tops = _spread(index, np.concatenate([at[rare & new], at[rare & newer & (half > 0)]]), rows)
    near = np.unique(cells)
    if len(near):
        most = np.bincount(np.searchsorted(near, cells), tops)
        np.maximum.at(room := np.zeros(parts), near // index.runs, most)
        bound = bound + room
    best: dict[int, float] = {}
    for h in np.flatnonzero(bound >= least * (1 - 1e-9)):
        lo, hi = np.searchsorted(half, (h, h + 2))
        terms = np.unique(at[lo:hi])
        cells, tops = _spread(index, terms, np.zeros(len(terms), np.int64))
        if np.bincount(cells, tops).max() < least * (1 - 1e-9):
            continue  # no run of items can reach it
        for item, score in wand(index, terms.tolist(), least * (1 - 1e-9)):
            best[item] = max(best.get(item, 0.0), score)
    return best


def benchmark_overlaps(docs: DataFrame, items: DataFrame, *, window: int = 128, least: float = 0.7, overlap: float = 0.8, width: int = 5, shard_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) where an item leaks into a document.

    score: the best passage's BM25 as a share of the item's own. Both overlaps, the shares of the
    question's and the answer's shingles that the document holds, must reach ``overlap``. An item
    without words, a null item_id and a null or blank text give no rows; equal rows count once. Texts are searched
    whole, however long. Rows that repeat a doc_id are searched each, and give one row an item, with the best of each
    figure. Empty tables give no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in chunks(batch.column(1)):
                words = Words(data, offs)
                who = np.repeat(np.arange(i, j), np.diff(words.first))
                yield pa.record_batch([batch.column(0).take(pa.array(who)), pa.array(words.hash.view(np.int64))], ["item_id", "word"])

    tests = stored(items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct())
    said = tests.mapInArrow(words_of, "item_id long, word long")
    by_item = said.groupBy("item_id").agg(F.count("*").alias("n"))
    number, total = by_item.agg(F.count("*"), F.sum("n")).first()
    out = None
    if number:
        df = stored(said.distinct().groupBy("word").agg(F.count("*").alias("df")))
        shards = -(-tests.count() // shard_items)
        for k in range(shards):
            part = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
            rows = [(r[0], r[1]) for r in part.collect()]
            seen = part.mapInArrow(words_of, "item_id long, word long").select("word").distinct()
            idf = {r[0] & (2**64 - 1): float(np.log1p((number - r[1] + 0.5) / (r[1] + 0.5))) for r in df.join(seen, "word").collect()}
            by_window: dict[int, list] = {}
            for r in rows:
                by_window.setdefault(window_of(len(_words(r[1])), window), []).append(r)
            held = [(w, build_index(x, idf, total / number, width)) for w, x in sorted(by_window.items())]
            found = _search_shard(docs, spark.sparkContext.broadcast(held), least, overlap, width)
            out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], _SCHEMA)
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


_SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def window_of(n: int, window: int) -> int:
    """The passage length for an item of n words: window, doubled until the item takes half of it at most."""
    while 2 * n > window:
        window *= 2
    return window


def _search_shard(docs: DataFrame, held, least: float, overlap: float, width: int) -> DataFrame:
    """The rows of _SCHEMA for a shard, held as (window, index) of each passage length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: list[tuple[int, Index]] = [x for x in held.value if len(x[1].items)]
        share = lambda part, whole: float(np.isin(part, whole, assume_unique=True).mean()) if len(part) else 1.0
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, j, data, offs in chunks(batch.column(1)):
                words = Words(data, offs)
                for row in range(i, j):
                    hashes = words.hash[words.first[row - i] : words.first[row - i + 1]]
                    grams = None
                    for window, own in indexes if len(hashes) else ():
                        found = search_text(own, hashes, window, least)
                        if found and grams is None:
                            grams = _all_grams(hashes, width)
                        for item, score in sorted(found.items()):
                            q, a = share(own.question[item], grams), share(own.answer[item], grams)
                            if q >= overlap and a >= overlap:
                                rows.append((ids[row], int(own.items[item]), score, q, a))
            if rows:
                yield pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)


def _all_grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """All runs of 1 to width words as shingles: a short answer is one run of fewer words."""
    short = [mix(join_hashes(hashes, k) + np.uint64(k)) for k in range(1, width)]
    return np.unique(np.concatenate([*short, join_hashes(hashes, width)]))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a test item: all rows of their doc_id. Rows with a null doc_id stay."""
    return only(docs, stored(benchmark_overlaps(docs, items, **options).select("doc_id").distinct()), "doc_id", out=True)
