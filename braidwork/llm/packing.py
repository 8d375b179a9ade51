"""Packing of tokenized documents into windows by best-fit decreasing.

A document longer than the window is first cut into full windows and a rest. Pieces of one length are alike, so the
whole packing follows from the number of pieces of each length (at most ``window`` counts, whatever the size of the
corpus): ``best_fit`` takes the lengths from the longest down, and a segment tree over remaining capacities finds the
tightest windows that still take one; runs of equal windows are filled at once. The plan is a list of runs ("pieces
number f onwards of length n go into windows w onwards, e each, at offset o"), and tasks look their pieces up in it.

What is left open is closed by cutting (``close_gaps``): the emptiest windows are dissolved, and their tokens, in order,
fill the gaps of the others; what then remains, less than one window, is cut into sequences whose lengths are powers
of two. So no sequence but those of a power of two is short of the window.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import small_batches, stored
from ._text import BYTE_HASH, SPACE, chunks, prefix_hash, runs, span_hash

KEPT_WORDS, KEPT_IDS = 1 << 20, 1 << 23  # a task forgets the ids of words when it holds more
SHORT = 64  # bytes of a word whose ids are kept
CHECK_HASH = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64 - 1, 256, np.uint64)


class Capacities:
    """A segment tree over the capacities 0 ... most: which are held by an open window."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.held = [0] * (2 * self.leaves)

    def put(self, capacity: int, held: bool) -> None:
        at = capacity + self.leaves
        self.held[at] = int(held)
        while at > 1:
            at //= 2
            self.held[at] = self.held[2 * at] | self.held[2 * at + 1]

    def tightest(self, size: int) -> int | None:
        """The least held capacity of at least size."""
        at = size + self.leaves
        while not self.held[at]:
            while at & 1:  # a right child: go up until there is something to the right
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.held[2 * at] else 2 * at + 1
        return at - self.leaves


@dataclass
class Packing:
    """Runs of pieces in windows, and what becomes of the windows that best fit leaves open; see ``place``."""

    window: int
    before: np.ndarray  # pieces of larger lengths, by length
    first: np.ndarray  # by run: its first piece, numbered from the longest length down
    at: np.ndarray  # by run: first window
    each: np.ndarray  # by run: pieces a window
    offset: np.ndarray  # by run: offset of the first piece in a window
    open: list[tuple[int, int, int]]  # first window, windows, tokens held; those that hold less than a window
    windows: int
    given: np.ndarray  # dissolved runs of windows: first window, windows, tokens held, start of their tokens in the stream
    slots: np.ndarray  # runs of places for the stream: start in it, length, places before, first window, offset there


def best_fit(counts: np.ndarray, window: int) -> Packing:
    """Best-fit decreasing of counts[n] pieces of each length n = 1 ... window.

    A piece goes into the tightest window that takes it, and the next of the same length into the same window while that
    takes it, as none is tighter; so equal windows are filled together, and one run at most is split for a length.
    """
    tree, groups, out, total, done = Capacities(window), {}, [], 0, 0
    before = np.zeros(window + 1, np.int64)

    def leave(capacity: int, first: int, n: int) -> None:
        if n:
            groups.setdefault(capacity, []).append((first, n))
            if capacity:
                tree.put(capacity, True)

    for size in range(window, 0, -1):
        before[size], left = done, int(counts[size])
        while left:
            capacity = tree.tightest(size)
            if capacity is None:
                capacity, first, n = window, total, -(-left // (window // size))
                total += n
            else:
                first, n = groups[capacity].pop()
                if not groups[capacity]:
                    tree.put(capacity, False)
            each = capacity // size
            full = min(n, left // each)
            if full:
                out.append((done, first, each, window - capacity))
                leave(capacity - each * size, first, full)
            left, done, first, n = left - full * each, done + full * each, first + full, n - full
            if n and left:  # fewer than each: one window takes them
                out.append((done, first, left, window - capacity))
                leave(capacity - left * size, first, 1)
                left, done, first, n = 0, done + left, first + 1, n - 1
            leave(capacity, first, n)
    run = np.array(out, np.int64).reshape(-1, 4).T
    open_ = [(first, n, window - c) for c, held in groups.items() if c for first, n in held]
    none = np.zeros((5, 0), np.int64)
    return Packing(window, before, run[0], run[1], run[2], run[3], open_, total, none[:4], none)


def close_gaps(plan: Packing) -> Packing:
    """Dissolve the emptiest open windows into the gaps of the others, and the rest into powers of two.

    Windows that hold a power of two need no padding and stay. Each dissolved window brings the tokens and takes away the
    gap of one whole window, so their number follows from the sum of the gaps.
    """
    short = sorted((x for x in plan.open if x[2] & (x[2] - 1)), key=lambda x: (x[2], x[0]))
    gaps = sum(n * (plan.window - held) for _, n, held in short)
    gone, given, slots, sent = -(-gaps // plan.window), [], [], 0
    rest = gone * plan.window - gaps  # tokens that no gap takes
    for k, (first, n, held) in enumerate(short):
        take = min(n, gone)
        if take:
            given.append((first, take, held, sent))
            sent, gone = sent + take * held, gone - take
        short[k] = (first + take, n - take, held)
    start = count = 0
    for first, n, held in short:
        if n:
            slots.append((start, plan.window - held, count, first, held))
            start, count = start + n * (plan.window - held), count + n
    windows = plan.windows
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            slots.append((start, 1 << bit, count, windows, 0))
            start, count, windows = start + (1 << bit), count + 1, windows + 1
    plan.given = np.array(sorted(given), np.int64).reshape(-1, 4).T
    plan.slots, plan.windows = np.array(slots, np.int64).reshape(-1, 5).T, windows
    return plan


def place(plan: Packing, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces go, given their lengths and their numbers among those of equal length.

    Gives (piece, cut, sequence, offset): by part the index of its piece, where in it the part begins, and its place. A
    piece of a window that stays is one part; others are cut where the places of their tokens end.
    """
    n = plan.before[size] + number
    run = np.searchsorted(plan.first, n, "right") - 1
    k = n - plan.first[run]
    window, offset = plan.at[run] + k // plan.each[run], plan.offset[run] + k % plan.each[run] * size
    parts, low = np.ones(len(size), np.int64), np.zeros(len(size), np.int64)
    moved, x = np.zeros(len(size), bool), np.zeros(len(size), np.int64)
    if plan.given.size:
        first, many, held, sent = plan.given
        g = np.searchsorted(first, window, "right") - 1
        moved = (g >= 0) & (window < first[g] + many[g])
        x = sent[g] + (window - first[g]) * held[g] + offset  # place in the stream
        start, length, before, into, at = plan.slots

        def slot(y: np.ndarray) -> np.ndarray:
            s = np.searchsorted(start, y, "right") - 1
            return before[s] + (y - start[s]) // length[s]

        low[moved] = slot(x[moved])
        parts[moved] = slot(x[moved] + size[moved] - 1) - low[moved] + 1
    piece = np.repeat(np.arange(len(size)), parts)
    cut, sequence, there = np.zeros(len(piece), np.int64), window[piece], offset[piece]
    on = np.flatnonzero(moved[piece])
    if len(on):
        q = low[piece[on]] + (np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts))[on]
        s = np.searchsorted(before, q, "right") - 1
        begin = start[s] + (q - before[s]) * length[s]
        cut[on] = np.maximum(begin - x[piece[on]], 0)
        sequence[on] = into[s] + q - before[s]
        there[on] = at[s] + np.maximum(x[piece[on]] - begin, 0)
    return piece, cut, sequence, there


#: Fixed values of word-level BPE files: how they split a text that is in NFC and lower case.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: What a plain word isn't made of: apostrophes, "<" (of special tokens), controls, and letters beyond U+00FF.
ODD = re.compile("[^!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
LETTER, DIGIT, MARK, OTHER = 1, 2, 3, 4
KIND = np.full(256, OTHER, np.uint8)
KIND[SPACE] = 0
KIND[0x21:0x7F] = MARK
KIND[0x30:0x3A] = DIGIT
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[[0x27, 0x3C]] = OTHER


def fragments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end): the words of a text, plain ones in lower case and cut into letters, single digits and marks."""
    begin, end = runs(data, offs, SPACE)
    kind = KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[~np.isin(data[lead + 1], (0x97, 0xB7)) & (data[lead + 1] & 0xC0 == 0x80)]
    kind[lead] = kind[lead + 1] = LETTER
    odd = np.concatenate([[0], np.cumsum(kind == OTHER)])
    plain = np.zeros(len(data) + 1, np.int8)
    on = odd[begin] == odd[end]
    plain[begin[on]] += 1
    plain[end[on]] -= 1
    plain = np.cumsum(plain[:-1]).astype(bool)
    first = np.zeros(len(data), bool)
    first[1:] = plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    first[begin] = True
    first &= ~SPACE[data]
    lower = data.copy()
    lower[plain & (data >= 0x41) & (data <= 0x5A)] += 32
    lead = lead[plain[lead] & (data[lead + 1] <= 0x9E)] + 1
    lower[lead] += 32
    start = np.flatnonzero(first)
    last = np.append(start[1:], len(data))
    return lower, start, np.minimum(last, end[np.searchsorted(begin, start, "right") - 1])


class WordIds:
    """Ids of texts by the ids of their words, each distinct word encoded once.

    For tokenizers that drop white space and merge nothing across it. Where the file splits by SPLIT, the letters, digits
    and marks of plain words are looked up one by one, by the file's own model; other words go through all its steps.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.encoder = Tokenizer.from_str(tokenizer)
        self.model, steps = self.encoder.model, json.loads(tokenizer)
        cut = [x.get("pattern", {}).get("Regex") for x in (steps["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_parts = cut == [SPLIT, None] and (steps["normalizer"] or {}).get("normalizers") == NORMAL
        shown = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
        hidden = [b for b in range(256) if b not in shown]
        shown |= {b: chr(256 + k) for k, b in enumerate(hidden)}  # byte-level files name bytes by printable characters
        self.spelt = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.uint64)
        self.known, self.check, self.begin, self.size = none, none, none.astype(np.int64), none.astype(np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def encoded(self, words: list[str]) -> list[list[int]]:
        odd = [w for w in words if not self.by_parts or ODD.search(w)]
        whole = dict(zip(odd, self.encoder.encode_batch(odd, add_special_tokens=False), strict=True))
        return [whole[w].ids if w in whole else [t.id for t in self.model.tokenize(w if w.isascii() else w.translate(self.spelt))] for w in words]

    def add(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Where in self.ids the ids of new words begin, and how many there are."""
        size = np.array([len(x) for x in found], np.int64)
        until = self.used + np.concatenate([[0], np.cumsum(size)])
        while until[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : until[-1]] = [i for x in found for i in x]
        self.used = int(until[-1])
        return until[:-1], size

    def look_up(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """begin and size in self.ids of words; they are told apart by two hashes of 64 bits, long ones not at all."""
        if len(self.known) > KEPT_WORDS or self.used > KEPT_IDS:
            self.forget()

        def texts(which: np.ndarray) -> list[str]:
            return [data[a:b].tobytes().decode() for a, b in zip(begin[which].tolist(), end[which].tolist(), strict=True)]

        at, size = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        short = np.flatnonzero(end - begin <= SHORT)
        one, two = (span_hash(prefix_hash(data, t), begin[short], end[short]) for t in (BYTE_HASH, CHECK_HASH))
        word, first, which = np.unique(one, return_index=True, return_inverse=True)
        check = two[first]
        k = np.minimum(np.searchsorted(self.known, word), max(len(self.known) - 1, 0))
        seen = self.known[k] == word if len(self.known) else np.zeros(len(word), bool)
        if (check[which] != two).any() or (len(self.known) and (self.check[k[seen]] != check[seen]).any()):
            short = short[:0]  # words that one hash doesn't tell apart: none is looked up
        else:
            new = np.flatnonzero(~seen)
            where, many = self.add(self.encoded(texts(short[first[new]])))
            place = np.searchsorted(self.known, word[new])
            self.known, self.check = np.insert(self.known, place, word[new]), np.insert(self.check, place, check[new])
            self.begin, self.size = np.insert(self.begin, place, where), np.insert(self.size, place, many)
            k = np.searchsorted(self.known, word)[which]
            at[short], size[short] = self.begin[k], self.size[k]
        rest = np.ones(len(begin), bool)
        rest[short] = False
        if rest.any():
            at[rest], size[rest] = self.add(self.encoded(texts(np.flatnonzero(rest))))
        return at, size

    def __call__(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each row, end_id after each, and the n + 1 offsets of the rows."""
        if self.by_parts:
            data, begin, end = fragments(data, offs)
        else:
            begin, end = runs(data, offs, SPACE)
        at, size = self.look_up(data, begin, end)
        until = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(at - until[:-1], size) + np.arange(until[-1])]
        rows = until[np.searchsorted(begin, offs)]
        return np.insert(ids, rows[1:], end_id), rows + np.arange(len(rows))


_encoders: dict[str, WordIds] = {}


def encoder_of(tokenizer: str) -> WordIds:
    """One for a worker process, so that its later tasks know the words of earlier ones."""
    if tokenizer not in _encoders:
        _encoders.clear()
        _encoders[tokenizer] = WordIds(tokenizer)
    return _encoders[tokenizer]


def token_pieces(docs: DataFrame, tokenizer: str, *, window: int, end_id: int) -> DataFrame:
    """(doc_row, doc_id, doc_tokens, start, size, part, number, ids): the documents' ids cut at multiples of window.

    number counts the pieces of one size within the task (part) that wrote them; doc_row tells rows apart. The result is
    stored, since both depend on how docs is read.
    """
    small_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, seen, encode = TaskContext.get().partitionId(), 0, np.zeros(window + 1, np.int64), encoder_of(tokenizer)
        for batch in batches:
            for a, b, data, offs in chunks(batch.column(1)):
                ids, rows = encode(data, offs, end_id)
                tokens = np.diff(rows)
                parts = -(-tokens // window)
                doc = np.repeat(np.arange(b - a), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                size = np.minimum(tokens[doc] - start, window)
                order = np.argsort(size, kind="stable")
                kind, first, many = np.unique(size[order], return_index=True, return_counts=True)
                number = np.zeros(len(size), np.int64)
                number[order] = np.arange(len(size)) - np.repeat(first - seen[kind], many)
                seen[kind] += many
                lists = pa.ListArray.from_arrays(pa.array(np.append(rows[doc] + start, len(ids)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch(
                    [pa.array((part << 33) + row + doc, pa.int64()), batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(tokens[doc]), pa.array(start),
                     pa.array(size, pa.int32()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(number), lists],
                    ["doc_row", "doc_id", "doc_tokens", "start", "size", "part", "number", "ids"],
                )
                row += b - a

    kinds = "doc_row long, doc_id long, doc_tokens long, start long, size int, part int, number long, ids array<int>"
    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, kinds))


def pack_documents(docs: DataFrame, tokenizer: str, *, window: int = 4096, end_id: int = 2) -> DataFrame:
    """(doc_row, doc_id, doc_tokens, start, length, ids, sequence_id, offset): every id of docs in one piece of one sequence.

    tokenizer is the text of a ``tokenizers`` file whose model works within words (see WordIds); end_id follows each
    document. A null text is empty, so every row has one id at least; null and repeated doc_ids are told apart by
    doc_row. Other columns of docs are left out. An empty table gives none. Sequences have window ids, but for those
    whose number of ids is a power of two.

    Documents are tokenized once. The counts by length (at most window rows) reach the driver. Pieces are numbered
    within their length by their task and a running sum over tasks, so that a length which most rows have is no hot
    key; the join of that sum carries the ids, and is the one shuffle of them (none, where Spark broadcasts the sums).
    """
    pieces = token_pieces(docs, tokenizer, window=window, end_id=end_id)
    by_task = pieces.groupBy("size", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(window + 1, np.int64)
    for size, n in by_task.groupBy("size").agg(F.sum("n")).collect():
        counts[size] = n
    plan = close_gaps(best_fit(counts, window))
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # stored, so that its size is known before the ids are: Spark broadcasts it if that is within its bound
    base = stored(by_task.select("size", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    columns = ["doc_row", "doc_id", "doc_tokens", "start", "size", "number", "ids"]
    rows = pieces.join(base, ["size", "part"]).withColumn("number", F.col("number") + F.col("base")).select(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size, ids = batch.column(4).to_numpy().astype(np.int64), batch.column(6)
            piece, cut, sequence, offset = place(plan, size, batch.column(5).to_numpy())
            begin = ids.offsets.to_numpy().astype(np.int64)
            at = np.append(begin[piece] + cut, begin[-1])
            doc = batch.select([0, 1, 2]).take(pa.array(piece)).columns
            start = batch.column(3).to_numpy()[piece] + cut
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids.values)
            yield pa.record_batch([*doc, pa.array(start), pa.array(np.diff(at)), lists, pa.array(sequence), pa.array(offset)], names=[*columns[:4], "length", "ids", "sequence_id", "offset"])

    kinds = "doc_row long, doc_id long, doc_tokens long, start long, length long, ids array<int>, sequence_id long, offset long"
    return rows.mapInArrow(pack, kinds)
