"""Rows of whole numbers dealt out to sorted ranges of keys as packed blocks, a few bytes a row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE_ROWS = 1 << 20  # rows of a range, about: what one task puts in order
BATCH_ROWS = 1 << 21  # rows dealt at once
DRAWN = 32  # keys drawn for a range, to cut by
WHOLE, NTH = 64, 8  # of a task's rows, keys are drawn from the first WHOLE and every NTH of the others
_BLOCK = "part int, block binary"

Columns = list[np.ndarray]


@dataclass(frozen=True)
class Made:
    """Columns of whole numbers that Python makes of a table's batches: columns(batches).

    What deals them out takes them in the task that makes them, so no row of theirs passes Spark.
    """

    frame: DataFrame
    columns: Callable[[Iterable[pa.RecordBatch]], Iterator[Columns]]

    def mapped(self, change: Callable[..., Columns]) -> Made:
        columns = self.columns
        return Made(self.frame, lambda batches: (change(*c) for c in columns(batches)))

    def rows(self, schema: str) -> DataFrame:
        columns, names = self.columns, [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for out in columns(batches):
                if len(out[0]):
                    yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in out], names=names)

        return self.frame.mapInArrow(run, schema)


def made_of(rows: DataFrame | Made, names: list[str]) -> Made:
    if isinstance(rows, Made):
        return rows
    return Made(rows.select(names), lambda batches: ([c.to_numpy().astype(np.int64) for c in b.columns] for b in batches if len(b)))


def drawn(rows: DataFrame | Made, keys: list[str], *, range_rows: int | None = None) -> Columns:
    """Columns of a few rows for the driver to cut by, DRAWN of a range; of Made, its first columns."""
    size = range_rows or RANGE_ROWS
    if isinstance(rows, DataFrame):
        few = rows.select(keys)
        few = (few.sample(DRAWN / size, seed=7) if size > DRAWN else few).toArrow()
        return [c.to_numpy().astype(np.int64) for c in few.columns]
    columns, share = rows.columns, min(1.0, DRAWN / size)
    nth = NTH if share * NTH <= 1 else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, before = np.random.default_rng(TaskContext.get().partitionId()), 0
        for batch in batches:
            at = np.arange(before, before + len(batch))
            before += len(batch)
            for use, chance in ((at < WHOLE, share), ((at >= WHOLE) & (at % nth == 0), share * nth)):
                for cols in columns([batch.filter(pa.array(use))]):
                    kept = rng.random(len(cols[0])) < chance
                    if kept.any():
                        yield pa.record_batch([pa.array(c[kept].astype(np.int64)) for c in cols[: len(keys)]], names=keys)

    few = rows.frame.mapInArrow(run, ", ".join(f"{k} long" for k in keys)).toArrow()
    return [c.to_numpy().astype(np.int64) for c in few.columns]


def in_order(cols: Columns) -> np.ndarray:
    """Rows in the order of their columns. As many of these as fit are sorted as one number with the row's own."""
    n, least = len(cols[0]), [int(c.min()) for c in cols]
    low = max(1, (n - 1).bit_length())
    wide = [(int(c.max()) - x).bit_length() for c, x in zip(cols, least, strict=True)]
    fit = int(np.searchsorted(np.cumsum(wide), 63 - low, "right"))
    if not fit:
        return np.lexsort(cols[::-1])
    key = np.zeros(n, np.int64)
    for c, x, w in zip(cols[:fit], least, wide, strict=False):
        key = (key << w) | (c - x)
    key = (key << low) | np.arange(n)
    key.sort()
    order = key & ((1 << low) - 1)
    if fit < len(cols):
        key >>= low
        like = np.zeros(n + 1, bool)  # the row before
        like[1:-1] = key[1:] == key[:-1]
        tied = np.flatnonzero(like[:-1] | like[1:])
        if len(tied):
            run, rows = np.cumsum(~like[:-1])[tied], order[tied]
            order[tied] = rows[np.lexsort([*(c[rows] for c in reversed(cols[fit:])), run])]
    return order


def _sorted(held: list[Columns]) -> Columns:
    """Pieces of columns as whole ones, in order; the list is emptied, so that each piece is held once."""
    pieces, cols = [list(x) for x in zip(*held, strict=True)], []
    held.clear()
    while pieces:
        cols.append(np.concatenate(pieces.pop(0)).astype(np.int64, copy=False))
    order = in_order(cols)
    for k, c in enumerate(cols):
        cols[k] = c[order]
    return cols


def cuts_of(cols: list[np.ndarray]) -> np.ndarray:
    """Every DRAWN-th of the keys drawn (one a row, in order). Cuts only say which task a row goes to: any give the same results."""
    order = np.lexsort(cols[::-1])[DRAWN::DRAWN]
    return np.unique(np.stack([c[order] for c in cols], axis=1), axis=0).reshape(-1, len(cols))


def range_cuts(rows: DataFrame | Made, keys: list[str], *, range_rows: int | None = None) -> np.ndarray:
    """Keys that cut rows into ranges of about range_rows."""
    return cuts_of(drawn(rows, keys, range_rows=range_rows))


def lower_bounds(cols: list[np.ndarray], cuts: np.ndarray) -> np.ndarray:
    """For each cut, how many rows of sorted columns lie before it."""
    low, high = (np.searchsorted(cols[0], cuts[:, 0], side) for side in ("left", "right"))
    for k in np.flatnonzero(low < high):
        a, b = low[k], high[k]
        for c, x in zip(cols[1:], cuts[k, 1:], strict=False):
            if a == b:
                break
            a, b = (a + np.searchsorted(c[a:b], x, side) for side in ("left", "right"))
        low[k] = a
    return low


def _planes(cols: list[np.ndarray]) -> tuple[np.ndarray, list[int], list[int]]:
    """Columns less their least values as bytes, a row of the matrix a row; bytes of each column, and the least values."""
    least = [int(c.min()) for c in cols]
    wide = [((int(c.max()) - x).bit_length() + 7) // 8 for c, x in zip(cols, least, strict=True)]
    matrix, at = np.empty((len(cols[0]), sum(wide)), np.uint8), 0
    for c, x, w in zip(cols, least, wide, strict=True):
        matrix[:, at : at + w] = (c - x).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :w]
        at += w
    return matrix, wide, least


def _packed(n: int, wide: list[int], begin: int, least: list[int], planes: bytes) -> bytes:
    """A block: a short head of numbers as text, and the bytes of the columns, pressed if that is shorter."""
    small = pa.compress(planes, "zstd", asbytes=True)
    return ",".join(map(str, (n, begin, *wide, *least))).encode() + b"\n" + min(planes, small, key=len)


def _unpacked(block: bytes) -> Columns:
    head, flat = block.split(b"\n", 1)
    n, begin, *both = map(int, head.split(b","))
    wide, least = both[: len(both) // 2], both[len(both) // 2 :]
    size = n * sum(wide)
    flat = np.frombuffer(flat if len(flat) == size else pa.decompress(flat, size, "zstd", asbytes=True), np.uint8)
    found, at = [], 0
    for w, x in zip(wide, least, strict=True):
        full = np.zeros((n, 8), np.uint8)
        full[:, :w] = flat[at : at + w * n].reshape(w, n).T
        at += w * n
        found.append(full.view("<i8").reshape(n) + x)
    found[0][0] = begin  # the first column goes as steps
    found[0] = np.cumsum(found[0])
    return found


def blocks_of(rows: DataFrame | Made, cuts: np.ndarray, *, near: Callable[[Columns, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None, merge: Callable[[Columns], Columns] | None = None) -> DataFrame:
    """Rows (whole numbers) as packed blocks, part k with those from cut k - 1 up to cut k; columns of cuts lead.

    A batch is put in order first. merge(columns) may then make fewer rows of it. near(columns, rows before each cut)
    says from which row before a cut, and up to which after it, rows go to the range on the other side as well.
    """

    def deal(held: list[Columns]) -> Iterator[pa.RecordBatch]:
        cols = _sorted(held)
        if merge:
            cols = merge(cols)
        at = lower_bounds(cols, cuts)
        before, after = near(cols, at) if near else (at, at)
        first, last = np.concatenate([[0], before]), np.concatenate([after, [len(cols[0])]])
        lead = cols[0]
        matrix, wide, least = _planes([np.diff(lead, prepend=lead[0]), *cols[1:]])
        del cols
        ready: list[tuple[int, bytes]] = []
        size = 0
        for k in np.flatnonzero(first < last):
            a, b = int(first[k]), int(last[k])
            ready.append((k, _packed(b - a, wide, int(lead[a]), least, matrix[a:b].T.tobytes())))
            size += len(ready[-1][-1])
            if size > 8 << 20:
                yield as_batch(ready)
                ready, size = [], 0
        if ready:
            yield as_batch(ready)

    def as_batch(ready: list[tuple[int, bytes]]) -> pa.RecordBatch:
        part, block = zip(*ready, strict=True)
        return pa.record_batch([pa.array(part, pa.int32()), pa.array(block, pa.binary())], names=["part", "block"])

    made = made_of(rows, ["*"])
    columns = made.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []
        size = 0
        for cols in columns(batches):
            if len(cols[0]):
                held.append(cols)
                size += len(cols[0])
            del cols
            if size >= BATCH_ROWS:
                yield from deal(held)
                size = 0
        if size:
            yield from deal(held)

    return made.frame.mapInArrow(run, _BLOCK)


def dealt(rows: DataFrame | Made, cuts: np.ndarray, *, near: Callable[[Columns, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None, merge: Callable[[Columns], Columns] | None = None) -> DataFrame:
    """The blocks of rows, dealt out to their ranges."""
    return gathered(blocks_of(rows, cuts, near=near, merge=merge), cuts)


def gathered(blocks: DataFrame, cuts: np.ndarray) -> DataFrame:
    return blocks.repartitionById(len(cuts) + 1, F.col("part"))


def summed(keys: int) -> Callable[[Columns], Columns]:
    """Rows in order with equal first columns as one, the others added up."""

    def merge(cols: Columns) -> Columns:
        at = new_at(cols[:keys])
        return [*(c[at] for c in cols[:keys]), *(np.add.reduceat(c, at) for c in cols[keys:])]

    return merge


def new_at(cols: Columns) -> np.ndarray:
    """Where other values begin in sorted columns."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


def ranged(blocks: DataFrame, make: Callable[[int, Columns], Iterator[Columns]]) -> Made:
    """make(part, columns in order) of every range of dealt blocks, a task each."""

    def columns(batches: Iterable[pa.RecordBatch]) -> Iterator[Columns]:
        held: list[Columns] = []
        part = None
        for batch in batches:
            for k, block in zip(batch.column(0), batch.column(1), strict=True):
                part = k.as_py() if part is None else part
                held.append(_unpacked(block.as_py()))
        if part is None:
            return
        yield from make(part, _sorted(held))

    return Made(blocks, columns)


def in_ranges(blocks: DataFrame, schema: str, make: Callable[[int, Columns], Iterator[Columns]]) -> DataFrame:
    """make(part, columns in order) of every range of dealt blocks, a task each, as batches of columns of schema."""
    return ranged(blocks, make).rows(schema)
