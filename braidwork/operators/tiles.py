"""Sequences cut into windows and tiles, so that no task holds a whole long contig."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20  # of windows sent on at once


def windows(contigs: DataFrame, width: int, *, before: int = 0, after: int = 0) -> DataFrame:
    """(ctg, start, lead, own, seq): windows of contigs (ctg, seq) that own width places each, from start on.

    seq has up to ``before`` places ahead of start (lead of them) and up to ``after`` beyond the own ones, as far as the
    contig goes. A contig of width or less is one window, and stays where it is; windows of longer ones are dealt anew,
    so that one contig keeps many tasks busy. Empty and null sequences have no window.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ctg", "start", "lead", "own", "seq"]
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for ctg, seq in zip(batch.column(0), batch.column(1), strict=True):
                text = seq.as_buffer()
                for start in range(0, len(text), width):
                    own, first = min(width, len(text) - start), max(0, start - before)
                    piece = text[first : start + own + after]
                    held.append((ctg.as_py(), start, start - first, own, piece))
                    size += len(piece)
                    if size > BATCH_BYTES:
                        yield _as_batch(held, names)
                        held, size = [], 0
            if held:
                yield _as_batch(held, names)

    rows = contigs.where(F.length("seq") > 0).select(F.col("ctg").cast("long").alias("ctg"), "seq")
    kinds = "ctg long, start long, lead int, own int, seq string"
    long_ = F.length("seq") > width
    whole = rows.where(~long_).select("ctg", F.lit(0).cast("long").alias("start"), F.lit(0).alias("lead"), F.length("seq").alias("own"), "seq")
    return whole.unionAll(rows.where(long_).mapInArrow(cut, kinds).repartition("ctg", "start"))


def _as_batch(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    ctg, start, lead, own, piece = zip(*held, strict=True)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    flat = np.concatenate([np.frombuffer(p, np.uint8) for p in piece])
    offs = np.cumsum([0, *map(len, piece)]).astype(np.int32)
    text = pa.StringArray.from_buffers(len(piece), pa.py_buffer(offs), pa.py_buffer(flat))
    return pa.record_batch([*(pa.array(c, k) for c, k in zip((ctg, start, lead, own), kinds, strict=True)), text], names)


def tiles(contigs: DataFrame, width: int) -> DataFrame:
    """(ctg, tile, seq): the windows of contigs without overlap, numbered from 0."""
    return windows(contigs, width).select("ctg", F.expr(f"start div {width}").cast("int").alias("tile"), "seq")


def read_ranges(asked: DataFrame, tiled: DataFrame, width: int, key: list[str], beg: Column, end: Column) -> DataFrame:
    """asked (key, ctg, places beg to end of it) with the tiles that hold the places: (key, ctg, tile, seq), each once for a key.

    Ranges become tile numbers, so a contig is read where it is asked for; beg and end are cut to the contig.
    """
    low, high = F.expr("0"), F.greatest(beg, F.lit(0))
    first = F.floor(F.greatest(beg, low) / width).cast("int")
    last = F.floor(F.greatest(end - 1, high) / width).cast("int")
    wanted = asked.select(*key, "ctg", F.explode(F.sequence(first, last)).alias("tile")).distinct()
    return wanted.join(tiled, ["ctg", "tile"]).select(*key, "ctg", "tile", "seq")


class Parts:
    """A sequence of which some tiles were read: arrays of the stretches without a gap."""

    def __init__(self, tiles_: list[tuple[int, str]], width: int, length: int, *, turned: bool = False):
        self.length, self.stretches = length, []
        k, tiles_ = 0, sorted(tiles_)
        while k < len(tiles_):
            n = k + 1
            while n < len(tiles_) and tiles_[n][0] == tiles_[n - 1][0] + 1:
                n += 1
            digits = np.frombuffer("".join(s for _, s in tiles_[k:n]).encode(), np.uint8)
            start = tiles_[k][0] * width
            if turned:  # digits 0-3 are bytes 48-51
                start, digits = length - start - len(digits), 99 - digits[::-1]
            self.stretches.append((start, digits))
            k = n

    def around(self, low: int, high: int) -> tuple[int, np.ndarray, bool, bool] | None:
        """The stretch that holds the places from low to high, cut to the sequence: its start, its digits, and whether the
        sequence goes on before and beyond it; None if none does."""
        low, high = min(max(low, 0), self.length), min(max(high, 0), self.length)
        for start, digits in self.stretches:
            if start <= low and high <= start + len(digits):
                return start, digits, start > 0, start + len(digits) < self.length
        return None
