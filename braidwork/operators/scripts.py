"""Edit scripts between sequences: fewest differences in linear space, fewer gaps, and scripts along alignments.

A script is a list of runs (op, n): ``=`` equal symbols, ``X`` replaced ones, ``D`` symbols of a alone, ``I`` of b alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import stored
from .alignment import _PAIR, TILE, trace_points
from .tiles import Parts, read_ranges, tiles

Script = list[tuple[str, int]]
SMALL = 64  # cells of a table that is filled at once


def _middle(a: bytes, b: bytes) -> tuple[int, int]:
    """A point, not an end of both, that a path of fewest differences from begin to end goes through.

    Waves from both ends, two of them held at a time, until they meet on a diagonal.
    """
    n, m = len(a), len(b)
    ahead, back = {0: 0}, {n - m: n}
    for d in range(n + m + 1):
        for forward in (True, False):
            wave = ahead if forward else back
            if d:
                grown: dict[int, int] = {}
                for k, i in wave.items():
                    for to, at in ((k, i + 1), (k + 1, i + 1), (k - 1, i)) if forward else ((k, i - 1), (k - 1, i - 1), (k + 1, i)):
                        if 0 <= at <= n and 0 <= at - to <= m and (to not in grown or (at > grown[to]) == forward):
                            grown[to] = at
                wave = grown
            for k, i in wave.items():
                if forward:
                    while i < n and i - k < m and a[i] == b[i - k]:
                        i += 1
                else:
                    while i > 0 and i - k > 0 and a[i - 1] == b[i - k - 1]:
                        i -= 1
                wave[k] = i
            if forward:
                ahead = wave
            else:
                back = wave
            for k, i in ahead.items():
                if k in back and i >= back[k]:
                    i = i if forward else back[k]
                    return i, i - k
    raise AssertionError("waves meet after n + m differences at the latest")


def edit_script(a: bytes, b: bytes) -> Script:
    """A script of fewest differences from a to b, by halves: space grows with the lengths, not with their product."""
    out: Script = []
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        head = 0
        while head < min(len(x), len(y)) and x[head] == y[head]:
            head += 1
        tail = 0
        while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        _add(out, "=", head)
        if tail:
            todo.append((x[len(x) - tail :], y[len(y) - tail :]))
            if head + tail < max(len(x), len(y)):
                todo.append((x[head : len(x) - tail], y[head : len(y) - tail]))
            continue
        x, y = x[head:], y[head:]
        if not x or not y:
            _add(out, "D", len(x))
            _add(out, "I", len(y))
        elif len(x) == len(y) == 1:
            _add(out, "X", 1)
        elif len(x) * len(y) <= SMALL:
            for op, n in _small(x, y):
                _add(out, op, n)
        else:
            i, j = _middle(x, y)
            todo += [(x[i:], y[j:]), (x[:i], y[:j])]
    return out


def _add(script: Script, op: str, n: int) -> None:
    if n and script and script[-1][0] == op:
        script[-1] = (op, script[-1][1] + n)
    elif n:
        script.append((op, n))


def _small(a: bytes, b: bytes) -> Script:
    """edit_script by the full table."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        was, row = rows[-1], [i]
        for j, y in enumerate(b, 1):
            row.append(min(was[j - 1] + (x != y), was[j] + 1, row[-1] + 1))
        rows.append(row)
    i, j, back = len(a), len(b), []
    while i or j:
        here = rows[i][j]
        if i and j and rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]) == here:
            i, j = i - 1, j - 1
            back.append("=" if a[i] == b[j] else "X")
        elif i and rows[i - 1][j] + 1 == here:
            i -= 1
            back.append("D")
        else:
            j -= 1
            back.append("I")
    out: Script = []
    for op in reversed(back):
        _add(out, op, 1)
    return out


def differences(script: Script) -> int:
    return sum(n for op, n in script if op != "=")


def gaps(script: Script) -> int:
    """Runs of D or I, those side by side as one."""
    return sum(op in "DI" and (not k or script[k - 1][0] not in "DI") for k, (op, _) in enumerate(script))


def replay(script: Script, a: bytes, b: bytes) -> bytes:
    """a edited by the script, which takes the symbols of X and I from b; ``=`` that isn't equal is an error."""
    i = j = 0
    out = bytearray()
    for op, n in script:
        if op == "=" and a[i : i + n] != b[j : j + n]:
            raise ValueError("the script doesn't fit")
        out += a[i : i + n] if op == "=" else b[j : j + n] if op in "XI" else b""
        i, j = i + n * (op != "I"), j + n * (op != "D")
    if (i, j) != (len(a), len(b)):
        raise ValueError("the script doesn't fit")
    return bytes(out)


def fewer_gaps(script: Script, a: bytes, b: bytes) -> Script:
    """The script with gaps moved along a and b until they meet others, where that costs no difference.

    A gap may move by a symbol if the symbols that it passes are as alike after as before. From the left, each gap is
    tried against the one before it; moves that bring two together are kept. Never more differences, never more gaps.
    """
    columns = [op for op, n in script for _ in range(n)]
    kind = lambda k: columns[k] if 0 <= k < len(columns) else "."
    k = 0
    while k < len(columns):
        if columns[k] not in "DI" or kind(k - 1) in "DI":
            k += 1
            continue
        end = k
        while kind(end) == columns[k]:
            end += 1
        moved = None if kind(end) in "DI" else _slid(columns, k, end, a, b)
        if moved:
            columns = moved
            k = max(0, k - 1)
            while k and columns[k] in "DI":
                k -= 1
        k = max(k + 1, end if not moved else 0)
    out: Script = []
    for op in columns:
        _add(out, op, 1)
    return out


def _slid(columns: list[str], start: int, end: int, a: bytes, b: bytes) -> list[str] | None:
    """columns with the gap [start, end) moved to the left until it touches the gap before, at no more differences; or None."""
    op, size, left = columns[start], end - start, start
    while left and columns[left - 1] not in "DI":
        left -= 1
    if not left:
        return None
    i, j = (sum(c not in x for c in columns[:left]) for x in ("I", "D"))
    i, j = i + size * (op == "D"), j + size * (op == "I")
    passed = ["=" if x == y else "X" for x, y in zip(a[i : i + start - left], b[j : j + start - left], strict=True)]
    if passed.count("X") > columns[left:start].count("X"):
        return None
    return columns[:left] + [op] * size + passed + columns[end:]


_RUNS = "array<struct<op:string,n:int>>"


def _as_rows(script: Script) -> list[dict]:
    return [{"op": op, "n": n} for op, n in script]


def scripts_of(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, script, n_diffs, n_gaps) of two strings of each row, as UTF-8 bytes; null where one is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if x is None or y is None else edit_script(x, y) for x, y in zip(batch.column(len(key)).to_pylist(), batch.column(len(key) + 1).to_pylist(), strict=True)]
            some = lambda f: [None if s is None else f(s) for s in found]  # noqa: E731,B023
            kind = pa.list_(pa.struct([("op", pa.string()), ("n", pa.int32())]))
            made = [pa.array(some(_as_rows), kind), pa.array(some(differences), pa.int32()), pa.array(some(gaps), pa.int32())]
            yield pa.record_batch([*batch.columns[: len(key)], *made], names=[*key, "script", "n_diffs", "n_gaps"])

    rows = pairs.select(*key, F.col(a).cast("binary"), F.col(b).cast("binary"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(key)])
    return rows.mapInArrow(run, f"{kinds}, script {_RUNS}, n_diffs int, n_gaps int")


def alignment_scripts(overlaps: DataFrame, contigs: DataFrame, *, tile: int = TILE) -> DataFrame:
    """overlaps (with trace) and script, n_diffs, n_gaps: between each two trace points a script of fewest differences.

    Gaps that can meet at no cost do. An alignment reads the tiles of its own stretches only.
    """
    rows = stored(overlaps.withColumn("at", F.monotonically_increasing_id()))
    own = {"a": (F.col("abpos"), F.col("aepos")), "b": _forward("bbpos", "bepos")}
    tiled = tiles(contigs, tile)
    read = [
        read_ranges(rows.select("at", F.lit(s).alias("side"), F.col(f"ctg_{s}").alias("ctg"), x.alias("beg"), y.alias("end")), tiled, tile, ["at", "side"], F.col("beg"), F.col("end"))
        for s, (x, y) in own.items()
    ]
    found = read[0].unionAll(read[1]).groupBy("at").agg(F.collect_list(F.struct("side", "tile", "seq")).alias("read"))
    fields = ["abpos", "aepos", "bbpos", "bepos", "alen", "blen", "comp", "trace"]
    work = rows.select("at", *fields).join(found, "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                a, b = (_stretch(x, s, tile) for s in "ab")
                steps, script = [(t["d"], t["b"]) for t in x["trace"]], []
                i, j = x["abpos"], x["bbpos"]
                for to_i, to_j in [*((p, q) for p, q, _ in trace_points(i, j, steps)), (x["aepos"], x["bepos"])]:
                    part = slice(i - x["abpos"], to_i - x["abpos"]), slice(j - x["bbpos"], to_j - x["bbpos"])
                    for op, n in edit_script(a[part[0]], b[part[1]]):
                        _add(script, op, n)
                    i, j = to_i, to_j
                script = fewer_gaps(script, a, b)
                out.append({"at": x["at"], "script": _as_rows(script), "n_diffs": differences(script), "n_gaps": gaps(script)})
            kind = pa.list_(pa.struct([("op", pa.string()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("at", pa.int64()), ("script", kind), ("n_diffs", pa.int32()), ("n_gaps", pa.int32())]))

    made = work.mapInArrow(run, f"at long, script {_RUNS}, n_diffs int, n_gaps int")
    return rows.join(made, "at").drop("at")


def _forward(beg: str, end: str) -> tuple[Column, Column]:
    turned = lambda x: F.col("blen") - F.col(x)
    return F.when(F.col("comp"), turned(end)).otherwise(F.col(beg)), F.when(F.col("comp"), turned(beg)).otherwise(F.col(end))


def _stretch(x: dict, side: str, tile: int) -> bytes:
    """The aligned bases of a side, in the direction in which they are aligned."""
    parts = Parts([(t["tile"], t["seq"]) for t in x["read"] if t["side"] == side], tile, x[f"{side}len"], turned=side == "b" and x["comp"])
    beg, end = x[f"{side}bpos"], x[f"{side}epos"]
    start, held, _, _ = parts.around(beg, end)
    return np.ascontiguousarray(held[beg - start : end - start]).tobytes()


def printed(scripted: DataFrame, a: str, b: str) -> DataFrame:
    """scripted with three lines of columns for strings a and b: a with gaps as ``-``, marks (``|`` where equal), and b."""
    rows = F.col("script")
    piece = lambda text, skip: F.aggregate(rows, F.struct(F.lit("").alias("s"), F.lit(1).alias("at")), lambda s, r: F.struct(
        F.concat(s["s"], F.when(r["op"] == skip, F.repeat(F.lit("-"), r["n"])).otherwise(F.substring(F.col(text), s["at"], r["n"]))).alias("s"),
        (s["at"] + F.when(r["op"] == skip, 0).otherwise(r["n"])).alias("at")))["s"]
    marks = F.array_join(F.transform(rows, lambda r: F.repeat(F.when(r["op"] == "=", "|").otherwise(" "), r["n"])), "")
    return scripted.withColumn("a_line", piece(a, "I")).withColumn("marks", marks).withColumn("b_line", piece(b, "D"))
