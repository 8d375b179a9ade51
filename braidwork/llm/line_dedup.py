"""Line dedup: later documents lose the blocks that a patience alignment shares with an earlier one.

Documents with equal lines throughout are one class, led by the smallest doc_id; the others lose all
their lines. Between classes, a document's partners are the earliest documents that hold its shared
lines, however many others hold them: one partner a line at most, so no group is paired out.
The pair is aligned by patience diff: lines that occur once on either side anchor the longest chain of
matches in order, and matches grow from the anchors line by line. The gaps are aligned in the same way,
until they share no line; in a gap whose shared lines all repeat, equal lines are matched by how often
they stood before in it. Aligned lines are deleted.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import only, small_batches, stored
from ._text import BYTE_HASH, SPACE, chunks, mix, prefix_hash, runs, span_hash

_BREAK = np.zeros(256, bool)
_BREAK[10] = True


def line_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The hashes of the lines of each row; a line without a word has hash 0."""
    for i, j, data, offs in chunks(column):
        run = prefix_hash(data, BYTE_HASH)
        start, end = runs(data, offs, _BREAK)
        words = np.concatenate([[0], np.cumsum(~SPACE[data])])
        hashes = np.where(words[end] > words[start], span_hash(run, start, end), 0)
        # empty lines stand between breaks: a row has one line more than it has breaks
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        line = breaks[start] if len(start) else np.zeros(0, np.int64)
        first = np.searchsorted(start, offs)
        for row in range(i, j):
            a, b = offs[row - i], offs[row - i + 1]
            out = np.zeros(int(breaks[b] - breaks[a]) + (b > a), np.uint64)
            x, y = first[row - i], first[row - i + 1]
            out[line[x:y] - breaks[a]] = hashes[x:y]
            yield row, out


def _chain(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The longest chain of lines that occur once in either, or of the n-th occurrences of equal lines if there are none."""
    once_a, once_b = Counter(a), Counter(b)
    where = {x: k for k, x in enumerate(a) if once_a[x] == 1}
    pairs = [(where[x], k) for k, x in enumerate(b) if x and once_b[x] == 1 and x in where]
    if not pairs:
        places: dict[int, list[int]] = {}
        for k, x in enumerate(a):
            if x and x in once_b:
                places.setdefault(x, []).append(k)
        seen: Counter = Counter()
        for k, x in enumerate(b):
            if seen[x] < len(places.get(x, ())):
                pairs.append((places[x][seen[x]], k))
                seen[x] += 1
    tails: list[int] = []
    best: list[int] = []
    back = [-1] * len(pairs)
    for k, (x, _) in enumerate(pairs):
        at = bisect_left(tails, x)
        back[k] = best[at - 1] if at else -1
        if at == len(tails):
            tails.append(x)
            best.append(k)
        else:
            tails[at], best[at] = x, k
    chain, k = [], best[-1] if best else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    chain.reverse()
    return chain


def patience(a: list[int], b: list[int]) -> list[int]:
    """Positions of b aligned with equal lines of a; zeros (blank lines) don't align by themselves."""
    out, todo = set(), [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        chain = [(a0 + x, b0 + y) for x, y in _chain(a[a0:a1], b[b0:b1])]
        low = (a0 - 1, b0 - 1)
        for n, (x, y) in enumerate(chain):
            high = chain[n + 1] if n + 1 < len(chain) else (a1, b1)
            i, j = x - 1, y - 1
            while i > low[0] and j > low[1] and a[i] == b[j]:
                out.add(j)
                i, j = i - 1, j - 1
            todo.append((low[0] + 1, i + 1, low[1] + 1, j + 1))
            out.add(y)
            i, j = x + 1, y + 1
            while i < high[0] and j < high[1] and a[i] == b[j]:
                out.add(j)
                i, j = i + 1, j + 1
            low = (i - 1, j - 1)
        if chain:
            todo.append((low[0] + 1, a1, low[1] + 1, b1))
    return sorted(out)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_lines, drop array<int>): the lines of each row of docs (row, doc_id, text) to delete.

    row tells the rows apart, and must be the same each time docs is read. Lines are split at \\n and
    compared byte for byte. Null and empty texts have no lines. Of rows that repeat a doc_id, the one of
    larger row counts as the later document. Blank lines go only with the aligned lines around them. A
    null doc_id comes first. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [x.view(np.int64) for _, x in line_hashes(batch.column(2))]
            whole = [int(mix(np.array([x.view(np.uint64).dot(mix(np.arange(len(x), dtype=np.uint64)) | np.uint64(1)) + np.uint64(len(x))], np.uint64)).view(np.int64)[0]) if len(x) else 0 for x in lines]
            offs = np.cumsum([0, *map(len, lines)])
            flat = np.concatenate(lines) if lines else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(whole, pa.int64()), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat))], ["row", "doc_id", "whole", "lines"])

    table = stored(docs.select("row", F.col("doc_id").cast("long"), "text").mapInArrow(read, "row long, doc_id long, whole long, lines array<long>"))
    order = F.struct("doc_id", "row")
    # stored, so that adaptive execution can split the join at a very large class
    lead = stored(table.where(F.size("lines") > 0).groupBy("whole").agg(F.min(order).alias("lead")))
    led = stored(table.where(F.size("lines") > 0).join(lead, "whole").withColumn("first", F.col("lead.row") == F.col("row")))
    leaders = led.where("first").select("row", "doc_id", "lines")

    occur = leaders.select("row", "doc_id", F.explode(F.array_distinct("lines")).alias("line")).where("line <> 0")
    # stored, so that adaptive execution can split the join at a very common line
    held = stored(occur.groupBy("line").agg(F.count("*").alias("df"), F.min(order).alias("lead")).where("df > 1").select("line", F.col("lead.row").alias("partner")))
    pairs = stored(occur.select("row", "line").join(held, "line").where("partner <> row").select("row", "partner").distinct())
    later = only(leaders.select("row", F.col("lines").alias("later")), pairs.select("row"), "row")
    earlier = only(leaders.select(F.col("row").alias("partner"), F.col("lines").alias("earlier")), pairs.select("partner"), "partner")
    # merged by key at every size: the arrays are too many to broadcast, however few they are in a small table
    both = pairs.hint("merge").join(later, "row").hint("merge").join(earlier, "partner")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            later, earlier = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([patience(x, y) for x, y in zip(earlier, later, strict=True)], pa.list_(pa.int32()))], ["row", "drop"])

    found = both.select("row", "later", "earlier").mapInArrow(align, "row long, drop array<int>")
    gone = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("drop")))).alias("drop"))
    copies = led.where("not first").select("row", F.sequence(F.lit(0), F.size("lines") - 1).alias("drop"))
    none = F.array().cast("array<int>")
    return table.select("row", "doc_id", F.size("lines").alias("n_lines")).join(gone.unionAll(copies), "row", "left").withColumn("drop", F.coalesce("drop", none))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines cut out of text, and n_lines, n_removed (null text stays null).

    Columns of these two names are replaced; all others stay, but none may begin with ``braid_``. A document that
    loses all its lines keeps its row with an empty text. See repeated_lines for what is cut.
    """
    # stored with a number for each row, by which the decision goes back: a doc_id may repeat
    mine = stored(docs.withColumn("braid_row", F.monotonically_increasing_id()))
    decided = repeated_lines(mine.select(F.col("braid_row").alias("row"), "doc_id", "text")).where(F.size("drop") > 0)
    decided = stored(decided.select(F.col("row").alias("braid_row"), F.col("drop").alias("braid_drop")))
    # only the texts of rows that lose lines are shuffled
    cut = only(mine, decided.select("braid_row"), "braid_row").hint("merge").join(decided, "braid_row")
    whole = only(mine, decided.select("braid_row"), "braid_row", out=True).withColumn("braid_drop", F.lit(None).cast("array<int>"))
    lines = F.when(F.length("text") > 0, F.split("text", "\n", -1)).otherwise(F.array().cast("array<string>"))
    keep = F.filter(lines, lambda _, k: ~F.array_contains("braid_drop", k))
    text = F.when(F.col("text").isNull() | F.col("braid_drop").isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    made = (text.alias("text"), F.size(lines).alias("n_lines"), F.coalesce(F.size("braid_drop"), F.lit(0)).alias("n_removed"))
    return cut.select(*columns, *made).unionByName(whole.select(*columns, *made))
