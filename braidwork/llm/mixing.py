"""Mixing sources to target weights: fixed-length blocks, multinomial shards, permuted indices.

The words of a source, document after document, form a stream that is cut into blocks of ``block``
words. Output shards of ``shard`` slots each draw how many slots every source gets from a multinomial
distribution over what the sources have still to give; a source's slots, numbered through all shards,
run through a pseudorandom permutation of its block numbers, a new one for each pass over the source.
Slots and blocks are joined by (source, block number).

Only the table of sources (one row each, ``max_sources`` at most) comes to the driver; the shards are drawn on
the executors, each from a seed of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import small_batches, stored
from ._text import mix

WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64


def word_count(text: str = "text"):
    """Words of a text column as long; null counts as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """share of all sizes dealt by weight; a source stops at most times its size, and what it leaves
    is dealt among the others by weight until none is above."""
    out, free = [0.0] * len(sizes), {k for k, n in enumerate(sizes) if n > 0}
    left = share * sum(sizes)
    while free:
        total = sum(weights[k] for k in free)
        full = {k for k in free if left * weights[k] / total > most * sizes[k]}
        if not full:
            for k in free:
                out[k] = left * weights[k] / total
            break
        for k in full:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in full)
        free -= full
    return out


def permuted(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each seed: four Feistel rounds, walked into range."""
    half = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    mask = (_U(1) << half) - _U(1)
    x, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right, m = x[todo] >> half[todo], x[todo] & mask[todo], mask[todo]
        for r in range(4):
            left, right = right, left ^ (mix(right + seed[todo] + _U((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) & m)
        x[todo] = (left << half[todo]) | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def draw_shards(spark: SparkSession, slots: list[int], shard: int, seed: int) -> DataFrame:
    """(shard, k, first, n): how many slots source k has in a shard, and the number of the first among its own.

    Every shard draws from a multinomial distribution over the slots of the sources, from a seed of its own,
    in whatever task. Prefix sums over the shards number a source's slots; those beyond its share are cut, and
    what a source then lacks fills further shards at the end. So each source has just its slots.
    """
    total, size = sum(slots), np.array(slots, np.int64)
    shards = -(-total // shard)
    held = spark.sparkContext.broadcast(size / max(1, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                rng = np.random.Generator(np.random.PCG64([seed, number]))
                got = rng.multinomial(min(shard, total - number * shard), held.value)
                k = np.flatnonzero(got)
                yield pa.record_batch([pa.array(np.full(len(k), number)), pa.array(k.astype(np.int32)), pa.array(got[k])], ["shard", "k", "n"])

    tasks = max(1, min(shards, 4096))
    drawn = stored(spark.range(0, shards, 1, tasks).mapInArrow(run, "shard long, k int, n long").withColumn("run", F.shiftright("shard", 12)))
    own = spark.createDataFrame([(k, n) for k, n in enumerate(slots) if n] or [], "k int, slots long")
    sums = drawn.groupBy("k", "run").agg(F.sum("n").alias("m"))
    base = F.coalesce(F.sum("m").over(Window.partitionBy("k").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("k", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = drawn.withColumn("inside", inside).join(sums.select("k", "run", base.alias("base")), ["k", "run"]).join(own, "k")
    first = F.col("base") + F.col("inside")
    cut = placed.select("shard", "k", first.alias("first"), F.least("n", F.col("slots") - first).alias("n")).where("n > 0")
    short = own.join(sums.groupBy("k").agg(F.sum("m").alias("got")), "k", "left").select("k", F.coalesce("got", F.lit(0)).alias("got"), "slots").where("got < slots")
    pieces = short.select("k", "slots", F.explode(F.sequence("got", F.col("slots") - 1, F.lit(shard).cast("long"))).alias("first"))
    added = pieces.select((F.lit(shards) + F.col("first") % 64).cast("long").alias("shard"), "k", "first", F.least(F.lit(shard), F.col("slots") - F.col("first")).cast("long").alias("n"))
    return cut.unionAll(added)


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 64, shard: int = 65536, seed: int = 17, max_sources: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """The mix of docs (doc_id, text, source): a table by document, and the plan of slots.

    By document: doc_id, source, size (words; null or blank text: 0), source_size, target (its
    source's words in the mix, a double), taken (words of it in the mix, repeats counted). Sources are
    ordered by code point, null last, and take the weights in turn. Rows that repeat a doc_id are
    documents of their own. A slot: shard, slot, k (the source), block; block b of a source is the words
    [b * w, (b + 1) * w) of its stream, w being ``block``, or less in a source of under 64 such blocks.
    No block is used more often than ``most`` rounded up. Without words nothing is taken. Reruns agree,
    however the rows are dealt to files and tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    sized = stored(sized.withColumn("part", F.pmod("h", F.lit(4096)).cast("int")))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("words"))
    table = parts.groupBy("source").agg(F.sum("words").alias("words")).limit(max_sources + 1).collect()
    if len(table) > max_sources:
        raise ValueError(f"more than {max_sources} sources: raise max_sources or group them first")
    table.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    names, sizes = [r["source"] for r in table], [r["words"] for r in table]
    aims = targets(sizes, [weights[k % len(weights)] for k in range(len(names))], share, most)
    wide = [max(1, min(block, n // 64)) for n in sizes]
    blocks = [-(-n // w) for n, w in zip(sizes, wide, strict=True)]
    slots = [min(int(most * b), round(a / n * b)) if n else 0 for a, n, b in zip(aims, sizes, blocks, strict=True)]
    sources = spark.createDataFrame(list(zip(range(len(names)), names, sizes, aims, blocks, wide, strict=True)), "k int, source string, source_size long, target double, blocks long, wide long")

    # where each document starts in its source's stream: sums of parts first, then within a part
    before = F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("size").over(Window.partitionBy("source", "part").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1))
    offset = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("base"))
    placed = sized.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offset, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    placed = placed.withColumn("start", F.col("base") + F.col("inside")).join(F.broadcast(sources.withColumnRenamed("source", "s2")) if len(names) <= 10_000 else sources.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")))
    placed = stored(placed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "k", "size", "source_size", "target", "start", "wide"))

    span = F.expr("sequence(start div wide, (start + size - 1) div wide)")
    pieces = placed.where("size > 0").select("row", "k", "start", "size", "wide", F.explode(span).alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("wide")) - F.greatest("start", F.col("block") * F.col("wide"))
    pieces = pieces.select("row", "k", "block", words.alias("words"))

    few = len(names) <= 10_000
    draws = draw_shards(spark, slots, shard, seed)
    draws = draws.join(F.broadcast(sources.select("k", "blocks")) if few else sources.select("k", "blocks"), "k")
    # numbered in as many tasks as the slots need, whatever adaptive execution makes of so few rows
    draws = draws.repartition(max(1, min(100_000, sum(slots) // 200_000 + 1)), "shard", "k")
    numbered = draws.select("shard", "k", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard_, k, n, slot = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4))
            with np.errstate(over="ignore"):
                key = mix(k.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F) + (slot // n).astype(np.uint64) + _U(seed))
                at = permuted(slot % n, n, key)
            yield pa.record_batch([pa.array(shard_), pa.array(slot), pa.array(k.astype(np.int32)), pa.array(at)], ["shard", "slot", "k", "block"])

    plan = numbered.mapInArrow(place, "shard long, slot long, k int, block long")
    used = plan.groupBy("k", "block").agg(F.count("*").alias("times"))
    taken = pieces.join(used, ["k", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    by_doc = placed.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return by_doc, plan
