"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are signs of the centred vectors after a learned rotation (PCA, then the rotation that brings the
sample nearest to the corners of the cube). A code's substrings are indexed, each by its value. A code
within Hamming radius r of a query's agrees with it in some substring up to r / substrings bits, so
probing each index with all values that near finds every such code; these are reranked by their floats.

The radius is what holds ``aim`` of the nearest among the sample, as many as k of all rows come to there. Rows and queries are dealt to blocks of
bounded size, and every block of queries meets every block of rows in a task of its own, which indexes the rows
once for all the queries. Sample and rotation are all the driver holds; queries never pass through it.

How much probing spares depends on the data: ``probe_report`` measures it. Of vectors without any structure in 64
dimensions the nearest ten lie so far out that the radius takes in a good part of all codes, whatever the index.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import small_batches

PART = 16  # bits of a substring


@dataclass
class Codes:
    mean: np.ndarray
    turn: np.ndarray  # dimensions x bits
    radius: int

    @property
    def parts(self) -> int:
        return self.turn.shape[1] // PART

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Substring values, rows x parts."""
        bits = ((vectors - self.mean) @ self.turn > 0).reshape(len(vectors), self.parts, PART)
        return (bits @ (1 << np.arange(PART))).astype(np.uint16)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def fit_codes(sample: np.ndarray, bits: int = 64, *, k: int = 10, aim: float = 0.97, probes: int = 200, seed: int = 3) -> Codes:
    """Learn the rotation and the radius from a sample (rows x dimensions)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    mean = sample.mean(axis=0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x, full_matrices=True)
    axes = axes[:bits].T
    if axes.shape[1] < bits:  # fewer dimensions than bits: random directions fill up
        axes = np.hstack([axes, rng.normal(size=(x.shape[1], bits - axes.shape[1]))])
    low = x @ axes
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(30):
        u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
        turn = (u @ v).T
    codes = Codes(mean, axes @ turn, 0)
    packed, near = codes.encode(sample), []
    for q in rng.permutation(len(sample))[:probes]:
        d = ((sample - sample[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        near.append(hamming(packed[np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]], packed[q]))
    far = np.concatenate(near) if near else np.zeros(0)
    codes.radius = int(np.quantile(far, aim)) if len(far) else 0
    return codes


def _flips(most: int) -> np.ndarray:
    """All substring values with at most that many bits."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(PART), n)], np.uint16)


class SubstringIndex:
    """One table of positions by substring value for each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.first = [np.searchsorted(c[o], np.arange((1 << PART) + 1)) for c, o in zip(codes.T, self.order, strict=True)]

    def within(self, code: np.ndarray, radius: int, flips: dict[int, np.ndarray]) -> np.ndarray:
        """Positions of all codes within radius."""
        near = np.flatnonzero(self.probed(code, radius, flips))
        return near[hamming(self.codes[near], code) <= radius]

    def probed(self, code: np.ndarray, radius: int, flips: dict[int, np.ndarray]) -> np.ndarray:
        """Which positions the probes visit. Of m substrings, radius % m + 1 are probed up to radius // m bits
        and the others one bit less: a code that misses all is farther."""
        m, hit = len(self.order), np.zeros(len(self.codes), bool)
        for k in range(m):
            most = radius // m - (k > radius % m)
            if most < 0:
                continue
            values = flips[most] ^ code[k]
            lo, hi = self.first[k][values], self.first[k][values.astype(np.int64) + 1]
            some = hi > lo
            lo, n = lo[some], (hi - lo)[some]
            hit[self.order[k][np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        return hit


def probe_report(vectors: np.ndarray, queries: np.ndarray, codes: Codes) -> dict[str, float]:
    """Mean shares of all rows that the probes visit and that lie within the radius, over the queries."""
    index, flips = SubstringIndex(codes.encode(vectors)), _all_flips(codes)
    shares = [(index.probed(c, codes.radius, flips).mean(), (hamming(index.codes, c) <= codes.radius).mean()) for c in codes.encode(queries)]
    probed, near = np.mean(shares, axis=0)
    return {"radius": codes.radius, "bits": codes.parts * PART, "probed": float(probed), "within": float(near)}


def _all_flips(codes: Codes) -> dict[int, np.ndarray]:
    return {n: _flips(n) for n in range(codes.radius // codes.parts + 1)}


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their vectors as doubles: of the given size, finite and not zero."""
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    rows = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
    good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
    return rows[good], flat[good]


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, *, k: int = 10, bits: int = 64, sample_rows: int = 5000, aim: float = 0.97, row_block: int = 65536, query_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of vectors for each query, by Euclidean distance.

    vectors and queries: (vec_id, embedding). A query's own vec_id is not its candidate. Null and zero
    vectors, those with a null or non-finite component and those of another size than most take no part.
    Ties go to the smaller vec_id; rows that repeat a vec_id count as one candidate, the nearest of them, and as
    one query, the least of them. A query that has fewer codes than k within the radius takes the next nearest
    codes, so it gets k if there are k. Empty tables give no rows; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    named = lambda rows: rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    rows = named(vectors)
    size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], schema)
    number, size = size["count"], size["n"]
    fits = rows.where(F.size("embedding") == size)
    picked = fits.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id", F.hash("embedding")).limit(sample_rows).toPandas()["embedding"]
    sample = np.array([np.asarray(x, np.float64) for x in picked]) if len(picked) else np.zeros((0, size))
    sample = sample[np.isfinite(sample).all(axis=1) & (sample != 0).any(axis=1)]
    if not len(sample):
        return spark.createDataFrame([], schema)
    # the k nearest of all rows are about so many of the sample, which is the thinner
    codes = fit_codes(sample, bits, k=max(1, round(k * len(sample) / number)), aim=aim)
    asked = named(queries).where(F.size("embedding") == size).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # at least 4096 rows a block, so that an index is worth its while, and some tasks for small tables too
    own_blocks = max(-(-number // row_block), min(64, -(-number // 4096)))
    ask_blocks = max(1, -(-asked.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # equal rows are one candidate, and rows are dealt by what they hold, so that a task run again deals them alike
    left = fits.distinct().withColumn("own", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(own_blocks)).cast("int")).withColumn("ask", every(ask_blocks))
    right = asked.withColumn("ask", F.pmod(F.xxhash64("vec_id"), F.lit(ask_blocks)).cast("int")).withColumn("own", every(own_blocks))
    held = spark.sparkContext.broadcast(codes)

    def search(mine: pa.Table, sought: pa.Table) -> pa.Table:
        return _nearest_in_block(mine, sought, held.value, size, k)

    met = left.groupBy("own", "ask").cogroup(right.groupBy("own", "ask")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    met = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _nearest_in_block(mine: pa.Table, sought: pa.Table, codes: Codes, size: int, k: int) -> pa.Table:
    """The k nearest of a block of rows for each query of a block (tables with vec_id and embedding)."""
    column = lambda t, c: t.column(c).combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type)
    at, vectors = _vectors(column(mine, "embedding"), size)
    ask, query = _vectors(column(sought, "embedding"), size)
    if not len(at) or not len(ask):
        return _FOUND.empty_table()
    names, ids = (column(t, "vec_id").to_numpy(zero_copy_only=False)[rows] for t, rows in ((mine, at), (sought, ask)))
    index, flips, out = SubstringIndex(codes.encode(vectors)), _all_flips(codes), []
    for q, code in enumerate(codes.encode(query)):
        near = index.within(code, codes.radius, flips)
        near = near[names[near] != ids[q]]
        if len(near) < k or len(np.unique(names[near])) < k:  # fewer in the radius: the next nearest codes of this block
            others = np.flatnonzero(names != ids[q])
            others, n = others[np.argsort(hamming(index.codes[others], code), kind="stable")], 4 * k
            near = others[:n]
            while n < len(others) and len(np.unique(names[near])) < k:  # rows that repeat a vec_id are one candidate
                n *= 2
                near = others[:n]
        score, top, seen = np.sqrt(((vectors[near] - query[q]) ** 2).sum(axis=1)), [], set()
        for x in np.lexsort((names[near], score)):
            if names[near[x]] not in seen:
                seen.add(names[near[x]])
                top.append((ids[q], names[near[x]], score[x]))
            if len(top) == k:
                break
        out += top
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _FOUND.types, strict=True)], schema=_FOUND) if out else _FOUND.empty_table()
