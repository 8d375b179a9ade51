"""Collocated phrases of two and three words, from depth-truncated suffix subtrees built group by group.

Suffixes of pieces of text are cut to three words; their trie has words at depth 1, pairs at 2 and triples at 3, and the
total of the leaves below a node is how often its words occur. The trie is partitioned vertically by prefix:

1. Words are counted. A phrase that occurs ``least`` times is made of words that do, so only those are prefixes; a bit
   set of their hashes tells most others off.
2. Pairs are counted by 64-bit hash. Those of ``least`` or more are the prefixes that are extended (again a bit set; a
   hash or bit shared with a rarer pair costs work, not results). Their counts weigh the prefixes.
3. Prefixes are put into groups of at most ``budget`` suffixes: first words (by bucket) as long as they fit, those that
   don't by their pairs, and those of a pair that doesn't by their third words. A group goes to one task, which builds
   its subtree from its suffixes alone: leaves with totals, and from these the pairs above them.

Weights are occurrences, so what a task holds has a bound; each read of the texts counts equal suffixes together first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import small_batches, stored
from ._text import BYTE_HASH, STEP, chunks, mix, prefix_hash, runs, span_hash

PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAK = PIECE.copy()
BREAK[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BUCKETS, FINE = 1 << 12, 1 << 6  # of first words, and of the pairs of each
READ = 1 << 20  # bytes of text counted at a time
_U = np.uint64


class Suffixes:
    """The words of a run of rows and the hashes of (language, word); next1, next2: whether a piece goes on after each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lang: np.ndarray):
        self.data = LOWER[data]
        self.start, self.end = runs(self.data, offs, BREAK)
        n = len(self.start)
        row = np.searchsorted(offs, self.start, "right") - 1
        self.lang = lang[row] if n else np.zeros(0, _U)
        self.row = row
        self.key = mix(span_hash(prefix_hash(self.data, BYTE_HASH), self.start, self.end) + self.lang * STEP)
        ends = np.concatenate([[0], np.cumsum(PIECE[self.data])])
        self.next1, self.next2 = np.zeros(n, bool), np.zeros(n, bool)
        self.next1[:-1] = (ends[self.start[1:]] == ends[self.end[:-1]]) & (row[1:] == row[:-1])
        self.next2[:-1] = self.next1[:-1] & self.next1[1:]

    def words(self) -> pa.DictionaryArray:
        at = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(at), pa.py_buffer(self.data[~BREAK[self.data]])).dictionary_encode()

    def pairs(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs of words that are both in the bit set, and the pairs' hashes."""
        ok = _among(frequent, self.key)
        at = np.flatnonzero(self.next1[:-1] & ok[:-1] & ok[1:]) if len(ok) else np.zeros(0, np.int64)
        return at, mix(self.key[at] * STEP + self.key[at + 1])


def _among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> _U(64 - (len(bits) * 64).bit_length() + 1)
    return (bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)).astype(bool)


def _bit_set(hashes: DataFrame, log_bits: int) -> np.ndarray:
    """Which of 2 ** log_bits places the hashes (one column, long) begin with; at most that many bits reach the driver."""
    place = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - log_bits)
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    rows = hashes.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (log_bits - 6), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(_U)


def _hash_of(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Suffixes, pa.Array]]:
    """Runs of rows (lang, text), with the languages of the rows."""
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        hashes = np.array([_hash_of(x) for x in lang.dictionary.to_pylist()], _U)
        for a, b, data, offs in chunks(batch.column(1), READ):
            yield Suffixes(data, offs, hashes[lang.indices.to_numpy()[a:b]]), batch.column(0).slice(a, b - a)


def _counted(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first, n): the first row of each distinct row of columns of numbers under sizes, and how many there are."""
    key = columns[0]
    for column, size in zip(columns[1:-1], sizes[1:-1], strict=True):
        key = np.unique(key * size + column, return_inverse=True)[1]
    _, first, n = np.unique(key * sizes[-1] + columns[-1], return_index=True, return_counts=True)
    return first, n


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, hash, n) of rows (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, lang in _read(batches):
            words, langs = found.words(), lang.dictionary_encode()
            code = words.indices.to_numpy().astype(np.int64)
            first, n = _counted([langs.indices.to_numpy().astype(np.int64)[found.row], code], [0, len(words.dictionary) + 1])
            yield pa.record_batch([lang.take(pa.array(found.row[first])), words.dictionary.take(pa.array(code[first])).cast(pa.string()), pa.array(found.key[first].view(np.int64)), pa.array(n)], ["lang", "word", "hash", "n"])

    return rows.mapInArrow(count, "lang string, word string, hash long, n long").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def pair_counts(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(hash, bucket, n) of the pairs of words in the bit set; bucket is of the first word and the pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, _ in _read(batches):
            at, pair = found.pairs(frequent)
            pair, first, n = np.unique(pair, return_index=True, return_counts=True)
            yield pa.record_batch([pa.array(pair.view(np.int64)), pa.array(_bucket(found.key[at[first]], pair)), pa.array(n)], ["hash", "bucket", "n"])

    return rows.mapInArrow(count, "hash long, bucket int, n long").groupBy("hash", "bucket").agg(F.sum("n").alias("n"))


def _bucket(word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return (word % _U(BUCKETS) * _U(FINE) + pair % _U(FINE)).astype(np.int32)


def group_prefixes(weight: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, parts) by bucket, given the suffixes of each: buckets of a first word stay together where they fit.

    Units are taken as they come, and a group is closed when the next would pass the budget. A bucket that passes it
    alone has as many groups as it needs for its third words, from group on.
    """
    group, parts, at, held = np.zeros(len(weight), np.int64), np.ones(len(weight), np.int64), 0, 0
    for word in range(BUCKETS):
        mine = range(word * FINE, (word + 1) * FINE)
        for unit in [mine] if weight[mine].sum() <= budget else [range(k, k + 1) for k in mine]:
            w = int(weight[unit].sum())
            if w > budget:
                at, held = at + (held > 0), 0
                group[unit], parts[unit] = at, -(-w // budget)
                at += int(parts[unit][0])
            elif w:
                if held + w > budget:
                    at, held = at + 1, 0
                group[unit], held = at, held + w
    return group, parts


def subtree(suffixes: pa.Table, least: int) -> pa.Table:
    """The nodes of depth 2 and 3 of a group's suffixes (w3 null where a piece ends or goes on with a rare word).

    Nodes of pairs whose third words are dealt over groups (part is then set) are given whatever their totals.
    """
    leaves = suffixes.group_by(["lang", "w1", "w2", "w3"]).aggregate([("n", "sum"), ("whole", "min")])
    inner = leaves.group_by(["lang", "w1", "w2"]).aggregate([("n_sum", "sum"), ("whole_min", "min")])
    inner = inner.filter(pc.or_(pc.greater_equal(inner["n_sum_sum"], least), pc.invert(inner["whole_min_min"])))
    leaves = leaves.filter(pc.and_(pc.is_valid(leaves["w3"]), pc.greater_equal(leaves["n_sum"], least)))
    pairs = pa.table([inner["lang"], inner["w1"], inner["w2"], pa.nulls(len(inner), pa.string()), inner["n_sum_sum"]], ["lang", "w1", "w2", "w3", "a"])
    triples = pa.table([leaves["lang"], leaves["w1"], leaves["w2"], leaves["w3"], leaves["n_sum"]], ["lang", "w1", "w2", "w3", "a"])
    return pa.concat_tables([pairs, triples])


def phrase_counts(rows: DataFrame, words: np.ndarray, pairs: np.ndarray, weight: np.ndarray, *, least: int, budget: int) -> DataFrame:
    """(lang, w1, w2, w3, a): pairs (w3 null) and triples of words that occur least times; step 3 of the module."""
    group, parts = group_prefixes(weight, budget)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, lang in _read(batches):
            at, pair = found.pairs(words)
            ok = _among(pairs, pair)
            at, pair = at[ok], pair[ok]
            text, langs = found.words(), lang.dictionary_encode()
            code = np.append(text.indices.to_numpy().astype(np.int64), [0, 0])
            extended = np.zeros(len(found.start) + 1, bool)
            extended[at] = True  # a triple's second pair must be frequent, too
            third = np.where(found.next2[at] & extended[at + 1], code[at + 2] + 1, 0)
            many = len(text.dictionary) + 1
            first, n = _counted([langs.indices.to_numpy().astype(np.int64)[found.row[at]], code[at], code[at + 1], third], [0, many, many, many])
            at, pair, third = at[first], pair[first], third[first]
            bucket = _bucket(found.key[at], pair)
            last = mix(pair + (third > 0) * found.key[np.minimum(at + 2, len(found.key) - 1)]) if len(at) else pair
            mine = group[bucket] + (last % parts[bucket].astype(_U)).astype(np.int64)
            pick = [text.dictionary.take(pa.array(x)).cast(pa.string()) for x in (code[at], code[at + 1])]
            w3 = text.dictionary.take(pa.array(third - 1, mask=third == 0)).cast(pa.string())
            yield pa.record_batch([pa.array(mine), pa.array(parts[bucket] == 1), lang.take(pa.array(found.row[at])), *pick, w3, pa.array(n)], ["grp", "whole", "lang", "w1", "w2", "w3", "n"])

    suffixes = rows.mapInArrow(cut, "grp long, whole boolean, lang string, w1 string, w2 string, w3 string, n long")

    def build(table: pa.Table) -> pa.Table:
        return subtree(table.drop_columns(["grp"]), least)

    nodes = suffixes.groupBy("grp").applyInArrow(build, "lang string, w1 string, w2 string, w3 string, a long")
    return nodes.groupBy("lang", "w1", "w2", "w3").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _score(left: Column, right: Column) -> Column:
    """floor(10 ** 6 * a * a / (left * right)), in decimals that hold the products of counts under 10 ** 15."""
    a, b, c = (x.cast("decimal(15,0)") for x in (F.col("a"), left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, b * c)


def mine_phrases(docs: DataFrame, *, least: int = 10, absorb: int = 50, top: int = 2000, budget: int = 1 << 18, log_words: int = 24, log_pairs: int = 26) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the top phrases of two and three words of each language.

    A-Z count as a-z; pieces end at .,;:!? and line ends, words at spaces and tabs. A null lang is ``und``; null and empty
    texts have no words; other columns of docs are left out. a is how often a phrase occurs, l and r how often the parts
    do at the cut that scores least (ties: the first), n the words of the language. A pair goes if a triple with it occurs
    absorb or more times in 100 of its own. Ties of score go by a, then by phrase. Rows that repeat count as often as they
    stand. The bit sets, 2 ** log_words and 2 ** log_pairs bits, and the weights of BUCKETS x FINE prefixes are what
    passes through the driver; see the module.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = stored(word_counts(rows))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    words = words.where(F.col("n") >= least)
    frequent = _bit_set(words.select("hash"), log_words)
    pairs = stored(pair_counts(rows, frequent).where(F.col("n") >= least))
    weight = np.zeros(BUCKETS * FINE, np.int64)
    found = pairs.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    weight[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    counts = stored(phrase_counts(rows, frequent, _bit_set(pairs.select("hash"), log_pairs), weight, least=least, budget=budget))

    def times(x: str, of: str) -> DataFrame:
        return words.select("lang", F.col("word").alias(x), F.col("n").alias(of))

    def times2(x: str, y: str, of: str) -> DataFrame:
        return counts.where("w3 is null").select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(of))

    two = counts.where("w3 is null").drop("w3").join(times("w1", "l"), ["lang", "w1"]).join(times("w2", "r"), ["lang", "w2"])
    three = counts.where("w3 is not null")
    longer = three.select("lang", "a", F.inline(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))))
    longer = longer.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longest"))
    two = two.join(longer, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("longest") < absorb * F.col("a"), F.lit(True)))
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score(F.col("l"), F.col("r")).alias("score"))
    three = three.join(times("w1", "l1"), ["lang", "w1"]).join(times2("w2", "w3", "r1"), ["lang", "w2", "w3"])
    three = three.join(times2("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(times("w3", "r2"), ["lang", "w3"])
    three = three.withColumn("s1", _score(F.col("l1"), F.col("r1"))).withColumn("s2", _score(F.col("l2"), F.col("r2")))
    first = F.col("s1") <= F.col("s2")
    cut = [F.when(first, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(n) for c, n in (("l", "l"), ("r", "r"), ("s", "score"))]
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", *cut)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
