"""LM scoring: class-based bigrams over classes found by exchange clustering (Brown et al. 1992).

Every word of the training texts gets a class:

* the ``units`` most frequent words by exchange clustering proper, which moves words between classes while the
  mutual information of adjacent classes grows; it sees their counts of adjacency, (1 + units)**2 numbers at most;
* all others in Spark, each by its own contexts: a word moves to the class that gains most mutual information from
  the counts of the classes beside it, the classes of the frequent words being settled.

P(word | before) = P(class | class before) * P(word | class). Class transitions are Witten-Bell mixtures with the
classes' own frequencies; a class emits its words by count + 0.1. Words not seen in training are one more word of
the class that holds most words seen once. Counts, contexts and transitions cover every training text. The
``frequent`` most frequent words are broadcast with their counts and classes; other words get theirs by joins on
the word's 64-bit hash, which stands for the word throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches, stored
from ._text import Words, chunks

END = 0  # the end of a text, as a word; its class is 0 too
ADD = 0.1
_U = np.uint64
BEFORE, AFTER, PAIR, KNOWN = range(4)  # kinds of adjacency: a known value before a word, after it, two words, two known values


@dataclass
class ClassModel:
    words: np.ndarray  # hashes of frequent words, sorted
    counts: np.ndarray
    class_of: np.ndarray  # of each frequent word
    transition: np.ndarray  # log10 P(class | class before)
    emit: np.ndarray  # log10 of the denominator of P(word | class)
    tokens: int
    distinct: int
    end_count: int
    unseen: int  # the class of words that weren't seen


def word_counts(texts: DataFrame, hold: int = 1_000_000) -> DataFrame:
    """(word, n) of all words of texts (text) and of the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            uniq, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return uniq, np.bincount(back, np.concatenate([x[1] for x in held]), len(uniq)).astype(np.int64)

        for batch in batches:
            ends += len(batch)
            for _, _, data, offs in chunks(batch.column(0)):
                held.append(np.unique(Words(data, offs).hash, return_counts=True))
                size += len(held[-1][0])
            if size > hold:
                held = [merged()]
                size = len(held[0][0])
                if size > hold // 2:
                    yield _counted(*held.pop())
                    size = 0
        if held:
            yield _counted(*merged())
        if ends:
            yield _counted(np.zeros(1, np.uint64), np.array([ends]))

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def _lookup(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of hashes in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, -1)


def _line(words: Words, value: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the words of each text in one line, with an end after each text; and where the words stand in it."""
    n = np.diff(words.first)
    inner = np.ones(len(value) + len(n), bool)
    inner[words.first[1:] + np.arange(len(n))] = False
    line = np.full(len(inner), end, value.dtype)
    line[inner] = value
    return line, np.flatnonzero(inner)


def adjacency(texts: DataFrame, table: np.ndarray, value: np.ndarray, total: int, kinds: tuple[int, ...], hold: int = 1_000_000) -> DataFrame:
    """(kind, a, b, n): how often words and known values stand side by side in texts (text).

    table: sorted hashes of the words with a known value, value: their values, from 1 to total - 1; an end, before
    the first and after the last word of a text, is the known value 0. BEFORE: value a before word b; AFTER: word a
    before value b; PAIR: words a and b; KNOWN: values a and b.
    """
    held_ = texts.sparkSession.sparkContext.broadcast((table, value.astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = held_.value
        sums = np.zeros(total * total if KNOWN in kinds else 0, np.int64)
        held, size = [], 0

        def merged() -> tuple[np.ndarray, ...]:
            kind, a, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((b, a, kind))
            kind, a, b, n = kind[order], a[order], b[order], n[order]
            new = np.ones(len(a), bool)
            new[1:] = (kind[1:] != kind[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(new)
            return kind[at], a[at], b[at], np.add.reduceat(n, at) if len(at) else n

        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                words = Words(data, offs)
                at = _lookup(known, words.hash)
                line, place = _line(words, np.where(at >= 0, number[at] if len(number) else 0, -1), 0)
                hashes = np.zeros(len(line), np.int64)
                hashes[place] = words.hash.view(np.int64)
                before, left = np.concatenate([[0], line[:-1]]), np.concatenate([[0], hashes[:-1]])
                a_known, b_known = before >= 0, line >= 0
                if KNOWN in kinds:
                    both = a_known & b_known
                    sums += np.bincount(before[both] * total + line[both], minlength=total * total)
                for kind, pick, a, b in ((BEFORE, a_known & ~b_known, before, hashes), (AFTER, ~a_known & b_known, left, line), (PAIR, ~a_known & ~b_known, left, hashes)):
                    if kind in kinds:
                        k = np.flatnonzero(pick)
                        held.append((np.full(len(k), kind, np.int8), a[k], b[k], np.ones(len(k), np.int64)))
                        size += len(k)
            if size > hold:
                held = [merged()]
                size = len(held[0][0])
                if size > hold // 2:
                    yield _adjacent(*held.pop())
                    size = 0
        if held:
            yield _adjacent(*merged())
        at = np.flatnonzero(sums)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield _adjacent(np.full(len(part), KNOWN, np.int8), part // total, part % total, sums[part])

    return texts.mapInArrow(run, "kind byte, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def _adjacent(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in columns], ["kind", "a", "b", "n"])


def exchange(counts: np.ndarray, classes: int, sweeps: int = 6) -> np.ndarray:
    """Classes of units by exchange clustering of adjacent counts (units x units); unit 0 keeps class 0."""
    units = len(counts)
    seen = counts.sum(axis=1) + counts.sum(axis=0)
    order = np.argsort(-seen[1:], kind="stable") + 1
    cls = np.zeros(units, np.int64)
    cls[order] = 1 + np.arange(units - 1) % max(1, classes - 1)
    one = np.zeros((units, classes))
    one[np.arange(units), cls] = 1
    pair = one.T @ counts @ one
    right, left = counts @ one, counts.T @ one  # of each unit: counts by the class after and before
    h = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not seen[w] or classes < 3:
                continue
            a, own = cls[w], counts[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= own
            l[a] -= own
            pair[a, :] -= r
            pair[:, a] -= l
            pair[a, a] -= own
            rows, cols = h(pair + r) - h(pair), h(pair + l[:, None]) - h(pair)
            both = np.diag(pair)
            gain = rows.sum(axis=1) - np.diag(rows) + cols.sum(axis=0) - np.diag(cols) + h(both + r + l + own) - h(both)
            after, before = pair.sum(axis=1), pair.sum(axis=0)
            gain -= h(after + r.sum() + own) - h(after) + h(before + l.sum() + own) - h(before)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            pair[b, :] += r
            pair[:, b] += l
            pair[b, b] += own
            if b != a:
                cls[w] = b
                right[:, a] -= counts[:, w]
                right[:, b] += counts[:, w]
                left[:, a] -= counts[w, :]
                left[:, b] += counts[w, :]
                moved += 1
        if not moved:
            break
    return cls


def association(pair: np.ndarray) -> np.ndarray:
    """What a word gains in each class (columns) from a neighbour's class (rows: classes before it, then after it):
    the pointwise mutual information of adjacent classes, pair (before x after) being their counts."""
    mixed = pair + 0.1
    pmi = np.log(mixed * mixed.sum() / (mixed.sum(axis=1, keepdims=True) * mixed.sum(axis=0, keepdims=True)))
    gain = np.concatenate([pmi, pmi.T])
    gain[:, 0] = -np.inf  # the end's own class
    return gain


def classes_by_context(counts: DataFrame, contexts: DataFrame, gain: np.ndarray, fallback: int) -> DataFrame:
    """(word, n, cls) for the words of counts (word, n), each by its contexts (word, ctx, m): class before, or after + classes.

    A word has 2 * classes contexts at most. One without a context that counts goes to fallback.
    """
    held = counts.sparkSession.sparkContext.broadcast(np.maximum(gain, -1e30))
    width = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ctx, m = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
            cell = np.bincount(np.repeat(np.arange(len(batch)), size) * width + ctx, m, len(batch) * width).reshape(len(batch), width)
            cls = np.where(size > 0, (cell @ held.value).argmax(axis=1), fallback)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cls.astype(np.int32))], ["word", "n", "cls"])

    by_word = contexts.groupBy("word").agg(F.collect_list(F.struct("ctx", "m")).alias("contexts"))
    return counts.join(by_word, "word", "left").select("word", "n", "contexts").mapInArrow(run, "word long, n long, cls int")


def train_classes(texts: DataFrame, *, units: int = 1023, classes: int | None = None, frequent: int = 1 << 17) -> tuple[ClassModel, DataFrame]:
    """The model of texts (text; null counts as empty), and the table (word, n, cls) of all words.

    classes: by default they grow with the number of distinct words, to the power 0.3, from 64 up to a quarter of units.
    """
    small_batches(texts.sparkSession)
    texts = texts.select("text")
    counts = stored(word_counts(texts))
    tokens, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    classes = classes or int(max(64, min(units // 4, distinct**0.3)))
    real = counts.where(F.col("word") != END)
    top = real.orderBy(F.desc("n"), "word").limit(units).toArrow().to_pandas()
    word, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)

    order, total = np.argsort(word), 1 + len(word)
    known = adjacency(texts, word[order], 1 + order, total, (KNOWN,)).toArrow().to_pandas()  # at most total**2 rows
    matrix = np.zeros((total, total))
    matrix[known["a"], known["b"]] = known["n"]
    cls = exchange(matrix, classes)
    one = np.zeros((total, classes))
    one[np.arange(total), cls] = 1
    own = texts.sparkSession.createDataFrame(list(zip(word.view(np.int64).tolist(), n.tolist(), cls[1:].tolist(), strict=True)), "word long, n long, cls int")
    # all other words, by the classes of the units beside them
    near = adjacency(texts, word[order], cls[1:][order], classes, (BEFORE, AFTER))
    contexts = near.select(F.when(F.col("kind") == BEFORE, F.col("b")).otherwise(F.col("a")).alias("word"), F.when(F.col("kind") == BEFORE, F.col("a")).otherwise(F.col("b") + classes).cast("int").alias("ctx"), F.col("n").alias("m"))
    rest = real.join(F.broadcast(own.select("word")), "word", "left_anti")
    grouped = stored(classes_by_context(rest, contexts, association(one.T @ matrix @ one), classes - 1).unionAll(own))

    # transitions of all tokens: between frequent words in the tasks, others by joins on the word
    common = grouped.orderBy(F.desc("n"), "word").limit(max(frequent, units)).toArrow().to_pandas()
    common = common.sort_values("word", key=lambda x: x.to_numpy(np.int64).view(np.uint64))
    hashes, class_of = common["word"].to_numpy(np.int64).view(np.uint64), common["cls"].to_numpy(np.int64)
    met = stored(adjacency(texts, hashes, class_of, classes, (BEFORE, AFTER, PAIR, KNOWN)))
    of = lambda c: grouped.select(F.col("word").alias(c), F.col("cls").cast("long").alias(f"c{c}"))
    sides = met.where(F.col("kind") == KNOWN).select(F.col("a").alias("ca"), F.col("b").alias("cb"), "n")
    sides = sides.unionAll(met.where(F.col("kind") == BEFORE).join(of("b"), "b").select(F.col("a").alias("ca"), "cb", "n"))
    sides = sides.unionAll(met.where(F.col("kind") == AFTER).join(of("a"), "a").select("ca", F.col("b").alias("cb"), "n"))
    sides = sides.unionAll(met.where(F.col("kind") == PAIR).join(of("a"), "a").join(of("b"), "b").select("ca", "cb", "n"))
    sums = sides.groupBy("ca", "cb").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # at most classes**2 rows
    pair = np.zeros((classes, classes))
    pair[sums["ca"], sums["cb"]] = sums["n"]
    seen = pair.sum(axis=0)
    alone = (seen + 0.5) / (seen.sum() + 0.5 * classes)
    after, kinds = pair.sum(axis=1, keepdims=True), np.maximum((pair > 0).sum(axis=1, keepdims=True), 1)
    mixed = (pair + kinds * alone) / (after + kinds)
    # the words of each class, and one more for all unseen words
    sizes = grouped.groupBy("cls").agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).toArrow().to_pandas()
    end = int(seen[0])
    v, m, once = np.zeros(classes), np.zeros(classes), np.zeros(classes)
    v[sizes["cls"]], m[sizes["cls"]], once[sizes["cls"]] = sizes["v"], sizes["n"], sizes["once"]
    v[0], m[0] = 1, end
    unseen = 1 + int(once[1:].argmax())
    v[unseen] += 1
    emit = np.log10(m + ADD * np.maximum(v, 1))
    return ClassModel(hashes, common["n"].to_numpy(np.int64), class_of, np.log10(mixed), emit, int(tokens or 0), int(distinct), end, unseen), grouped


def score_texts(docs: DataFrame, model: ClassModel, words: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_tokens, n_known, train_tokens, base_score, score), row by row.

    base_score and score are log10 probabilities of the text, its end included, by word frequency alone
    and by the class model. A null or blank text is the end alone. Rows that repeat a doc_id are scored
    each; an empty table gives an empty result, other columns are ignored, whatever their names. If nothing
    was learned, every word counts as unseen. words: (word, n, cls) of all words, as train_classes gives it.

    A first pass scores what frequent words say; each other word is looked up by a join, with its place and
    the classes beside it, and its part is added row by row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ClassModel = held.value
        base_den, known_log, end = np.log10(m.tokens + ADD * (m.distinct + 1)), np.log10(m.counts + ADD), np.log10(m.end_count + ADD)
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "items"]
        for batch in batches:
            tokens, known, base, score = (np.zeros(len(batch)) for _ in range(4))
            items, offsets = [], [0]
            for i, j, data, offs in chunks(batch.column(1)):
                words_ = Words(data, offs)
                at = _lookup(m.words, words_.hash)
                found, n = at >= 0, np.diff(words_.first)
                line, place = _line(words_, np.where(found, m.class_of[at] if len(m.class_of) else 0, -1), 0)
                before, owner = np.concatenate([[0], line[:-1]]), np.repeat(np.arange(len(n)), n)
                row = np.repeat(np.arange(len(n)), n + 1)
                both = np.flatnonzero((before >= 0) & (line >= 0))
                value = np.zeros(len(at))
                value[found] = known_log[at[found]]
                total = np.bincount(owner, value, len(n)) + end
                tokens[i:j] = n + 1
                known[i:j] = np.bincount(owner, found, len(n)) + (m.end_count > 0)
                base[i:j] = total - (n + 1) * base_den
                told = np.flatnonzero(line >= 0)
                score[i:j] = total + np.bincount(row[both], m.transition[before[both], line[both]], len(n)) - np.bincount(row[told], m.emit[line[told]], len(n))
                lost = np.flatnonzero(~found)
                spot = place[lost]
                items.append((spot - (words_.first[owner[lost]] + owner[lost]), words_.hash[lost].view(np.int64), before[spot], line[spot + 1]))
                offsets += (offsets[-1] + np.cumsum(np.bincount(owner[lost], minlength=len(n)))).tolist()
            kinds = (np.int32, np.int64, np.int16, np.int16)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([x[k] for x in items] or [np.zeros(0)]).astype(t)) for k, t in enumerate(kinds)], ["at", "word", "left", "right"])
            yield pa.record_batch([batch.column(0), *(pa.array(x.astype(np.int64)) for x in (tokens, known)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of looked-up words, by row."""
        m: ClassModel = held.value
        for batch in batches:
            lists = batch.column(1)
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            at, n, cls, left, right = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
            order = np.lexsort((at, row))
            row, n, cls, left, right = (x[order] for x in (row, n, cls, left, right))
            cls = np.where(cls >= 0, cls, m.unseen)
            left = np.where(left >= 0, left, np.concatenate([[0], cls[:-1]]))  # the word before was looked up too
            step = m.transition[left, cls] + np.where(right >= 0, m.transition[cls, np.maximum(right, 0)], 0.0) - m.emit[cls]
            word = np.log10(n + ADD)
            sums = [np.bincount(row, x, len(batch)) for x in (word, word + step, n > 0)]
            yield pa.record_batch([batch.column(0), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64))], ["row", "more_base", "more", "also"])

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, items array<struct<at:int,word:long,left:short,right:short>>"
    first = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    said = first.select("row", F.explode("items").alias("x")).select("row", "x.at", "x.word", "x.left", "x.right")
    found = said.join(words.select("word", "n", "cls"), "word", "left")
    entry = F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cls", F.lit(-1)).alias("cls"), "left", "right")
    rest = found.groupBy("row").agg(F.collect_list(entry).alias("items")).mapInArrow(add, "row long, more_base double, more double, also long")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return first.drop("items").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + zero("also")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more")).alias("score"),
    )
