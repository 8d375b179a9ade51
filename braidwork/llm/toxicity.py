"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, of their first 4 and 6 bytes (word forms share
them), of its word pairs and of pairs that skip one or two words. Each feature is 0 or 1. FTRL-proximal
keeps a learning rate by coordinate; its L1 term leaves most weights at zero, so the model is a short
list of (feature, weight) that is broadcast for scoring; 2**bits bounds it.

Training sees at most ``max_rows`` labelled rows (those of the least hashes of doc_id, then of text), ``epochs``
times, in one task that holds the features of these rows and the weights. Their order follows from the hashes
alone, so the model doesn't depend on files, tasks or retries. Scoring is a pass over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches, stored
from ._text import Words, chunks, mix

_U = np.uint64


@dataclass
class ToxicityModel:
    bits: int
    feature: np.ndarray  # sorted
    weight: np.ndarray
    bias: float


def _kinds(words: Words) -> list[tuple[np.ndarray, int]]:
    """Hashes of each kind of feature, and how many words after the first it takes."""
    h, out = words.hash, [(words.hash, 0), (words.stems(4) + _U(1), 0), (words.stems(6) + _U(2), 0)]
    for k in (1, 2, 3):
        out.append((h[:-k] * _U(0x9E3779B97F4A7C15) + h[k:] + _U(k) if len(h) > k else h[:0], k))
    return out


def row_features(data: np.ndarray, offs: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The sorted distinct features of each row."""
    words = Words(data, offs)
    kinds = [((mix(x) >> _U(64 - bits)).astype(np.int64), k) for x, k in _kinds(words)]
    for a, b in zip(words.first, words.first[1:], strict=False):
        yield np.unique(np.concatenate([x[a : max(a, b - k)] for x, k in kinds]))


class Ftrl:
    """FTRL-proximal with per-coordinate rates; z and n as in McMahan et al. 2013."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n, self.w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.w) - 1)  # the last weight is the bias, which L1 leaves alone
        w = self.w[at]
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        more = n + g * g
        z = self.z[at] + g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.z[at], self.n[at] = z, more
        l1 = np.where(at == len(self.w) - 1, 0.0, self.l1)
        self.w[at] = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(more)) / self.alpha + self.l2))


def train_toxicity(docs: DataFrame, labels: DataFrame, *, bits: int = 20, max_rows: int = 20_000, epochs: int = 3, alpha: float = 4.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0) -> ToxicityModel:
    """Learn from the texts of docs (doc_id, text) that labels (doc_id, toxic) mark.

    A doc_id that labels repeat takes its largest toxic; a null toxic or doc_id is no label. A doc_id that docs repeat
    gives a sample for each row, within max_rows. Without labels every score is a half. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # max_rows bounds what is broadcast here
    picked = stored(known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(max_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    # a doc_id may repeat in docs: the bound holds for rows too
    rows = rows.withColumn("a", F.xxhash64("doc_id", F.lit(3))).withColumn("b", F.xxhash64("text")).orderBy("a", "b", "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, samples, label, keys = Ftrl(1 << bits, alpha, beta, l1, l2), [], [], []
        for batch in batches:
            label += batch.column(1).to_pylist()
            keys.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]))
            for _, _, data, offs in chunks(batch.column(0)):
                samples += [x.astype(np.int32) for x in row_features(data, offs, bits)]
        if samples:
            by = np.lexsort(np.concatenate(keys, axis=1)[::-1])
            samples, label = [samples[k] for k in by], [label[k] for k in by]
        order = np.random.Generator(np.random.PCG64(1))
        for _ in range(epochs):
            for k in order.permutation(len(samples)):
                model.learn(samples[k], int(label[k] > 0))
        at = np.flatnonzero(model.w)
        yield pa.record_batch([pa.array(at), pa.array(model.w[at])], ["feature", "weight"])

    learned = rows.select("text", "toxic", "a", "b", "doc_id").repartition(1).mapInArrow(run, "feature long, weight double").toPandas().sort_values("feature")
    feature, weight = learned["feature"].to_numpy(np.int64), learned["weight"].to_numpy(float)
    bias = float(weight[feature == 1 << bits].sum())
    inner = feature < 1 << bits
    return ToxicityModel(bits, feature[inner], weight[inner], bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, least: float = 0.7) -> DataFrame:
    """docs (doc_id, text) to (doc_id, score, predicted), row by row; null and blank texts have the bias only.

    Rows that repeat a doc_id, or have none, get a row each; an empty table gives an empty result, other columns are
    ignored, whatever their names. A score that equals least is predicted 1.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicityModel = held.value
        dense = np.zeros(1 << m.bits)
        dense[m.feature] = m.weight
        for batch in batches:
            total = np.full(len(batch), m.bias)
            for i, _, data, offs in chunks(batch.column(1)):
                words, cells = Words(data, offs), []
                for x, k in _kinds(words):
                    at = (mix(x) >> _U(64 - m.bits)).astype(np.int64)
                    hit = np.flatnonzero(dense[at])
                    row = np.searchsorted(words.first, hit, "right") - 1
                    inside = hit + k < words.first[row + 1]
                    cells.append((row[inside] << m.bits) | at[hit[inside]])
                cell = np.unique(np.concatenate(cells))  # a feature counts once a text
                np.add.at(total, i + (cell >> m.bits), dense[cell & ((1 << m.bits) - 1)])
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= least).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
