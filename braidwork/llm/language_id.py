"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language has a codeword; each bit is a binary problem, some languages against the others. A bit's
classifier is linear in the counts of a text's byte n-grams (1 to 4, hashed), with the log-odds of the
n-grams on the two sides as weights. A text's bits are decoded by loss: each codeword sums the logistic
losses of the bit margins, each bit weighted by how well it did in training, and the least loss wins.
A text is flagged as ambiguous if the runner-up is within ``close`` of it by the mean evidence of an n-gram
(a text of two languages), or within ``faint`` by all its evidence (too short to tell).

Training counts n-grams by language over all the labelled rows; only these counts (languages times
``buckets``) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ._store import small_batches
from ._text import FOLDED_HASH, chunks

ORDERS = (1, 2, 3, 4)
_U = np.uint64


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits, of 1 and -1
    weight: np.ndarray  # bits x buckets
    bit_weight: np.ndarray
    buckets: int


def features(data: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each n-gram; entry k * n + i is the n-gram of order k + 1 at byte i (spaces fold)."""
    one = FOLDED_HASH[data]
    out, run = [], np.zeros(len(data), np.uint64)
    for order in ORDERS:
        head = one[order - 1 :]
        run = run[: len(head)] * _U(0x9E3779B97F4A7C15) + head
        out.append((mix_short(run) >> _U(64 - int(buckets).bit_length() + 1)).astype(np.int32))
    return out


def mix_short(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)


def text_counts(data: np.ndarray, offs: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """The buckets that each row's n-grams fall into."""
    grams = features(data, buckets)
    for a, b in zip(offs, offs[1:], strict=False):
        yield np.concatenate([g[a : max(a, b - k)] for k, g in enumerate(grams)])


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """All splits of up to 6 languages; of more, random splits that keep codewords far apart."""
    if n < 2:
        return np.ones((max(n, 1), 1))
    if n <= 6:
        bits = [[1 if (k >> i) & 1 else -1 for i in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(bits).T
    rng, best = np.random.Generator(np.random.PCG64(seed)), None
    for _ in range(64):
        code = np.where(rng.permuted(np.tile(np.arange(n) < n // 2, (max(15, 4 * int(np.ceil(np.log2(n)))), 1)), axis=1).T, 1, -1)
        far = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if best is None or far > best[0]:
            best = (far, code)
    return best[1]


def train_languages(labelled: DataFrame, *, buckets: int = 1 << 14, max_languages: int = 256) -> LanguageModel:
    """Learn from labelled (text, lang); rows with a null in either are left out."""
    small_batches(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, j, data, offs in chunks(batch.column(0)):
                grams = features(data, buckets)
                row_of = np.repeat(np.arange(j - i), np.diff(offs))
                names = sorted(set(langs[i:j]))
                number = np.array([names.index(x) for x in langs[i:j]])[row_of]
                for k, g in enumerate(grams):
                    inside = row_of[: len(g)] == row_of[k:]
                    got = np.bincount(number[: len(g)][inside] * buckets + g[inside], minlength=len(names) * buckets)
                    for m, name in enumerate(names):
                        total.setdefault(name, np.zeros(buckets, np.int64))
                        total[name] += got[m * buckets : (m + 1) * buckets]
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.record_batch([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(sums[at])], ["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).limit(max_languages + 1).collect()
    if len(table) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    table.sort(key=lambda r: r["lang"])
    counts = np.zeros((len(table), buckets))
    for k, r in enumerate(table):
        counts[k, [x["bucket"] for x in r["x"]]] = [x["n"] for x in r["x"]]
    return fit(counts, [r["lang"] for r in table])


def fit(counts: np.ndarray, languages: list[str]) -> LanguageModel:
    """Bit classifiers from n-gram counts by language (languages x buckets); each language weighs the same."""
    n, buckets = len(languages), counts.shape[1] if counts.size else 1
    code = codewords(n)
    rate = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if n else np.ones((1, buckets))
    weight, skill = [], []
    for bit in code.T:
        if (bit == bit[0]).all():
            weight.append(np.zeros(buckets))
            skill.append(1.0)
            continue
        w = np.log(rate[bit > 0].mean(axis=0)) - np.log(rate[bit < 0].mean(axis=0))
        weight.append(w)
        skill.append(min(float((rate[k] * w).sum()) * b for k, b in enumerate(bit)))  # the worst language's mean margin
    skill = np.maximum(np.array(skill), 1e-3)
    return LanguageModel(languages, code, np.array(weight), skill / skill.sum(), buckets)


def decode(model: LanguageModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses by row and language, and the softmax of their negatives; margins: rows x bits, summed."""
    z = margins[:, None, :] * model.code[None, :, :]
    loss = (np.logaddexp(0, -z) * model.bit_weight).sum(axis=2)
    gain = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return loss, gain / gain.sum(axis=1, keepdims=True)


def with_languages(docs: DataFrame, model: LanguageModel, *, close: float = 0.02, faint: float = 0.5, scale: float = 0.1, prefix: str = "") -> DataFrame:
    """docs (text, any others) with lang_pred, score and ambiguous after its columns, row by row; prefix: of their names.

    A null text, or one without a letter, is ``und`` with score 0 and not ambiguous; so is every text if nothing
    was learned. Letters are Unicode letters. scale: the weight of one n-gram's evidence in score, as n-grams of a
    text overlap. Rows that repeat each get a row; an empty table gives an empty result. The names with the prefix
    must be free.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    names = [*docs.columns, f"{prefix}lang_pred", f"{prefix}score", f"{prefix}ambiguous"]
    rows = docs.withColumn(names[-1], F.when(F.col("text").rlike(r"\p{L}"), F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = held.value
        table = np.ascontiguousarray(m.weight.T)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            known = text.is_valid().to_numpy(zero_copy_only=False) & bool(m.languages)
            margins, grams = np.zeros((len(batch), m.code.shape[1])), np.zeros(len(batch))
            for i, j, data, offs in chunks(text):
                for k, g in enumerate(features(data, m.buckets)):
                    # sums of table rows by text, through counts of buckets: a text's n-grams never cross its end
                    for row in range(i, j):
                        a, b = offs[row - i], offs[row - i + 1] - k
                        if b > a:
                            grams[row] += b - a
                            if b - a < 2048:
                                margins[row] += table[g[a:b]].sum(axis=0)
                            else:
                                margins[row] += np.bincount(g[a:b], minlength=m.buckets) @ table
            loss, share = decode(m, margins * scale)
            best = loss.argmin(axis=1)
            score = share[np.arange(len(best)), best]
            vague = (_lead(loss) < faint) | (_lead(decode(m, margins / np.maximum(grams, 1)[:, None])[0]) < close)
            told = np.array([*m.languages, "und"], object)[np.where(known, best, len(m.languages))]
            yield pa.record_batch([*batch.columns[:-1], pa.array(told.tolist(), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & vague)], names)

    schema = StructType([*docs.schema, StructField(names[-3], StringType()), StructField(names[-2], DoubleType()), StructField(names[-1], BooleanType())])
    return rows.mapInArrow(run, schema)


def _lead(loss: np.ndarray) -> np.ndarray:
    """By how much the least loss of each row is less than the next."""
    return np.partition(loss, 1, axis=1)[:, 1] - loss.min(axis=1) if loss.shape[1] > 1 else np.full(len(loss), np.inf)


def predict_languages(docs: DataFrame, model: LanguageModel, **options) -> DataFrame:
    """docs (doc_id, text) to (doc_id, lang_pred, score, ambiguous), row by row: see with_languages. Other columns are ignored."""
    return with_languages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, **options).drop("text")


def keep_told(docs: DataFrame, model: LanguageModel, *, wanted: list[str] | None = None, **options) -> DataFrame:
    """docs without the rows whose language can't be told (``und``, ambiguous) or isn't wanted (None: any that was learned).

    If nothing was learned, rows with a letter stay. Each row is judged by its own text; columns stay as they are.
    """
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = with_languages(docs, model, prefix="braid_", **options)
    keep = (F.col("braid_lang_pred") != "und") & ~F.col("braid_ambiguous")
    if wanted is not None:
        keep &= F.col("braid_lang_pred").isin(wanted)
    return told.where(keep).drop("braid_lang_pred", "braid_score", "braid_ambiguous")
