"""Sequences from the driver's tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import KMER, LETTERS

PIECE_BYTES = 1 << 20  # of texts that are encoded at once
TASK_BYTES = 16 << 20  # of files that a task reads, about, so that what it deals out fits its share of memory
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[[ord(c) for c in LETTERS]] = [48 + k % 4 for k in range(len(LETTERS))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt anew where they come in fewer files than there are cores: a file's row group is one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if len(rows.inputFiles()) < cores else rows


def in_small_tasks(rows: DataFrame, root: str) -> DataFrame:
    """rows of files below root as a union of reads of a few files each: Spark cuts a read into as many tasks as there are cores, or more."""
    spark, groups, size = rows.sparkSession, [[]], 0
    conf, most = spark._jsc.hadoopConfiguration(), TASK_BYTES * spark.sparkContext.defaultParallelism
    for name in sorted(rows.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        own = path.getFileSystem(conf).getFileStatus(path).getLen()
        if groups[-1] and size + own > most:
            groups, size = [*groups, []], 0
        groups[-1].append(path.toString())
        size += own
    if len(groups) == 1:
        return rows
    found = [spark.read.schema(rows.schema).option("basePath", root).parquet(*names) for names in groups]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def digits_of_texts(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches of (ctg, scaf, lower-case text) as (ctg, scaf, seq), in pieces of PIECE_BYTES of text or of one longer text."""
    for batch in batches:
        before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(before, before[a] + PIECE_BYTES, "right")) - 1)
            piece, a = batch.slice(a, b - a), b
            column = pc.fill_null(piece.column(2), "").cast(pa.large_string())
            _, offsets, data = column.buffers()
            offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
            flat = _DIGIT[np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)]
            kept = np.concatenate([[0], np.cumsum(flat > 0)])[offs - offs[0]]
            seq = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(kept), pa.py_buffer(np.ascontiguousarray(flat[flat > 0])))
            long_ = pa.array(np.diff(kept) >= least)
            yield pa.record_batch([piece.column(0), piece.column(1), seq.cast(pa.string())], ["ctg", "scaf", "seq"]).filter(long_)


def encoded(texts: DataFrame, *, least: int = KMER) -> DataFrame:
    """(ctg, scaf, seq) of texts (ctg, scaf, text): letters a-z as digits 0-3 dealt in turn, all else dropped; least long."""
    rows = texts.select(F.col("ctg").cast("long").alias("ctg"), F.col("scaf").cast("string").alias("scaf"), F.lower("text").alias("text"))
    return rows.mapInArrow(lambda batches: digits_of_texts(batches, least), "ctg long, scaf string, seq string")


def sequences_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ctg, scaf, seq) of the documents that encode to a k-mer at least."""
    docs = spread(in_small_tasks(table(spark, sf_dir, "documents"), f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return encoded(docs.select(F.col("doc_id").alias("ctg"), F.col("source").alias("scaf"), "text"))


def sizes_from_documents(spark: SparkSession, sf_dir: str, *, least: int = KMER) -> DataFrame:
    """(ctg, scaf, n): how long the sequences of sequences_from_documents are. Letters are only counted, so no text goes to Python."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    n = F.length(F.regexp_replace(F.lower("text"), "[^a-z]+", "")).cast("long")
    counted = F.explode(F.array(n))  # or else the filter counts them a second time
    return docs.select(F.col("doc_id").cast("long").alias("ctg"), F.col("source").cast("string").alias("scaf"), counted.alias("n")).where(F.col("n") >= least)
