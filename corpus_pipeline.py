"""A corpus pipeline of five stages over the documents of a folder; see STAGES.

Every stage takes the whole of its input and any columns besides COLUMNS, which it drops; all but the last return
COLUMNS. An empty table gives an empty one, and texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import decontamination, language_id, line_dedup, mixing, ngram_jaccard
from braidwork.llm._store import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, learned from their own labels, can tell.

    Rows with a null or letterless text go, and those that it finds ambiguous: of two languages in equal parts, or
    too short to tell. Rows are judged one by one, whatever their doc_id; without any label all lettered rows stay.
    """
    return language_id.keep_told(docs, language_id.train_languages(docs)).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds, by alignment; those left without a word go.

    Rows are told apart, so one of equal rows stays; a null doc_id comes first. Texts that lose nothing stay as they are,
    null and blank ones included. n_chars counts what is left.
    """
    kept = line_dedup.drop_repeated_lines(docs)
    kept = kept.where((F.col("n_removed") == 0) | F.col("text").rlike(mixing.WORD))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked by five-word shingles at 0.8.

    All rows of a doc_id that is linked to a smaller one go; rows with a null doc_id, and texts without a word, stay, and
    so do all rows that repeat the least doc_id of their group.
    """
    return ngram_jaccard.drop_near_duplicates(docs, width=5, num=80, den=100).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the test items of the benchmark table: all rows of a doc_id for which one row holds an item.

    Rows with a null doc_id, and null and blank texts, stay.
    """
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes: a row for each row, null ids and texts included."""
    return mixing.mix_sources(docs)[0]


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: Learned models, alignments, links and random draws aren't SQL; tests/llm holds the rows to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
