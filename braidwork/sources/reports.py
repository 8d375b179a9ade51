"""Reports as text: tables of tasks and times, logs of key=value pairs, annotations and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(rows: DataFrame, path: str, *, sep: str = "\t", add: bool = False) -> None:
    """rows as text with a header line in each file; add: beside what the folder holds, else in place of it."""
    rows.write.option("header", True).option("sep", sep).mode("append" if add else "overwrite").csv(path)


def read_table(spark: SparkSession, path: str, schema: str, *, sep: str = "\t") -> DataFrame:
    """What write_table wrote, by a schema such as ``tid long, seconds double``: nothing is guessed from the text."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("enforceSchema", False).csv(path)


def read_log(spark: SparkSession, path: str, *, mark: str = r"rank\s+(\d+):") -> DataFrame:
    """(source, key, value): the key=value pairs of log lines that hold mark, whose group names the source."""
    lines = spark.read.text(path).where(F.col("value").rlike(mark)).select(F.regexp_extract("value", mark, 1).alias("source"), "value")
    pairs = lines.select("source", F.explode(F.regexp_extract_all("value", F.lit(r"([\w.]+=[^\s,]+)"), 1)).alias("pair"))
    return pairs.select("source", F.substring_index("pair", "=", 1).alias("key"), F.expr("substring(pair, instr(pair, '=') + 1)").alias("value"))


def rank_totals(log: DataFrame) -> DataFrame:
    """(key, n, total, most, imbalance) of numeric values of a log; imbalance: the largest by the mean."""
    number = F.expr("try_cast(value as double)")
    return log.select("key", number.alias("x")).where("x is not null").groupBy("key").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.max("x").alias("most"), (F.max("x") / F.avg("x")).alias("imbalance"))


def write_annotations(masks: DataFrame, path: str, *, width: int = 5) -> None:
    """Intervals (ctg, beg, end) as lines ``ctg: beg-end beg-end ...`` in order, width of them a line at most."""
    numbered = masks.groupBy("ctg").agg(F.array_sort(F.collect_list(F.struct("beg", "end"))).alias("spans"))
    rows = numbered.select("ctg", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("spans") - 1) / width)), lambda k: F.slice("spans", (k * width + 1).cast("int"), width))).alias("k", "part"))
    spans = F.array_join(F.transform("part", lambda x: F.concat_ws("-", x["beg"].cast("string"), x["end"].cast("string"))), " ")
    rows.select(F.concat_ws(": ", F.col("ctg").cast("string"), spans)).write.text(path)


def read_annotations(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """(ctg, beg, end) of lines that write_annotations wrote; contigs (ctg): those alone are kept."""
    rows = spark.read.text(path).select(F.substring_index("value", ":", 1).cast("long").alias("ctg"), F.explode(F.regexp_extract_all("value", F.lit(r"(\d+-\d+)"), 1)).alias("span"))
    found = rows.select("ctg", F.substring_index("span", "-", 1).cast("long").alias("beg"), F.substring_index("span", "-", -1).cast("long").alias("end"))
    return found if contigs is None else found.join(contigs.select("ctg").distinct(), "ctg", "left_semi")
