"""FASTA in, k-mer and PAF text out, as Spark reads and writes of text files (compressed ones by their ending)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import Scan, carried_scans
from ..operators.ranges import split_at_gaps
from ..store import stored


def read_scaffolds(spark: SparkSession, path: str) -> DataFrame:
    """(name, bases): a row for each record; the name is the header line after ``>`` and blanks."""
    raw = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''")
    head = F.regexp_replace(F.substring_index("value", "\n", 1), r"^>?[ \t]*|\r$", "")
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    return raw.select(head.alias("name"), F.regexp_replace(body, r"[\s>]", "").alias("bases"))


def read_tiles(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(name, tile, bases): the records in tiles of width symbols, numbered from 0, without any record in one row.

    Read by lines, so that one long record is read by many tasks; the name and the place of a line are carried over from
    the lines before it in its file. Lines before the first header are of no record; records of one name and file, of
    which FASTA has none, would run into each other. A record without symbols has no tile.
    """
    text = F.regexp_replace("value", r"\s+$", "")
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", text.alias("value"))
    lines = lines.withColumn("at", F.monotonically_increasing_id()).where("value <> ''")
    lines = stored(lines)  # the number of a line is that of the task which read it
    order, header = ["file_block_start", "at"], F.col("value").startswith(">")
    size = F.when(header, 0).otherwise(F.length(F.regexp_replace("value", r"\s", ""))).cast("long")
    placed = carried_scans(lines, ["file_path"], order, {"before": Scan("sum", size)})
    began = F.when(header, F.struct(F.regexp_replace("value", r"^>[ \t]*", "").alias("name"), F.coalesce("before", F.lit(0)).alias("base")))
    named = carried_scans(placed, ["file_path"], order, {"head": Scan("last", began, upto=True)}).where(~header & F.col("head").isNotNull())
    rows = named.select("file_path", "head.name", (F.coalesce("before", F.lit(0)) - F.col("head.base")).alias("place"), F.regexp_replace("value", r"\s", "").alias("bases"))
    first, last = (F.expr(f"({x}) div {width}") for x in ("place", "place + length(bases) - 1"))
    rows = rows.select("*", F.explode(F.sequence(first, last)).alias("tile"))
    low = F.greatest(F.lit(0), F.col("tile") * width - F.col("place"))
    high = F.least(F.length("bases").cast("long"), (F.col("tile") + 1) * width - F.col("place"))
    cut = rows.select("file_path", "name", "tile", F.struct((F.col("place") + low).alias("place"), F.substring(F.col("bases"), (low + 1).cast("int"), (high - low).cast("int")).alias("bases")).alias("piece"))
    tiles = cut.groupBy("file_path", "name", "tile").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["bases"]), "").alias("bases"))
    return tiles.select("name", "tile", "bases")


def contigs_of(scaffolds: DataFrame, *, least_gap: int = 1) -> DataFrame:
    """(name, k, sbeg, clen, seq): stretches between gaps as digits; symbols of shorter gaps count as A."""
    parts = split_at_gaps(scaffolds, "name", "bases", gap="[^ACGTacgt]", least=least_gap)
    piece = F.regexp_replace(F.upper(F.expr("substring(bases, cast(sbeg as int) + 1, cast(clen as int))")), "[^ACGT]", "A")
    return parts.join(scaffolds, "name").select("name", "k", "sbeg", "clen", F.translate(piece, "ACGT", "0123").alias("seq"))


def masks_of(scaffolds: DataFrame) -> DataFrame:
    """(name, beg, end): runs of lower-case letters."""
    runs = split_at_gaps(scaffolds, "name", "bases", gap="[^a-z]", least=1)
    return runs.select("name", F.col("sbeg").alias("beg"), (F.col("sbeg") + F.col("clen")).alias("end"))


def write_kmers(recs: DataFrame, path: str) -> None:
    """Records as lines ``ctg pos strand kmer``, the k-mer packed into hexadecimal, two bits a base; with lcp before it if they have one."""
    digit = lambda k: F.expr(f"hex(cast(substring(kmer, {k}, 1) as int) * 4 + cast(substring(kmer, {k + 1}, 1) as int))")
    packed = F.lower(F.concat(*(digit(k) for k in range(1, 41, 2))))
    fields = ["ctg", "pos", "strand", *(["lcp"] if "lcp" in recs.columns else [])]
    recs.select(F.concat_ws(" ", *fields, packed)).write.text(path)


def read_kmers(spark: SparkSession, path: str) -> DataFrame:
    """(ctg, pos, strand, lcp, kmer) of lines that write_kmers wrote, k-mers as digits; lcp is null where lines have none."""
    part = F.split(F.trim("value"), r"\s+")
    n = F.size(part)
    code = F.element_at(part, n)
    two = lambda x: F.lpad(F.conv(x, 16, 4), 2, "0")
    kmer = F.array_join(F.transform(F.regexp_extract_all(code, F.lit("([0-9a-fA-F])"), 1), two), "")
    rows = spark.read.text(path).where("trim(value) <> ''").select(part.alias("part"), n.alias("n"), kmer.alias("kmer"))
    at = lambda k, kind: F.element_at("part", k).cast(kind)
    return rows.select(at(1, "long").alias("ctg"), at(2, "int").alias("pos"), at(3, "int").alias("strand"), F.when(F.col("n") == 5, at(4, "int")).alias("lcp"), "kmer")


def write_paf(overlaps: DataFrame, path: str, names: DataFrame | None = None) -> None:
    """Alignments as PAF lines; names (ctg, name) replaces the numbers of contigs."""
    rows = overlaps.withColumn("qname", F.col("ctg_a").cast("string")).withColumn("tname", F.col("ctg_b").cast("string"))
    if names is not None:
        rows = rows.join(names.select(F.col("ctg").alias("ctg_a"), F.col("name").alias("qn")), "ctg_a", "left")
        rows = rows.join(names.select(F.col("ctg").alias("ctg_b"), F.col("name").alias("tn")), "ctg_b", "left")
        rows = rows.withColumn("qname", F.coalesce("qn", "qname")).withColumn("tname", F.coalesce("tn", "tname"))
    block = F.greatest(F.col("aepos") - F.col("abpos"), F.col("bepos") - F.col("bbpos"))
    tbeg = F.when(F.col("comp"), F.col("blen") - F.col("bepos")).otherwise(F.col("bbpos"))
    tend = F.when(F.col("comp"), F.col("blen") - F.col("bbpos")).otherwise(F.col("bepos"))
    sign = F.when(F.col("comp"), "-").otherwise("+")
    line = F.concat_ws("\t", "qname", "alen", "abpos", "aepos", sign, "tname", "blen", tbeg, tend, block - F.col("diffs"), block, F.lit(255), F.concat(F.lit("df:i:"), "diffs"))
    rows.orderBy("ctg_a", "abpos", "ctg_b", "comp", "bbpos").select(line).write.text(path)
