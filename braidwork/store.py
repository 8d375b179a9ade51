"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine in local mode, and an error on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/braidwork"


def stored(df: DataFrame, *, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there.

    The result is read lazily, so the table stays until ``cleared`` or until the folder's owner removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        root = shared_dir(spark)
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            if where.getParent().toUri().getPath() == spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath():
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
