"""Shared helpers: stored intermediate tables, bounded batches, and rows picked before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import cleared, shared_dir, stored

__all__ = ["cleared", "only", "shared_dir", "small_batches", "stored"]

#: Arrow batches are cut to this many rows, so that a batch of long texts stays small.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch; a caller's smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def only(docs: DataFrame, ids: DataFrame, key: str, *, out: bool = False, most: int = 2_000_000) -> DataFrame:
    """The rows of docs whose key, a long, is in ids (one column, stored), or isn't (out); rows with a null key are not in ids.

    Up to ``most`` ids are broadcast, so that texts needn't be shuffled to be picked; of more, the join is left to Spark.
    """
    ids = ids.select(F.col(ids.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    few = ids.limit(most + 1).count() <= most
    return docs.join(F.broadcast(ids) if few else ids, key, "left_anti" if out else "left_semi")
