"""Appends that a retry does not repeat.

A batch is written to a folder of its own, then its id is entered in a ledger beside the data.  Readers see
batches of the ledger only.  Writing a batch again, after a failure or because it was delivered twice,
replaces what an unfinished attempt left and does nothing to a finished one.  One writer per batch at a time.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from runlens.functions.clock import SNAPSHOT_ZONE, snapshot_day

LEDGER = "batch string, committed boolean"


def _folder(path: str, kind: str, batch: str | None = None) -> str:
    root = f"{path.rstrip('/')}/{kind}"
    return root if batch is None else f"{root}/batch={batch}"


def _has_files(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def committed_batches(spark: SparkSession, path: str) -> DataFrame:
    """``batch`` for every finished batch; without any, no rows."""
    if not _has_files(spark, _folder(path, "commits")):
        return spark.createDataFrame([], "batch string")
    return spark.read.schema(LEDGER).parquet(_folder(path, "commits")).filter("committed").select("batch")


def write_batch(df: DataFrame, path: str, batch: str, partition_by: list[str] | None = None) -> None:
    """Write a batch into its folder, in place of an earlier attempt; readers do not see it yet."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError(f"a batch id has letters, digits, _ and - only: {batch!r}")
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(_folder(path, "data", batch))


def is_written(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether a batch is complete in its folder, entered in the ledger or not."""
    return _has_files(spark, f"{_folder(path, 'data', batch)}/_SUCCESS")


def is_committed(spark: SparkSession, path: str, batch: str) -> bool:
    return not committed_batches(spark, path).filter(F.col("batch") == batch).isEmpty()


def commit_batch(spark: SparkSession, path: str, batch: str) -> None:
    """Enter a written batch in the ledger."""
    spark.range(1).select(F.lit(True).alias("committed")).write.mode("overwrite").parquet(_folder(path, "commits", batch))


def append_once(df: DataFrame, path: str, batch: str, partition_by: list[str] | None = None) -> bool:
    """Append a batch unless it is there already; tells whether it was appended."""
    spark = df.sparkSession
    if is_committed(spark, path, batch):
        return False
    write_batch(df, path, batch, partition_by)
    commit_batch(spark, path, batch)
    return True


def daily_append_once(df: DataFrame, at: Column, path: str, batch: str, zone: str = SNAPSHOT_ZONE) -> bool:
    """``append_once`` by the calendar day of ``at`` in the zone; a large day is split over files."""
    return append_once(df.withColumn("day", snapshot_day(at, zone)).hint("rebalance", "day"), path, batch, ["day"])


def read_once(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of all finished batches; folders of other batches are not read.

    ``schema`` gives the columns where no batch may be there yet.
    """
    root = _folder(path, "data")
    if not _has_files(spark, root):
        if schema is None:
            raise AnalysisException(f"no batch is stored in {path}")
        return spark.createDataFrame([], schema)
    # Batch ids stay text, also those of digits only.
    with_ids = spark.read.option("basePath", root).parquet(root).schema
    for field in with_ids.fields:
        if field.name == "batch":
            field.dataType = StringType()
    rows = spark.read.schema(with_ids).option("basePath", root).parquet(root)
    return rows.join(committed_batches(spark, path), "batch", "left_semi").drop("batch")

