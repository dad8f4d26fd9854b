"""Readers and writers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from runlens.functions.clock import SNAPSHOT_ZONE, snapshot_day
from runlens.functions.predicates import matches_all

WORK_DIR_SETTING = "spark.checkpoint.dir"


def scan_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: dict[str, object] | None = None) -> DataFrame:
    """Parquet table with chosen columns and equality conditions; both reach the scan."""
    table = spark.read.parquet(path)
    if where:
        table = table.filter(matches_all(where))
    return table.select(*columns) if columns else table


def jdbc_reader(
    spark: SparkSession,
    options: dict[str, str],
    table: str | None = None,
    query: str | None = None,
    partition: tuple[str, int, int, int] | None = None,
) -> DataFrameReader:
    """Reader for a relational table or query; call ``load()`` on it.

    ``options`` hold url, driver and credentials and come from the caller's environment.
    ``partition`` is (column, lower, upper, count) and spreads a table scan over that many
    connections; a query cannot be partitioned.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    if query is not None and partition is not None:
        raise ValueError("a query is read through one connection; read a table to partition it")
    reader = spark.read.format("jdbc").options(**options)
    if query is not None:
        return reader.option("query", query)
    reader = reader.option("dbtable", table)
    if partition is not None:
        column, lower, upper, count = partition
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=count)
    return reader


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as (path, line, block, place); ``block`` and ``place`` order the lines of a file.

    A block is read by one task in order, so a line's place in that task follows its place in
    the block.  ``plans.logs.numbered_lines`` turns both into line numbers.
    """
    meta = F.col("_metadata")
    return spark.read.text(path).select(
        meta["file_path"].alias("path"),
        F.col("value").alias("line"),
        meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def append_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table after an insert; columns the new rows lack are NULL."""
    return table.unionByName(rows, allowMissingColumns=True)


def write_append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def daily_partition_append(df: DataFrame, at: Column, path: str, zone: str = SNAPSHOT_ZONE) -> None:
    """Append rows to a table partitioned by the calendar day of ``at`` in the zone.

    Rows are rebalanced by day first: few files per day, and a large day is split over tasks.
    """
    write_append(df.withColumn("day", snapshot_day(at, zone)).hint("rebalance", "day"), path, ["day"])


_OPEN_SCRATCH: list[list[str]] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder the cluster names; a temporary one where that is unset and all runs in one process."""
    shared = spark.conf.get(WORK_DIR_SETTING, None) or spark.sparkContext.getConf().get(WORK_DIR_SETTING)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {WORK_DIR_SETTING} to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="runlens-")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for opened in _OPEN_SCRATCH:
        opened.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Drop the work folders made inside the block at its end; results that read them must be stored by then."""
    made: list[str] = []
    _OPEN_SCRATCH.append(made)
    try:
        yield made
    finally:
        _OPEN_SCRATCH.remove(made)
        for folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared work folder: computed once, and safe if executors are lost."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """As ``written``, for large tables of text: tighter compression, and files of at most so many rows, which many tasks read."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """A table marked for broadcast if its rows, counted, take at most ``max_bytes``; unmarked beyond.

    ``df`` should be cheap to read twice.
    """
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16)).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df
