"""Tables cut into buckets by a hash of key columns, of which a change rewrites only the buckets it touches.

The bucket is a partition folder whose name tells the number of buckets, so readers need no
parameter.  A rewrite makes the new rows of the touched buckets first, in the work folder, and then replaces
these buckets; files of other buckets stay as they are.  Give as many buckets as make one a few files at most.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.sources.tables import written

_FOLDER = re.compile(r"bucket_of_(\d+)$")


def bucket_number(by: list[str], buckets: int) -> Column:
    """Bucket of a row; NULL keys have one, too."""
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def write_bucketed(rows: DataFrame, path: str, by: list[str], buckets: int) -> None:
    """Store a new table; a bucket too large for one task is split over several files."""
    folder = f"bucket_of_{buckets}"
    rows.withColumn(folder, bucket_number(by, buckets)).hint("rebalance", folder).write.partitionBy(folder).parquet(path)


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, str, int]:
    table = spark.read.parquet(path)
    folder = next(c for c in table.columns if _FOLDER.match(c))
    return table, folder, int(_FOLDER.match(folder).group(1))


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    table, folder, _ = _stored(spark, path)
    return table.drop(folder)


def touched_buckets(spark: SparkSession, path: str, keys: DataFrame, by: list[str]) -> list[int]:
    """Numbers of the buckets that hold any of the keys, at most as many as the table has."""
    _, _, buckets = _stored(spark, path)
    return sorted(r[0] for r in keys.select(bucket_number(by, buckets).alias("b")).distinct().collect())


def read_touched(spark: SparkSession, path: str, touched: list[int]) -> DataFrame:
    """The rows of some buckets; the other folders are not read."""
    table, folder, _ = _stored(spark, path)
    return table.filter(F.col(folder).isin(touched)).drop(folder)


class Staged(NamedTuple):
    """The new rows of some buckets, complete in the work folder, and where they belong."""

    rows: DataFrame
    path: str
    folder: str
    touched: list[int]

    @property
    def records(self) -> DataFrame:
        return self.rows.drop(self.folder)


def stage_touched(
    spark: SparkSession, path: str, by: list[str], keys: DataFrame, change: Callable[[DataFrame], DataFrame]
) -> Staged:
    """Make the new rows of the buckets that hold the keys: ``change`` of their rows.  The table stays as it is.

    ``change`` must treat rows of different keys apart, so that other buckets need no look, and may add
    rows of the given keys only; rows that belong to another bucket are refused.
    """
    touched = touched_buckets(spark, path, keys, by)
    _, folder, buckets = _stored(spark, path)
    changed = change(read_touched(spark, path, touched)).withColumn(folder, bucket_number(by, buckets))
    rows = written(changed.hint("rebalance", folder), "new-buckets")
    if not rows.filter(~F.col(folder).isin(touched)).isEmpty():
        raise ValueError("the change made rows of keys it was not given")
    return Staged(rows, path, folder, touched)


def replace_buckets(staged: Staged) -> None:
    """Put the staged rows in the place of their buckets.  If it is interrupted, do it again: it changes nothing else."""
    spark = staged.rows.sparkSession
    staged.rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(staged.folder).parquet(staged.path)
    filled = {r[0] for r in staged.rows.select(staged.folder).distinct().collect()}
    for number in set(staged.touched) - filled:
        emptied = spark._jvm.org.apache.hadoop.fs.Path(f"{staged.path}/{staged.folder}={number}")
        emptied.getFileSystem(spark._jsc.hadoopConfiguration()).delete(emptied, True)


def rewrite_touched(
    spark: SparkSession, path: str, by: list[str], keys: DataFrame, change: Callable[[DataFrame], DataFrame]
) -> Staged:
    """``stage_touched``, then ``replace_buckets``."""
    staged = stage_touched(spark, path, by, keys, change)
    replace_buckets(staged)
    return staged
