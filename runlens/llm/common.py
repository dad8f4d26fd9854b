"""Helpers the operators share: input, work tables, size checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.sources.tables import work_dir

# A run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with checking SQL where there is one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows per Arrow batch, so that a batch of very long texts fits into a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    only_ascii = F.length(text) == F.octet_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared work folder: computed once, and safe if executors are lost."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the folder named in spark.checkpoint.dir, or a local one where none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def sized(df: DataFrame, max_bytes: int = 4 << 20) -> DataFrame:
    """A table marked for broadcast if its rows, counted, take at most ``max_bytes``, and for a merge join beyond.

    Unmarked, a table that Spark sizes too low, as after an explode, would be broadcast whatever it takes.
    ``df`` should be cheap to read twice (written or checkpointed).
    """
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16)).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df.hint("merge")
