"""Latest row and first rows per key.

Both forms keep the filter directly on the ranking, so Spark limits each key inside every
map task before the shuffle: a key that holds a large share of the table moves only its
candidate rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: list[str], order: list[Column], ties: bool = False) -> DataFrame:
    """Rows that come first in ``order`` within their key.

    ``ties=True`` keeps every row equal to the first one; otherwise exactly one row per key
    stays and ``order`` must end in a unique column to be repeatable.
    """
    place = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def keep_first(df: DataFrame, keys: list[str], order: list[Column], count: int, out: str) -> DataFrame:
    """The first ``count`` rows per key with their place in ``out``; ``order`` must be total."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, place).filter(F.col(out) <= count)
