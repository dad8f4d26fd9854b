"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import checkpointed


def _lowest(links: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours; combined in the map tasks."""
    return links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")).withColumnRenamed("a", "node")


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b: bigint); the root is the smallest node reachable.

    Each round links every node to the smallest node around it, until only stars are left; the
    number of rounds grows with the logarithm of the longest path.  No node's neighbours are
    collected: minima are aggregates, joined back.  Each round is checkpointed.
    """
    links = checkpointed(edges.filter("a <> b").select("a", "b").distinct())
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.filter("b > a").join(_lowest(both), F.col("a") == F.col("node"))
        large = large.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        small = large.join(_lowest(large), F.col("a") == F.col("node"))
        small = small.select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e"))
        small = small.select(F.col("e.b").alias("a"), F.col("e.low").alias("b")).filter("a <> b").distinct()
        links = checkpointed(small)
        after = _state(links)
        if after == state:
            break
        state = after
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(own)
