"""Mixing sources to target weights.

Token counts are summed per source, every source gets a target, and the target over the
source's size is the rate at which each of its documents is repeated.  A document is emitted
floor(rate) times, and once more if a number drawn from a hash of its id is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.llm.common import WORD, checkpointed, query, read, sized

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
# 13 hexadecimal digits are 52 bits, which a double holds exactly.
DRAW_DIGITS = 13


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on key and seed alone, so reruns and retried tasks agree."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / float(16**DRAW_DIGITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` from rows of (source, size).

    Sources by code point, NULL last, weigh ``weights`` in turn and share the total size.  No
    target exceeds ``max_repeats`` times the source's size; what is cut off goes to the others
    by weight until none is above.  That ends where every target is min(limit, level * weight):
    in the order of limit / weight the first sources stand at their limit, and the level
    follows from what the rest still has to share.  The windows run over one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = per_source.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_limit", F.lit(max_repeats) * F.col("source_size"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    shared = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    sharing = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = ranked.withColumn("_place", F.row_number().over(by_ratio)).withColumn("_level", shared / sharing)
    below = F.col("_level") * F.col("weight") <= F.col("_limit")
    levels = levels.withColumn("_first", F.min(F.when(below, F.col("_place"))).over(everything))
    levels = levels.withColumn("_final", F.max(F.when(F.col("_place") == F.col("_first"), F.col("_level"))).over(everything))
    target = F.when(F.col("_place") < F.col("_first"), F.col("_limit").cast("double"))
    target = target.otherwise(F.col("_final") * F.col("weight"))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def with_copies(docs: DataFrame, targets: DataFrame, key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """Rows with ``source_size``, ``target``, ``rate`` and ``copies``; ``docs`` has ``source`` and the key."""
    chosen = targets.select(F.col("source").alias("_source"), "source_size", "target")
    joined = docs.join(sized(chosen), docs["source"].eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = joined.withColumn("rate", rate)
    extra = draw(F.col(key), seed) < F.col("rate") - F.floor("rate")
    return rated.withColumn("copies", F.floor("rate") + extra.cast("bigint"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """What the mix takes of every document: ``doc_id, size, source_size, target, taken`` and ``rate``, ``copies``.

    A NULL or empty text has size 0 and takes 0 words.  NULL is a source of its own.  A NULL id
    draws like any one value; rows with the same id draw alike.  An empty table gives no rows.
    Only id, source and text are read; other columns are not carried.
    """
    sizes = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"))
    targets = checkpointed(source_targets(sizes.select("source", "size"), weights, max_repeats))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return with_copies(sizes, targets).select("doc_id", "size", "source_size", "target", taken, "rate", "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed documents themselves: a row for each copy, numbered by ``copy_no`` (from 1; replaces a column of that name)."""
    docs = docs.drop("copy_no")
    sizes = docs.select("source", count_words(F.col("text")).alias("size"))
    targets = checkpointed(source_targets(sizes, weights, max_repeats))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), "doc_id", "source")
    emitted = with_copies(packed, targets).filter(F.col("copies") > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy_no")
    return emitted.select("_row", copies).select("_row.*", "copy_no")


CHECK = r"""
WITH sizes AS (
 SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per_source AS (
 SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes GROUP BY source
), ranked AS (
 SELECT source, source_size, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM per_source
), levels AS (
 SELECT *, row_number() OVER by_ratio AS nth,
  CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (by_ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (by_ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lvl
 FROM ranked WINDOW by_ratio AS (ORDER BY most / weight, source NULLS LAST)
), first_free AS (
 SELECT nth AS first_nth, lvl AS final FROM levels WHERE lvl * weight <= most ORDER BY nth LIMIT 1
), targets AS (
 SELECT source, source_size, CASE WHEN nth < first_nth THEN CAST(most AS DOUBLE) ELSE final * weight END AS target FROM levels, first_free
), rated AS (
 SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  CAST(('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS draw
 FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source
), copied AS (
 SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM rated
)
SELECT doc_id, size, source_size, target, copies * size AS taken, rate, copies FROM copied
"""


@query("op4_mixing", CHECK)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents"))
