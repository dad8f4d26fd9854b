"""Per-key work that must not put one large key into one task.

A key may hold a third of a table.  These operators split such keys: joins are written in a
form adaptive execution can split, numbering works inside ordered parts of a key, and nested
arrays are cut into pages of bounded size.  Numbering and nesting take NULL as a key like any
other; joins match no NULL, as in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.sources.tables import sized, work_dir, written

PAGE_SIZE = 20_000
# Left rows without a match are shared out over this many stand-in rows.
STAND_INS = 200


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows with a table that has one row per key, such as an aggregate.

    Adaptive execution splits a skewed partition only where both join inputs are fresh
    shuffles.  An aggregate by ``keys`` is laid out by them already and would be joined in
    place, all rows of a large key in one task.  Joining on the keys packed into a struct
    gives both sides a shuffle of their own.
    """
    known = groups.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    packed = known.withColumn("_key", F.struct(*keys)).drop(*keys)
    return rows.withColumn("_key", F.struct(*keys)).join(packed, ["_key"], how).drop("_key")


def left_join_spread(
    left: DataFrame, right: DataFrame, on: list[str], size: str | None = None, keys_of: DataFrame | None = None
) -> DataFrame:
    """LEFT JOIN for a right side in which one key may be very frequent.

    Adaptive execution splits a skewed partition on either side of an inner join, but never
    the null-supplying side of an outer join.  So the right side's rows are first counted per
    key, reduced in the map tasks.  A left row with a count meets the right side, one without meets one of
    some stand-in rows of NULLs, in one inner join; each input is read once more than a plain join reads it at most.

    ``size`` names a column that keeps the count (NULL without a match).  ``keys_of`` is a
    cheaper input with the same keys as ``right``, and at least as many rows per key, to count.
    """
    count = size or "_size"
    sizes = (right if keys_of is None else keys_of).groupBy(*on).agg(F.count(F.lit(1)).alias(count))
    counted = join_groups(left, sizes, on, "left")
    # Fields of a struct match where both are NULL; a real key has the place 0, so none meets a stand-in.
    own = F.struct(*on, F.lit(0).cast("bigint").alias("_place"))
    kinds = dict(right.dtypes)
    missing = [F.lit(None).cast(kinds[c]).alias(c) for c in on]
    stand_in = F.struct(*missing, (F.pmod(row_hash(left), F.lit(STAND_INS)) + 1).cast("bigint").alias("_place"))
    asking = counted.withColumn("_key", F.when(F.col(count).isNotNull(), own).otherwise(stand_in))
    payload = [c for c in right.columns if c not in on]
    answers = right.select(own.alias("_key"), *payload)
    nothing = right.sparkSession.range(STAND_INS).select(
        F.struct(*missing, (F.col("id") + 1).alias("_place")).alias("_key"), *[F.lit(None).cast(kinds[c]).alias(c) for c in payload]
    )
    joined = asking.join(answers.unionByName(nothing), "_key").drop("_key")
    return joined if size else joined.drop(count)


def with_group_size(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Rows with the number of rows of their key; for inputs that do not carry it already."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return join_groups(df, sizes, keys)


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's columns but for maps, which have no order."""
    return F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])


def ordered_parts(df: DataFrame, keys: list[str], order: list[Column], out: str = "_part") -> DataFrame:
    """Rows with the number of the range of (keys, order) they are in; ranges have about equally many rows.

    All rows of a part come before those of the next, and a key's rows may lie in many parts,
    so a large key, or many rows of one moment, is spread over tasks.  Rows equal in keys and
    order are told apart by a hash of the row.  The parts are written to the shared work folder:
    a part's number must not depend on which reader computes it again.
    """
    spark = df.sparkSession
    ranged = df.withColumn("_tie", row_hash(df)).repartitionByRange(*[F.asc(k) for k in keys], *order, F.asc("_tie")).drop("_tie")
    path = work_dir(spark, "ordered-parts")
    ranged.withColumn(out, F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def number_rows(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """``row_number()`` per key, computed inside ordered parts."""
    return number_parts(ordered_parts(df, keys, order), keys, order, out).drop("_part")


def number_parts(parts: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """``row_number()`` per key over the rows of ``ordered_parts``.

    Rows are numbered within their part and shifted by the number of the key's rows in the
    parts before it, a sum over one count per key and part.
    """
    # The keys as one struct, which is never NULL, so that a join by it keeps NULL keys.
    keyed = parts.withColumn("_group", F.struct(*keys))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("_group", "_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_group", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    # Ties in the order must fall the same way as between parts.
    inside = F.row_number().over(Window.partitionBy("_group", "_part").orderBy(*order, row_hash(parts.drop("_part"))))
    return (
        keyed.withColumn("_inside", inside)
        .join(offsets, ["_group", "_part"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .select(*parts.columns, out)
    )


def previous_value(
    df: DataFrame, keys: list[str], position: str, value: str, out: str, slice_width: int = 100_000
) -> DataFrame:
    """``lag(value)`` per key in ``position`` order, computed inside slices of ``slice_width`` positions.

    The first row of a slice takes the last value of the nearest earlier slice.  Positions
    must be unique within a key.
    """
    sliced = df.withColumn("_group", F.struct(*keys)).withColumn("_slice", F.floor(F.col(position) / slice_width))
    ends = sliced.groupBy("_group", "_slice").agg(F.max_by(value, position).alias("_end"))
    ends = ends.select("_group", "_slice", F.lag("_end").over(Window.partitionBy("_group").orderBy("_slice")).alias("_carried"))
    inside = Window.partitionBy("_group", "_slice").orderBy(position)
    first = F.row_number().over(inside) == 1
    return (
        sliced.withColumn("_first", first)
        .withColumn("_lag", F.lag(value).over(inside))
        .join(ends, ["_group", "_slice"])
        .withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag")))
        .select(*df.columns, out)
    )


def carried_forward(
    df: DataFrame, keys: list[str], position: str, value: str, out: str, slice_width: int = 100_000
) -> DataFrame:
    """The last ``value`` that is not NULL at or before each position of its key, computed inside slices of positions.

    Rows of a slice before its first value take the last one of the slices before.  Positions must be unique within a key.
    """
    sliced = df.withColumn("_group", F.struct(*keys)).withColumn("_slice", F.floor(F.col(position) / slice_width))
    ends = sliced.groupBy("_group", "_slice").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position))).alias("_end"))
    before = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_group", "_slice", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("_group", "_slice").orderBy(position)
    return (
        sliced.withColumn("_own", F.last(value, ignorenulls=True).over(inside))
        .join(ends, ["_group", "_slice"])
        .withColumn(out, F.coalesce("_own", "_carried"))
        .select(*df.columns, out)
    )


def first_seen(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Distinct keys with the smallest ``order`` at which each was seen; combined in the map tasks."""
    smallest = F.struct(F.min(order[0]).alias(order[0])) if len(order) == 1 else F.min(F.struct(*order))
    return df.groupBy(*keys).agg(smallest.alias(out))


def nest_rows(
    df: DataFrame,
    keys: list[str],
    header: list[Column],
    item: list[Column],
    out: str,
    page_size: int = PAGE_SIZE,
    first_by: list[Column] | None = None,
) -> DataFrame:
    """One row per key and page: the header of the key's first row and a sorted array of items.

    Items are in order over the pages of a key: page n holds the items from place
    n * ``page_size`` on, so no row of the result grows without bound.  "First" means smallest
    ``first_by`` (by default the smallest item) and does not depend on the pages.

    The rows are written to the shared work folder first, so their input runs once, while this is called.  Keys
    of at most one page are nested in one shuffle; the rows of larger keys are numbered in ordered parts.
    """
    order = [F.struct(*first_by).alias("_order")] if first_by else []
    key = F.struct(*keys).alias("_key")
    packed = written(df.select(key, F.struct(*header).alias("_header"), F.struct(*item).alias("_item"), *order), "nested-rows")
    head = F.min_by("_header", "_order" if first_by else "_item").alias("_header")
    sizes = packed.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"))
    large = written(sizes.filter(F.col("_rows") > page_size).select("_key"), "large-keys")
    columns = ["_key.*", "page", "_header.*", out]
    if large.isEmpty():
        return _one_page(packed, head, out).select(*columns)
    large = sized(large)
    parts = ordered_parts(packed.join(large, "_key", "left_semi"), ["_key"], [F.asc("_item")])
    heads = parts.groupBy("_key").agg(head)
    placed = number_parts(parts.select("_key", "_item", "_part"), ["_key"], [F.asc("_item")], "_place")
    page = F.floor((F.col("_place") - 1) / page_size).cast("bigint")
    # The shuffle by key and page is explicit: grouping must not inherit a layout by key alone.
    pages = (
        placed.select("_key", page.alias("page"), "_item")
        .repartition("_key", "page")
        .groupBy("_key", "page")
        .agg(F.sort_array(F.collect_list("_item")).alias(out))
    )
    whole = _one_page(packed.join(large, "_key", "left_anti"), head, out)
    return pages.join(heads, "_key").unionByName(whole).select(*columns)


def _one_page(packed: DataFrame, head: Column, out: str) -> DataFrame:
    """Keys of at most one page, nested."""
    items = F.sort_array(F.collect_list("_item")).alias(out)
    return packed.groupBy("_key").agg(head, items).withColumn("page", F.lit(0).cast("bigint"))
