"""Rows meet the entries of a large table whose texts they may hold, by an equi join.

Each entry (a key text, a pattern) names texts that a row must hold.  Of the short pieces (grams) of
these it is filed under the one that the fewest rows hold, and rows look up the grams they have.  So the work follows the
rows and the matches, not rows times entries.  The caller tests the pairs that met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.literals import folded
from runlens.sources.tables import packed, sized, written

GRAM = 4
# Entries of few partitions are stored in files of so many, which tasks share.
FILE_ROWS = 20_000


def grams(text: Column, size: int) -> Column:
    """All pieces of ``size`` characters, those that overlap included; the empty text for size 0."""
    if not size:
        return F.array(F.lit(""))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _entry_grams(texts: Column) -> Column:
    """The grams an alternative may be filed under: of its texts of full size, else its longest text, else the empty one."""
    long = F.filter(texts, lambda t: F.length(t) >= GRAM)
    longest = F.reduce(texts, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))
    full = F.flatten(F.transform(long, lambda t: grams(t, GRAM)))
    # Most have one text; it is read by generated code.
    only = F.get(texts, F.lit(0))
    one = (F.size(texts) == 1) & (F.length(only) >= GRAM)
    return F.when(one, grams(only, GRAM)).when(F.size(long) > 0, full).otherwise(F.array(longest))


def _gram_length(texts: Column) -> Column:
    """How long the grams of ``_entry_grams`` are."""
    return F.least(F.coalesce(F.array_max(F.transform(texts, F.length)), F.lit(0)), F.lit(GRAM))


def _with_gram(rows: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """Every row beside each of its grams, once."""
    own = F.concat(*[grams(folded(F.col(text)), n) for n in lengths])
    return rows.filter(F.col(text).isNotNull()).withColumn("_gram", F.explode(F.array_distinct(own)))


def _numbered(entries: DataFrame, required: Column) -> DataFrame:
    """The entries with a number and their required texts, stored: reading expressions is dear, and is done once and by all tasks."""
    tasks = entries.sparkSession.sparkContext.defaultParallelism
    spread = packed(entries, "entry-files", FILE_ROWS) if entries.rdd.getNumPartitions() < tasks else entries
    entry = F.struct(*entries.columns).alias("_entry")
    return packed(spread.select(F.monotonically_increasing_id().alias("_id"), entry, required.alias("_required")), "entries")


def _rarest_grams(numbered: DataFrame, held: DataFrame, small: bool) -> DataFrame:
    """(_id, _nth, _place): where in the grams of an alternative the rarest stands; without alternatives that no row can match.

    Rows and place are packed into one number, so the smallest is found in the map tasks, and no text is shuffled with ``small`` held.
    Most alternatives that no row can match then go before any shuffle, by their last and middle gram; all others of them by their smallest number.
    """
    alternatives = numbered.select("_id", F.posexplode("_required").alias("_nth", "_texts"))
    listed = alternatives.select("_id", "_nth", _entry_grams(F.col("_texts")).alias("_grams"))
    if small:
        known = held.select(F.col("_gram").alias("_probe"))
        for place in (F.size("_grams") - 1, F.floor(F.size("_grams") / 2).cast("int")):
            listed = listed.withColumn("_probe", F.get("_grams", place)).join(known, "_probe", "left_semi").drop("_probe")
    filed = listed.select("_id", "_nth", F.posexplode("_grams").alias("_place", "_gram"))
    rows = F.least(F.coalesce("_rows", F.lit(0)), F.lit(2**31 - 1)).cast("bigint")
    counted = filed.join(held, "_gram", "left").select("_id", "_nth", (F.shiftleft(rows, 32) + F.col("_place")).alias("_packed"))
    best = counted.groupBy("_id", "_nth").agg(F.min("_packed").alias("_packed")).filter(F.col("_packed") >= 2**32)
    return best.select("_id", "_nth", F.col("_packed").bitwiseAND(2**32 - 1).cast("int").alias("_place"))


def meet_entries(rows: DataFrame, text: str, entries: DataFrame, required: Column) -> DataFrame:
    """Every row beside every entry of which it may hold the required texts, each pair once for each time they are given.

    ``required`` is an array of alternatives over ``entries``, each an array of folded texts; see
    ``literals.required_texts``.  An entry that requires nothing meets every row.  The counts that
    choose the grams are exact and take a pass over the rows of their own; an entry with a gram that no row holds is left
    out.  The counts and the index are measured and sent to all tasks if small, else shuffled by gram.  Rows are shuffled only
    with grams that the index has.  Rows with a NULL text meet nothing.
    """
    numbered = _numbered(entries, required)
    known = numbered.select(F.explode(F.transform("_required", _gram_length)).alias("_length")).distinct()
    lengths = sorted(r[0] for r in known.collect())
    if not lengths:
        return _nothing(rows, entries)
    held = _with_gram(rows, text, lengths).groupBy("_gram").agg(F.count(F.lit(1)).alias("_rows"))
    counts = written(held, "row-grams")
    marked = sized(counts)
    chosen = written(_rarest_grams(numbered, marked, marked is not counts), "entry-places")
    placed = numbered.join(sized(chosen.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_nth", "_place"))).alias("_places"))), "_id")
    alternatives = F.array_sort(F.map_entries("_places"))
    filed_under = F.transform(
        alternatives, lambda a: F.get(_entry_grams(F.get("_required", a["key"])), a["value"])
    )
    # Entries given several times are filed once, with their number.
    single = placed.select("_entry", filed_under.alias("_grams")).groupBy("_entry", "_grams").agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    # A row that holds the gram of an earlier alternative has met the entry there.
    filed = single.select("_entry", "_copies", "_grams", F.posexplode("_grams").alias("_nth", "_gram"))
    index = written(filed.select("_entry", "_copies", "_gram", F.slice("_grams", F.lit(1), F.col("_nth")).alias("_earlier")), "entry-index")
    asking = _with_gram(rows, text, lengths).join(sized(index.select("_gram").distinct()), "_gram", "left_semi")
    met = asking.join(sized(index), "_gram")
    new = (F.size("_earlier") == 0) | ~F.exists("_earlier", lambda gram: F.contains(folded(F.col(text)), gram))
    found = met.filter(new).select(*rows.columns, "_entry.*", "_copies")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies", "_copy")


def _nothing(rows: DataFrame, entries: DataFrame) -> DataFrame:
    empty = rows.sparkSession.createDataFrame([], entries.schema)
    return rows.withColumn("_none", F.lit(0)).join(empty.withColumn("_none", F.lit(0)), "_none").drop("_none")
