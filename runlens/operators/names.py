"""Names of a group found and replaced wherever they stand in the group's lines.

The pieces of a line that are as long as some name of its group are joined to the names by equality, so a
line meets only names that stand in it.  Pieces carry the line's key, not the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.spread import join_groups
from runlens.sources.tables import sized, written

# A line is cut into stretches of this many places, as finding a place takes a walk from the start of its text.
STRETCH = 256


def name_places(lines: DataFrame, names: DataFrame, group: str, line_key: list[str], text: str) -> DataFrame:
    """``line_key, start, key, value`` for every place (from 1) where a name of the line's group stands in it.

    ``names`` is (group, key, value); keys that are empty and values that are NULL are left out.
    """
    known = written(names.filter("key <> '' AND value IS NOT NULL").select(group, "key", "value"), "names")
    lengths = known.groupBy(group).agg(F.sort_array(F.collect_set(F.length("key"))).alias("_lengths"))
    keyed = lines.select(*line_key, F.col(text).alias("_text"))
    sought = join_groups(keyed, lengths, [group])
    longest = F.element_at("_lengths", F.lit(-1))
    firsts = F.sequence(F.lit(1), F.greatest(F.length("_text"), F.lit(1)), F.lit(STRETCH))
    cut = sought.select(*line_key, "_lengths", F.explode(firsts).alias("_first"), "_text", longest.alias("_longest"))
    cut = cut.withColumn("_text", F.substr("_text", F.col("_first"), F.col("_longest") + F.lit(STRETCH - 1)))
    sized_pieces = cut.withColumn("_length", F.explode("_lengths"))
    last = F.least(F.lit(STRETCH), F.length("_text") - F.col("_length") + 1)
    at = F.explode(F.when(last > 0, F.sequence(F.lit(1), last)))
    placed = sized_pieces.withColumn("_at", at)
    pieces = placed.select(
        *line_key, (F.col("_first") + F.col("_at") - 1).alias("start"), F.substr("_text", F.col("_at"), F.col("_length")).alias("key")
    )
    return pieces.join(sized(known), [group, "key"]).select(*line_key, "start", "key", "value")


def replaced_text(text: Column, places: Column) -> Column:
    """The text with its places (start, back, value) replaced from the left; no value is searched again.

    ``back`` is the name's length as a negative number, so that in order the longest name at a place comes first.
    """
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<since: int, start: int, value: string>>").alias("kept"))

    def step(state: Column, place: Column) -> Column:
        kept = F.array_append(state["kept"], F.struct(state["next"].alias("since"), place["start"].alias("start"), place["value"].alias("value")))
        after = F.struct((place["start"] - place["back"]).alias("next"), kept.alias("kept"))
        return F.when(place["start"] >= state["next"], after).otherwise(state)

    def told(state: Column) -> Column:
        pieces = F.transform(state["kept"], lambda k: F.concat(F.substr(text, k["since"], k["start"] - k["since"]), k["value"]))
        return F.concat(F.array_join(pieces, ""), F.substr(text, state["next"]))

    return F.reduce(places, start, step, told)


def replace_names(lines: DataFrame, names: DataFrame, group: str, number: str, text: str, out: str) -> DataFrame:
    """Lines with ``out``, their text with every name of their group replaced by its value, in one pass from the left.

    Of the names that begin at one place the longest counts.  ``group`` and ``number`` tell lines apart together
    with their text.  A line without names stays as it is.
    """
    keyed = lines.withColumn("_line", F.xxhash64(text))
    line_key = [group, number, "_line"]
    places = name_places(keyed, names, group, line_key, text)
    # One list per line, as long as the places in it.
    place = F.struct("start", F.negative(F.length("key")).alias("back"), "value")
    listed = places.groupBy(*line_key).agg(F.sort_array(F.collect_list(place)).alias("_places"))
    found = join_groups(keyed, listed, line_key, "left")
    replaced = F.when(F.col("_places").isNull(), F.col(text)).otherwise(replaced_text(F.col(text), F.col("_places")))
    return found.withColumn(out, replaced).drop("_line", "_places")
