"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so a question asked again with other
parameters has the same template.  Windows of the documents' templates are hash-joined with
those of the benchmark.  Where a window has placeholders, its values are checked: over one
alignment, every value of the benchmark item must stand for one value in the document.  Beside
the templates, windows are joined as they are, so a verbatim copy needs no ordinary words.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import query, read, sized

WINDOW = 8
# Templates of the benchmark with fewer ordinary words say too little; with their values they count.
MIN_LITERALS = 5
# So many windows of an item (13 words) must be found, or all of a shorter item.
MIN_MATCHED = 6
# Beyond so many bytes the items' windows are not broadcast, and those of all documents are shuffled.
ITEM_BYTES = 32 << 20

NUMBER, UNIT, NAME = "\u0001", "\u0002", "\u0003"
UNITS = (
    "kg|mg|km|cm|mm|ml|kb|mb|gb|kmh|mph|kwh|grams?|kilograms?|pounds?|ounces?|tons?|tonnes?|met(?:er|re)s?|kilomet(?:er|re)s?|miles?|feet|"
    "foot|inch(?:es)?|yards?|lit(?:er|re)s?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|degrees?|percent|dollars?|euros?|"
    "cents?|watts?|volts?|acres?|hectares?|bytes?"
)
_DIGITS = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
_AFTER = r"(?![\p{L}\p{N}])"


def with_marked(df: DataFrame, text: str = "text") -> DataFrame:
    """``marked``: the words of a text in lower case, one blank between them; a value has the mark of its kind before it.

    A number is digits with inner points or commas.  A unit is one of ``UNITS`` after a number.
    A name is a capitalised word within a sentence: one blank before it, and before that a
    letter, digit, comma or semicolon.  Inner points and commas of numbers become underscores;
    other marks separate words.
    """
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), NUMBER + UNIT + NAME + "_", "    ")
    plain = df.withColumn("marked", F.lower(F.regexp_replace(clean, r"(?<=[\p{L}\p{N},;] )(?=\p{Lu}\p{Ll})", NAME)))
    numbers = F.regexp_replace("marked", f"(?<![\\p{{L}}\\p{{N}}.,])(?={_DIGITS}(?:{UNITS})?{_AFTER})", NUMBER)
    units = F.regexp_replace(numbers, f"({NUMBER}{_DIGITS}) ?{NAME}?({UNITS}){_AFTER}", f"$1 {UNIT}$2")
    joined = F.regexp_replace(units, r"(?<=\p{Nd})[.,](?=\p{Nd})", "_")
    # Most texts have no digit and need no look for numbers.
    words = plain.withColumn("marked", F.when(F.col("marked").rlike(r"\p{Nd}"), joined).otherwise(F.col("marked")))
    return words.withColumn("marked", F.btrim(F.regexp_replace("marked", "[^\\p{L}\\p{N}_\u0001-\u0003]+", " ")))


def windows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows for each run of ``WINDOW`` words: key, ``h`` (hash of its template), ``place``, ``found`` (its marked values or NULL), ``more``.

    A run with values has a second row, where ``h`` is the hash of its words without marks,
    ``found`` is NULL, as in runs without values, and ``more`` is true.  Hashes of 8 words are made of those of 4, and
    these of 2, so a word is hashed once only in each form.
    """
    words = with_marked(docs.select(key, text), text).select(key, "marked")
    words = words.withColumn("has", F.col("marked").rlike("[\u0001-\u0003]"))
    template = F.when(F.col("has"), F.regexp_replace("marked", "([\u0001-\u0003])[^ ]+", "$1")).otherwise(F.col("marked"))
    verbatim = F.when(F.col("has"), F.translate("marked", NUMBER + UNIT + NAME, ""))
    runs = words
    for name, form in (("h", template), ("same", verbatim)):
        runs = runs.withColumn(name, F.transform(F.split(form, " "), lambda w: F.xxhash64(w)))
        half = 1
        while half < WINDOW:
            left = F.greatest(F.size(name) - half, F.lit(0))
            pairs = F.zip_with(F.slice(name, F.lit(1), left), F.slice(name, F.lit(half + 1), left), lambda a, b: F.xxhash64(a, b))
            runs = runs.withColumn(name, pairs)
            half *= 2
    runs = runs.withColumn("words", F.when(F.col("has"), F.split("marked", " ")))

    def values(at: Column) -> Column:
        # Marked values sort below all words.
        run = F.slice("words", at, WINDOW)
        return F.when(F.array_min(run) < "\u0004", F.filter(run, lambda w: w < "\u0004"))

    found = F.when(F.col("has"), F.transform("h", lambda _, i: values(i + 1)))
    # The second rows follow the first ones; runs without values have no second hash.
    second = F.zip_with("same", "h", lambda a, b: F.when(a != b, a))
    hashes = F.concat("h", F.coalesce(second, F.array().cast("array<bigint>"))).alias("h")
    zipped = F.arrays_zip(hashes, F.coalesce(found, F.array().cast("array<array<string>>")).alias("found"))
    rows = runs.select(key, F.size("h").alias("n"), F.posexplode(zipped).alias("at", "w")).filter(F.col("w")["h"].isNotNull())
    place, more = (F.col("at") % F.col("n")).alias("place"), (F.col("at") >= F.col("n")).alias("more")
    return rows.select(key, "w.h", place, F.col("w")["found"].alias("found"), more)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that hold a benchmark item, one row for each document (id and text) and item.

    Columns: ``doc_id, item_id, n_matched`` (windows of the item found; templates only, where these
    are enough), ``n_windows`` (all of the item), ``reparameterised`` (some counted value differs from the
    item's).  A window is found if its words and values are, or its template, where that has
    ``MIN_LITERALS`` ordinary words.  A pair is given if at least ``MIN_MATCHED`` windows, or all windows of a shorter item, are found
    in alignments with consistent values; windows equal in words and values count in every
    alignment.  Items are also indexed in lower case, where nothing is
    a name, so a copy in other case is found as well, and with their first word as within a
    sentence, where it may be a name.  Items of fewer than ``WINDOW`` words, NULL
    and empty texts match nothing.  Rows with a NULL id are searched like others; rows of one id, or of NULL, with
    different texts are documents of their own.  Rows given twice give one row.  Copies of a benchmark row count once.
    An empty table on either side gives no rows; texts of any length are searched whole.
    """
    return _leaks(docs, benchmark, key).drop("_text")


def _text_hash() -> Column:
    """What tells apart rows of one id."""
    return F.xxhash64("text", F.octet_length("text"))


def _leaks(docs: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    """``leaks``, and in ``_text`` the hash of the document's text."""
    items = benchmark.select("item_id", "text").distinct()
    items = items.unionByName(items.withColumn("text", F.lower("text"))).distinct()
    within = windows(benchmark.select("item_id", F.concat(F.lit(", "), F.ltrim("text")).alias("text")), "item_id")
    within = within.filter((F.col("place") == 0) & F.col("found").isNotNull()).withColumn("more", F.lit(True))
    item = windows(items, "item_id").unionByName(within).distinct()
    item = item.withColumnsRenamed({"place": "item_place", "found": "asked", "more": "_more"})
    literals = WINDOW - F.coalesce(F.size("asked"), F.lit(0))
    # Cheap beside the documents, so it is computed again where it is used instead of written.
    totals = item.groupBy("item_id").agg(F.countDistinct("item_place").alias("n_windows"))
    item = item.filter(F.col("asked").isNull() | (literals >= MIN_LITERALS))
    # A document's id may be NULL or stand for several texts, so both are grouped as a struct.
    found = windows(docs.select(F.struct(F.col(key).alias("doc_id"), _text_hash().alias("text")).alias("d"), "text"), "d")
    # One shuffle serves all groupings
    # below; what meets in it, the hits of one item in one document, is bounded by their lengths.
    shift, more = (F.col("place") - F.col("item_place")).alias("shift"), (F.col("more") | F.col("_more")).alias("more")
    met = found.join(sized(item, ITEM_BYTES), "h").select("d", "item_id", "item_place", shift, "asked", "found", more)
    met = met.repartition("d", "item_id")
    # A value of the item must stand for one value; else only windows that are as in the item count.
    runs = met.groupBy("d", "item_id", "shift").agg(
        F.collect_set(F.when(~F.col("more"), F.col("item_place"))).alias("by_template"),
        F.collect_set(F.when(F.col("asked").isNull(), F.col("item_place"))).alias("verbatim"),
        F.collect_set("item_place").alias("places"),
        F.collect_set(F.when(F.col("asked").isNotNull(), F.arrays_zip("asked", "found"))).alias("values"),
    )
    runs = runs.withColumn("values", F.array_distinct(F.flatten("values")))
    runs = runs.withColumn("broken", F.size("values") != F.size(F.array_distinct("values.asked")))
    runs = runs.select(
        "d",
        "item_id",
        F.when(F.col("broken"), F.array_intersect("by_template", "verbatim")).otherwise(F.col("by_template")).alias("by_template"),
        F.when(F.col("broken"), F.col("verbatim")).otherwise(F.col("places")).alias("places"),
        (~F.col("broken") & F.exists("values", lambda v: v["asked"] != v["found"])).alias("changed"),
    )

    def n_places(name: str) -> Column:
        return F.size(F.array_distinct(F.flatten(F.collect_list(name)))).cast("bigint")

    pairs = runs.groupBy("d", "item_id").agg(
        n_places("by_template").alias("by_template"),
        n_places("places").alias("n_matched"),
        F.max("changed").alias("reparameterised"),
    )
    needed = F.least(F.lit(MIN_MATCHED), F.col("n_windows"))
    found = pairs.join(totals, "item_id").filter(F.col("n_matched") >= needed)
    n_matched = F.when(F.col("by_template") >= needed, F.col("by_template")).otherwise(F.col("n_matched")).alias("n_matched")
    return found.select("d.doc_id", "item_id", n_matched, "n_windows", "reparameterised", F.col("d.text").alias("_text"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, with the columns of ``docs``.

    Only the row whose own text holds an item goes, also among rows of one id or of NULL.
    """
    gone = _leaks(docs, benchmark, "doc_id").select(F.struct(F.col("doc_id"), F.col("_text")).alias("_gone")).distinct()
    own = docs.withColumn("_own", F.struct(F.col("doc_id"), _text_hash().alias("_text")))
    return own.join(gone, own["_own"] == gone["_gone"], "left_anti").drop("_own")


# Digits are left as they are here: where no benchmark item has one, no window with one can match.
CHECK = r"""
WITH texts AS (
 SELECT doc_id AS id, true AS is_doc, translate(coalesce(text, ''), '_' || chr(1) || chr(2) || chr(3), '    ') AS text FROM documents
 UNION ALL SELECT item_id, false, translate(text, '_', ' ') FROM benchmark WHERE text IS NOT NULL
 UNION ALL SELECT item_id, false, lower(translate(text, '_', ' ')) FROM benchmark WHERE text IS NOT NULL
), parts AS (SELECT id, is_doc, string_split(text, ' ') AS p FROM texts),
named AS (
 SELECT id, is_doc, list_transform(p, lambda x, i : CASE WHEN i > 1 AND regexp_matches(x, '^\p{Lu}\p{Ll}') AND regexp_matches(p[i - 1], '[\p{L}\p{N},;]$')
  THEN chr(3) || x ELSE x END) AS p FROM parts
), templates AS (
 SELECT id, is_doc, string_split(regexp_replace(trim(regexp_replace(lower(array_to_string(p, ' ')), '[^\p{L}\p{N}_\x{3}]+', ' ', 'g')), '\x{3}[^ ]+', chr(3), 'g'), ' ') AS w
 FROM named
), windows AS (
 SELECT id, is_doc, place, array_to_string(w[place : place + 7], ' ') AS h FROM (SELECT id, is_doc, w, unnest(range(1, len(w) - 6)) AS place FROM templates)
), items AS (
 SELECT DISTINCT id AS item_id, place, h FROM windows WHERE NOT is_doc AND length(h) - length(replace(h, chr(3), '')) <= 3
), totals AS (SELECT item_id, count(DISTINCT place) AS n_windows FROM items GROUP BY item_id),
met AS (
 SELECT d.id AS doc_id, i.item_id, count(DISTINCT i.place) AS n_matched FROM windows d JOIN items i ON d.is_doc AND d.h = i.h GROUP BY d.id, i.item_id
)
SELECT doc_id, item_id, n_matched, n_windows, false AS reparameterised FROM met JOIN totals USING (item_id) WHERE n_matched >= least(6, n_windows)
"""


@query("op2_decontamination", CHECK)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
