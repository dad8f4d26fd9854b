"""Line deduplication over levelled sorted runs of line hashes.

Documents arrive in batches.  Each batch's line hashes are merge-anti-joined with the settled
hashes (lines already known to be in enough documents, whose counting is over); the rest are
written as a sorted run with the number of documents that have them.  When a level has
``fanout`` runs they are compacted into one run of the next level, and hashes that reach the
limit move to the settled ones.  After the last batch the runs are merged, and the settled
hashes say which lines go.  Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import WHITE, ascii_lower, query, read, written
from runlens.sources.tables import work_dir

HASH = ["h1", "h2"]


class LineRuns:
    """The state of a line dedup: settled hashes and, by level, the sorted runs of counted hashes."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder = work_dir(spark, "line-runs")
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []
        self.made = 0

    def add(self, counted: DataFrame) -> None:
        """Take in a batch: rows of (h1, h2, n_docs), a hash at most once."""
        self._put(self._open(counted), 0)

    def frequent(self) -> DataFrame:
        """Merge all runs; the hashes (h1, h2) found in at least ``min_docs`` documents."""
        runs = [run for level in self.levels for run in level]
        if runs:
            self._settle(runs)
            self.levels = []
        if not self.settled:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        return reduce(DataFrame.unionByName, self.settled)

    def _open(self, counted: DataFrame) -> DataFrame:
        for settled in self.settled:
            counted = counted.join(settled.hint("merge"), HASH, "left_anti")
        return counted

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._write(run.repartition(*HASH).sortWithinPartitions(*HASH)))
        if len(self.levels[level]) == self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(self._settle(runs), level + 1)

    def _settle(self, runs: list[DataFrame]) -> DataFrame:
        """Sum runs; hashes that reach the limit become settled, the others are returned."""
        summed = reduce(DataFrame.unionByName, runs).groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"))
        merged = self._write(self._open(summed))
        done = merged.filter(F.col("n_docs") >= self.min_docs).select(*HASH)
        self.settled.append(done)
        return merged.filter(F.col("n_docs") < self.min_docs)

    def _write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema("h1 bigint, h2 bigint, n_docs bigint").parquet(path)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def hashed_lines(docs: DataFrame, min_length: int) -> DataFrame:
    """A row for each document and distinct line: doc_id, text_hash, h1, h2, places of the line."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode("lines").alias("place", "line"))
    keyed = keyed.withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= min_length)
    # Two hashes with different seeds: at very many lines a single one of 64 bits would collide.
    hashes = F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    rows = keyed.select("doc_id", "text_hash", *hashes, "place")
    return rows.groupBy("doc_id", "text_hash", *HASH).agg(F.collect_set("place").alias("places"))


def drop_lines(
    docs: DataFrame, min_docs: int = 10, min_length: int = 1, batches: int = 6, fanout: int = 3, text: str = "text", counts: bool = True
) -> DataFrame:
    """Documents without the lines whose key occurs in at least ``min_docs`` documents.

    A key is the line without white space at the ends and with A-Z in lower case; keys shorter
    than ``min_length`` code points always stay.  All columns of ``docs`` are kept, ``text`` is
    replaced (NULL becomes an empty text), and ``n_lines`` (before) and ``n_dropped`` are added
    (in place of columns of these names) unless ``counts`` is false.
    Documents are told apart by ``doc_id`` and text, so a row given twice counts once and both
    rows lose the same lines.  NULL ids are allowed.  An empty table gives no rows.
    ``batches`` says in how many parts the table is taken in; it does not change the result.
    """
    spark = docs.sparkSession
    known = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", known.alias("text")).withColumn("lines", F.split("text", "\n", -1))
    lines = hashed_lines(rows, min_length).withColumn("batch", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(batches)))
    lines = written(lines, "line-hashes")
    counted = written(lines.groupBy("batch", *HASH).agg(F.count(F.lit(1)).alias("n_docs")), "line-batches")

    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        runs.add(counted.filter(F.col("batch") == batch).select(*HASH, "n_docs"))

    # Only places travel from the hashes to the documents; texts move once, to meet them.
    hits = lines.join(runs.frequent().hint("merge"), HASH, "left_semi")
    drops = hits.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("places")).alias("_drop"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("_id"), F.xxhash64(known).alias("_hash"))
    met = packed.join(drops, packed["_id"].eqNullSafe(drops["doc_id"]) & (packed["_hash"] == drops["text_hash"]), "left")
    met = met.withColumn("_text", F.coalesce(F.col("_row")[text], F.lit(""))).withColumn("_lines", F.split("_text", "\n", -1))
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    stay = F.array_except(places, F.col("_drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    kept = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(kept)
    dropped = F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("bigint")
    added = [F.size("_lines").cast("bigint").alias("n_lines"), dropped.alias("n_dropped")] if counts else []
    own = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    return met.select(*[kept.alias(c) if c == text else F.col("_row")[c].alias(c) for c in own], *added)


CHECK = r"""
WITH lines AS (
 SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line
 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
 SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
 SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
 SELECT doc_id, place, line, k IN (SELECT k FROM frequent) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op7_line_dedup", CHECK)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
