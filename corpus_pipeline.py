"""From raw documents to a training mix: the stages and the run over a whole table.

Every stage takes and, but for the last, returns the columns of ``documents``.  NULL and empty texts and NULL ids pass
the first four stages like other rows, judged as each operator says; rows given twice, ties and texts of any length need no care,
columns beside those of ``documents`` stay, and empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import read, written
from runlens.llm.decontamination import drop_leaks
from runlens.llm.linededup import drop_lines
from runlens.llm.mixing import mix
from runlens.llm.quality_cnn import keep_good
from runlens.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier takes for good; without labels all are kept."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many documents share; ``n_chars`` follows the text."""
    cleaned = drop_lines(docs, counts=False)
    columns = [F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return cleaned.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; rows without an id stay."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; without items all are kept."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document that it takes, numbered by ``copy_no``."""
    return mix(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mixed),
]

# The trained classifier has no SQL form.  Tests compare line dedup, near dedup and decontamination with brute-force versions,
# and the mix with its own SQL and a resharing loop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written to the shared work folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
