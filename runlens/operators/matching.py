"""Matching lines against configured patterns or keys.

A few patterns or keys are given as lists like any other parameter.  They become literal
expressions: the lines are read once, without a join, and every regular expression is
compiled once.  One combined expression first drops the lines that match nothing.

Thousands of them are given as tables.  Lines meet those whose required text they may hold (see
``postings``), and only these are tried, so the work hardly grows with the length of the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.literals import folded, required_texts
from runlens.operators.postings import meet_entries


class Pattern(NamedTuple):
    """A regular expression without groups, its number in the report order and its name."""

    pattern_no: int
    name: str
    pattern: str


class Suggestion(NamedTuple):
    """Advice for errors that contain a key text."""

    suggestion_no: int
    error_key: str
    suggestion: str


def match_patterns(lines: DataFrame, patterns: Sequence[Pattern] | DataFrame) -> DataFrame:
    """All matches of all patterns: the line's columns, ``pattern_no``, ``name`` and the matched text ``hit``.

    A table of patterns has the columns of ``Pattern``; rows without a pattern match nothing.
    """
    if isinstance(patterns, DataFrame):
        known = patterns.filter(F.col("pattern").isNotNull()).select("pattern_no", "name", F.col("pattern").alias("_pattern"))
        met = meet_entries(lines, "line", known, required_texts(F.col("_pattern")))
        hits = F.regexp_extract_all("line", F.col("_pattern"), F.lit(0))
        return met.withColumn("hit", F.explode(hits)).drop("_pattern")
    if not patterns:
        return lines.select("*", F.lit(0).alias("pattern_no"), F.lit("").alias("name"), F.lit("").alias("hit")).filter(F.lit(False))
    any_pattern = "|".join(f"(?:{p.pattern})" for p in patterns)

    def matches(p: Pattern) -> Column:
        hits = F.regexp_extract_all("line", F.lit(p.pattern), F.lit(0))
        return F.struct(F.lit(p.pattern_no).cast("int").alias("pattern_no"), F.lit(p.name).alias("name"), hits.alias("_hits"))

    found = F.filter(F.array(*[matches(p) for p in patterns]), lambda m: F.size(m["_hits"]) > 0)
    kept = lines.filter(F.col("line").rlike(any_pattern)).withColumn("_found", F.explode(found))
    return kept.select(*lines.columns, "_found.*").withColumn("hit", F.explode("_hits")).drop("_hits")


def match_keys(errors: DataFrame, suggestions: Sequence[Suggestion] | DataFrame, text: str) -> DataFrame:
    """All suggestions whose key text occurs in the error: the error's columns, ``suggestion_no``, ``suggestion``.

    A table of suggestions has the columns of ``Suggestion``; rows without a key fit nothing, an empty key fits all.
    """
    if isinstance(suggestions, DataFrame):
        key = F.col("_key")
        known = suggestions.filter(F.col("error_key").isNotNull()).select("suggestion_no", "suggestion", F.col("error_key").alias("_key"))
        required = F.array(F.filter(F.array(folded(key)), lambda k: k != ""))
        return meet_entries(errors, text, known, required).filter(F.contains(F.col(text), key)).drop("_key")
    if not suggestions:
        return errors.select("*", F.lit(0).alias("suggestion_no"), F.lit("").alias("suggestion")).filter(F.lit(False))

    def fitting(s: Suggestion) -> Column:
        advice = F.struct(F.lit(s.suggestion_no).cast("int").alias("suggestion_no"), F.lit(s.suggestion).alias("suggestion"))
        return F.when(F.contains(F.col(text), F.lit(s.error_key)), advice)

    found = F.array_compact(F.array(*[fitting(s) for s in suggestions]))
    return errors.withColumn("_found", F.explode(found)).select(*errors.columns, "_found.*")
