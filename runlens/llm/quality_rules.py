"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps what was measured and one bit for
each failed rule.  A policy is a versioned mask of rules that count, so a new policy, or the
effect of leaving a rule out, needs the ledger only and never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import query, read, small_batches

SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

# Rules in bit order: a rule fails where its SQL condition over the measurements holds.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """The rules that count under one version; a document that fails any of them goes."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(rule) for rule in self.rules)


POLICIES = {p.version: p for p in (Policy(1, BASE), Policy(2, tuple(RULES)))}
CURRENT = 2


def _measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    # Continuation bytes of UTF-8 are no code points of their own.
    raw = np.frombuffer(b"".join(words), np.uint8)
    chars = int(np.count_nonzero((raw & 0xC0) != 0x80))
    symbols = sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
    seen, duplicates = set(), 0
    lines = text.split(b"\n")
    for line in lines:
        if line and not line.isspace():
            duplicates += line in seen
            seen.add(line)
    repeated = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        windows, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)[1:]
        again = counts[windows] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= again
        repeated = int(covered.sum())
    return n, chars, symbols, duplicates, repeated, len(lines)


MEASURED = T.StructType([T.StructField(name, T.LongType()) for name in (*MEASURES, "n_lines")])


@F.pandas_udf(MEASURED)
def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        found = [_measure((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        yield pd.DataFrame(found, columns=MEASURED.names)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, the measurements, and ``failed``, a bit for each failed rule.

    Words are runs of characters other than ASCII white space; a NULL text has none and one
    empty line.  Measurements replace columns of ``docs`` of the same name.  No row is dropped;
    rows given twice are measured twice, alike.
    """
    names = [*MEASURES, "n_lines", "failed"]
    kept = [docs[c] for c in docs.columns if c not in (*names, text)]
    measured = docs.select(*kept, measure(docs[text]).alias("_m")).select(*[c for c in docs.columns if c not in (*names, text)], "_m.*")
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint") for bit, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def apply_policy(ledger_rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """``kept``: no rule of the policy failed."""
    mask = F.lit(POLICIES[version].mask).cast("bigint")
    return ledger_rows.withColumn("kept", F.col("failed").bitwiseAND(mask) == 0)


def ablations(ledger_rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents failing it, and documents it alone rejects (those that come back without it).

    Failure patterns are counted first, in the map tasks; there are at most 2^rules of them.
    """
    policy = POLICIES[version]
    patterns = ledger_rows.select(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("bigint")).alias("bits"))
    patterns = patterns.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("bigint").alias("bit")) for r in policy.rules]))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    failing = F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0))
    alone = F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(failing.alias("n_failing"), alone.alias("n_only"))


CHECK = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
tokens AS (
 SELECT doc_id, generate_subscripts(w, 1) AS place, unnest(w) AS word
 FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts)
), windows AS (
 SELECT doc_id, place, word, lead(word, 1) OVER d AS second, lead(word, 2) OVER d AS third FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY place)
), found AS (
 SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n FROM windows WHERE third IS NOT NULL
), repeated AS (
 SELECT doc_id, count(DISTINCT place + shift) AS n_repeat_words FROM found, range(3) AS s(shift) WHERE n > 1 GROUP BY doc_id
), per_word AS (
 SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM tokens GROUP BY doc_id
), lines AS (
 SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts
), copies AS (
 SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
 SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines
 FROM texts t LEFT JOIN per_word USING (doc_id) LEFT JOIN copies USING (doc_id) LEFT JOIN repeated USING (doc_id)
), judged AS (
 SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
  + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 15 * n_words)::INT + 32 * (2 * n_dup_lines > n_lines)::INT AS BIGINT) AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM judged
"""


@query("op8_quality_rules", CHECK)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    judged = apply_policy(ledger(read(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("failed").bitwiseAND(F.lit(POLICIES[1].mask).cast("bigint")) != 0
    return judged.select("doc_id", *MEASURES, base.alias("base_failed"), "kept", "failed")
