"""SimHash near-duplicates found by deletion-variant signatures.

Two fingerprints that differ in at most ``d`` bits, cut into more than d/2 segments, have a
segment that differs in at most one bit.  So each fingerprint is indexed by every segment with
one bit left out at a time; equal keys are joined and the whole fingerprints compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import checkpointed, query, read, small_batches
from runlens.llm.components import components

BITS, SHINGLE, MAX_BITS, SEED = 64, 4, 4, 42
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number; 0 for a text without words."""
    # bytes.lower() and bytes.split() know ASCII letters and ASCII white space only.
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprint_column(words: int = SHINGLE):
    @F.pandas_udf(T.LongType())
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return fingerprints


def segments(max_bits: int) -> list[int]:
    """Masks of the fewest segments of which one must differ in at most one bit."""
    count = max_bits // 2 + 1
    edges = [round(i * BITS / count) for i in range(count + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All pairs a < b of the distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits, each pair once.

    A pair may share many keys.  It is given by the first segment that qualifies only: at the
    wildcard of the bit in which it differs there, or the segment's first wildcard if it does not.
    """
    masks = segments(max_bits)
    of = [next(i for i, m in enumerate(masks) if m >> bit & 1) for bit in range(BITS)]
    first = [bit == 0 or of[bit] != of[bit - 1] for bit in range(BITS)]
    wildcards = [
        F.struct(
            F.lit(bit).alias("wildcard"),
            F.col("fp").bitwiseAND(F.lit(_signed(masks[of[bit]] & ~(1 << bit)))).alias("key"),
        )
        for bit in range(BITS)
    ]
    index = prints.select("fp", F.explode(F.array(*wildcards)).alias("v")).select("fp", "v.wildcard", "v.key")
    # Spark takes the index to be about as large as the fingerprints, 64 times too small, and would broadcast it.
    a, b = index.alias("a"), index.hint("merge").alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    close = F.bit_count(differ) <= max_bits
    place = F.col("a.wildcard")

    def literal(values: list[int]):
        return F.element_at(F.array(*[F.lit(v) for v in values]), place + 1)

    # Qualifying at this wildcard: the segment differs in this bit alone, or not at all and the bit is its first.
    inside = differ.bitwiseAND(literal([_signed(masks[s]) for s in of]))
    here = (inside == literal([_signed(1 << bit) for bit in range(BITS)])) | ((inside == 0) & literal(first))
    earlier = F.lit(True)
    for i, mask in enumerate(masks[:-1]):
        earlier = earlier & ((literal(of) <= i) | (F.bit_count(differ.bitwiseAND(F.lit(_signed(mask)))) > 1))
    same_key = (F.col("a.wildcard") == F.col("b.wildcard")) & (F.col("a.key") == F.col("b.key"))
    return a.join(b, same_key & (F.col("a.fp") < F.col("b.fp")) & close & here & earlier).select(
        F.col("a.fp").alias("a"), F.col("b.fp").alias("b")
    )


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE, max_bits: int = MAX_BITS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, fp, component_id, n_linked`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, the row's own included;
    ``n_linked`` counts the other fingerprints within ``max_bits``.  Equal fingerprints are one
    class, found by an aggregate, so copies are never paired.  NULL and blank texts have
    fingerprint 0 and link like any other.  Rows with a NULL id belong to components like any
    other and never name one; a component of NULL ids only has a NULL component_id.  Rows given
    twice appear twice.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    prints = docs.select(docs[key].alias("doc_id"), fingerprint_column(words)(docs[text]).alias("fp"))
    prints = checkpointed(prints)
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("lowest"))
    pairs = checkpointed(links(classes.select("fp"), max_bits))
    roots = components(pairs)
    ends = F.explode(F.array("a", "b")).alias("node")
    degree = pairs.select(ends).groupBy("node").agg(F.count(F.lit(1)).alias("n_linked"))
    grouped = classes.join(roots, classes["fp"] == roots["node"], "left").drop("node")
    grouped = grouped.join(degree, grouped["fp"] == degree["node"], "left").drop("node")
    grouped = grouped.withColumn("root", F.coalesce("root", "fp")).withColumnRenamed("fp", "class")
    # Struct keys give the joins shuffles of their own, so the rows of a large component or a hot fingerprint can be split.
    named = grouped.groupBy("root").agg(F.min("lowest").alias("component_id")).select(F.struct("root").alias("r"), "component_id")
    named = grouped.join(named, F.struct("root") == F.col("r")).select("class", "component_id", F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    met = prints.join(named.select(F.struct("class").alias("k"), "component_id", "n_linked"), F.struct(F.col("fp").alias("class")) == F.col("k"))
    return met.select("doc_id", "fp", "component_id", "n_linked")


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without the rows that a component with a smaller ``doc_id`` makes superfluous.

    The rows with the component's id stay (a row given twice stays twice).  Rows with a NULL id
    stay too: they cannot be told apart.
    """
    found = near_duplicates(docs, words, max_bits)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_linked")
