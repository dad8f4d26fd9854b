"""Toxicity: class-conditional Kneser-Ney models of bytes.

Windows of five bytes are counted in all documents, and apart in the toxic and the ordinary labelled ones.  Each
class has an interpolated Kneser-Ney model: its own counts of five bytes, its own numbers of bytes met before four and
three, and below that backoff counts that both share and that all documents give, so that rare expressions
are smoothed alike on both sides.  A place in a text adds the difference of the two log-likelihoods of its byte.
Divided by the length, the differences of the whole text and of its most toxic stretch give the score.

Counting, discounts, probabilities and backoff weights are joins and aggregates of tables that grow with the
corpus.  For scoring they are cut into pieces of bounded size by the two bytes before the one to be judged; every
piece judges its own places in all texts, and the whole-number results of several pieces are added up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import query, read, sized, written

ORDER, OWN = 5, 3
STRETCH, STEP = 24, 8
# Log-likelihoods are kept in whole steps of 1 / UNIT, so that sums do not depend on their order.
UNIT = 10_000
BLOCK = 1 << 20
TASK_ENTRIES = 1 << 22
# A, B, ... as a, b, ...; tab, line feed, vertical tab, form feed and carriage return as a blank.
FOLDED = bytes(32 if c in b"\t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
PAD = b" " * (ORDER - 1)
# What a document counts for: neither class, or toxic and ordinary in either half of the labelled ones.
NEITHER, TOXIC_A, ORDINARY_A, TOXIC_B, ORDINARY_B = range(5)


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit: documents that calibrate the score, entries of a piece, bytes of labels to broadcast.

    Results do not depend on the last two.
    """

    max_docs: int = 4000
    piece_entries: int = 1 << 22
    label_bytes: int = 64 << 20


def packed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last five bytes up to each byte as one number, and where each text's bytes start and how many they are."""
    folded = [(t or "").encode("utf-8", "surrogatepass").translate(FOLDED) for t in texts]
    data = np.frombuffer(b"".join(PAD + t for t in folded), np.uint8)
    sizes = np.array([len(t) for t in folded], np.int64)
    starts = np.cumsum(sizes + len(PAD)) - sizes
    codes = np.zeros(len(data), np.int64)
    for back in range(ORDER):
        codes[back:] |= data[: len(data) - back].astype(np.int64) << (8 * back)
    return codes, starts, sizes


def blocks(texts: pd.Series | list) -> Iterator[tuple[int, list[str | None]]]:
    """Neighbouring texts of about ``BLOCK`` characters together, with the place of the first; long ones alone."""
    block, filled, at = [], 0, 0
    for i, text in enumerate(texts):
        block.append(text)
        filled += len(text or "")
        if filled >= BLOCK:
            yield at, block
            block, filled, at = [], 0, i + 1
    if block:
        yield at, block


def count_windows(docs: DataFrame) -> DataFrame:
    """``code, n, toxic_a, ordinary_a, toxic_b, ordinary_b``: windows of five bytes of (text, part); combined inside tasks first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(keys >> 3), pa.array((keys & 7).astype(np.int32)), pa.array(counts)]
            return pa.RecordBatch.from_arrays(columns, ["code", "part", "n"])

        for batch in batches:
            parts = np.asarray(batch.column(1), np.int64)
            for at, texts in blocks(batch.column(0).to_pylist()):
                codes, starts, sizes = packed(texts)
                owner = np.repeat(np.arange(len(texts)), sizes)
                place = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(owner))
                keys, counts = np.unique(codes[place] << 3 | parts[at + owner], return_counts=True)
                held.append((keys, counts))
            if sum(len(k) for k, _ in held) > TASK_ENTRIES:
                held = [merged()]
                if len(held[0][0]) > TASK_ENTRIES // 2:
                    yield rows(*held.pop())
        if held:
            yield rows(*merged())

    found = docs.mapInArrow(counted, "code bigint, part int, n bigint")

    def of(part: int, name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("part") == part, F.col("n"))), F.lit(0)).alias(name)

    return found.groupBy("code").agg(
        F.sum("n").alias("n"), of(TOXIC_A, "toxic_a"), of(ORDINARY_A, "ordinary_a"), of(TOXIC_B, "toxic_b"), of(ORDINARY_B, "ordinary_b")
    )


def discount(once: int | None, twice: int | None) -> float:
    """Absolute discount from the numbers of windows met once and twice."""
    once, twice = once or 0, twice or 0
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.75


def _tail(code: str, size: int) -> Column:
    """The last ``size`` bytes of a window."""
    return F.col(code).bitwiseAND(F.lit((1 << 8 * size) - 1))


def _discounts(counts: DataFrame, classes: list[str]) -> dict[str, float]:
    def met(c: str, times: int) -> Column:
        return F.sum((F.col(c) == times).cast("bigint")).alias(f"{c}_{times}")

    row = counts.agg(*[met(c, times) for c in classes for times in (1, 2)]).first()
    return {c: discount(row[f"{c}_1"], row[f"{c}_2"]) for c in classes}


def build_model(windows: DataFrame) -> DataFrame:
    """``role, size, code, value``: steps by which toxic beats ordinary, of windows (role 0) and of backing off from contexts (1).

    ``windows`` has ``code, n, toxic, ordinary``.  Sizes 3 to 5 are there; a window in neither class is not, as backing
    off says the same of it, and shorter ones favour neither class.
    """
    counts = {ORDER: windows}
    for size in range(ORDER - 1, 0, -1):
        # Kneser-Ney: below the top, a window counts the different bytes met before it.
        longer = counts[size + 1].withColumn("code", _tail("code", size))
        met = [F.sum((F.col(c) > 0).cast("bigint")).alias(c) for c in ("n", "toxic", "ordinary")]
        counts[size] = written(longer.groupBy("code").agg(*met), f"toxicity-windows-{size}")
    lower = None
    pieces = []
    for size in range(1, ORDER + 1):
        own = size >= OWN
        classes = ["toxic", "ordinary"] if own else ["n"]
        cut = _discounts(counts[size], classes)
        context = F.shiftright("code", 8).alias("context")
        table = counts[size].select("code", context, _tail("code", size - 1).alias("tail"), "n", "toxic", "ordinary")
        sums = [F.sum(c).alias(f"sum_{c}") for c in classes]
        kinds = [F.sum((F.col(c) > 0).cast("bigint")).alias(f"kinds_{c}") for c in classes]
        contexts = table.groupBy("context").agg(*sums, *kinds)
        for c in classes:
            total, kind = F.col(f"sum_{c}"), F.col(f"kinds_{c}")
            contexts = contexts.withColumn(f"back_{c}", F.when(total > 0, F.lit(cut[c]) * kind / total).otherwise(F.lit(1.0)))
        joined = table.join(contexts, "context")
        if lower is None:
            joined = joined.withColumn("p_toxic", F.lit(1 / 256)).withColumn("p_ordinary", F.lit(1 / 256))
        else:
            joined = joined.join(lower.withColumnRenamed("code", "tail"), "tail")
        for c, p in (("toxic", "p_toxic"), ("ordinary", "p_ordinary")):
            source = c if own else "n"
            kept = F.greatest(F.col(source) - F.lit(cut[source]), F.lit(0.0)) / F.greatest(F.col(f"sum_{source}"), F.lit(1))
            joined = joined.withColumn(p, kept + F.col(f"back_{source}") * F.col(p))
        lower = joined.select("code", "p_toxic", "p_ordinary", "toxic", "ordinary")
        if own:
            lower = written(lower, f"toxicity-model-{size}")
            ratio = F.round((F.log("p_toxic") - F.log("p_ordinary")) * UNIT).cast("int")
            seen = lower.filter("toxic > 0 OR ordinary > 0")
            pieces.append(seen.select(F.lit(0).alias("role"), F.lit(size).alias("size"), "code", ratio.alias("value")))
            back = F.round((F.log("back_toxic") - F.log("back_ordinary")) * UNIT).cast("int")
            told = contexts.select(F.lit(1).alias("role"), F.lit(size).alias("size"), F.col("context").alias("code"), back.alias("value"))
            pieces.append(told.filter("value <> 0"))
        lower = lower.select("code", "p_toxic", "p_ordinary")
    model = pieces[0]
    for piece in pieces[1:]:
        model = model.unionByName(piece)
    return written(model, "toxicity-model")


class Table:
    """Whole numbers by whole-number key, looked up many at a time; unknown keys are told apart."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 2).bit_length()))
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values = np.r_[keys[order], -1], np.r_[values[order], 0].astype(np.int32)
        self.starts = np.zeros((1 << int(64 - self.shift)) + 1, np.int32)
        np.cumsum(np.bincount(slot, minlength=len(self.starts) - 1), out=self.starts[1:])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and its value or 0."""
        slot = self._slot(keys)
        at, end = self.starts[slot], self.starts[slot + 1]
        known = (self.keys[at] == keys) & (at < end)
        values = np.where(known, self.values[at], 0)
        left = np.flatnonzero(~known & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit = self.keys[at[left]] == keys[left]
            known[left[hit]] = True
            values[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit]
            left = left[at[left] + 1 < end[left]]
        return known, values


class Scorer:
    """The steps of a piece of the model for every place whose two bytes before belong to the piece."""

    def __init__(self, role: np.ndarray, size: np.ndarray, code: np.ndarray, value: np.ndarray, pairs: np.ndarray | None):
        self.pairs = pairs
        self.tables = {}
        for r in (0, 1):
            for n in range(OWN, ORDER + 1):
                chosen = (role == r) & (size == n)
                self.tables[r, n] = Table(code[chosen], value[chosen])

    def arrays(self) -> tuple:
        """Plain arrays to broadcast, as workers may lack this package until a function brings it."""
        return self.pairs, {k: vars(t) for k, t in self.tables.items()}

    @classmethod
    def restored(cls, arrays: tuple) -> Scorer:
        scorer = cls.__new__(cls)
        scorer.pairs, scorer.tables = arrays[0], {}
        for k, held in arrays[1].items():
            scorer.tables[k] = Table.__new__(Table)
            vars(scorer.tables[k]).update(held)
        return scorer

    def steps(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes), np.int32)
        for at in range(0, len(codes), BLOCK):
            total[at : at + BLOCK] = self._steps(codes[at : at + BLOCK])
        return total

    def _steps(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes), np.int32)
        left = np.arange(len(codes)) if self.pairs is None else np.flatnonzero(self.pairs[codes >> 8 & 0xFFFF])
        for size in range(ORDER, OWN - 1, -1):
            window = codes[left] & ((1 << 8 * size) - 1)
            known, value = self.tables[0, size].get(window)
            total[left[known]] += value[known]
            left, window = left[~known], window[~known]
            total[left] += self.tables[1, size].get(window >> 8)[1]
        return total

    def sums(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text the sum over all its places, and the sums over its stretches."""
        codes, starts, sizes = packed(texts)
        total = np.r_[0, np.cumsum(self.steps(codes), dtype=np.int64)]
        out = []
        for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
            first = np.arange(start, start + max(1, size - STRETCH + STEP), STEP)
            stretches = total[np.minimum(first + STRETCH, start + size)] - total[first]
            out.append(np.r_[total[start + size] - total[start], stretches])
        return out


def pieces_of(model: DataFrame, entries: int) -> list[Scorer]:
    """The model in pieces of at most ``entries`` entries, or of one pair of bytes (2^24 and some entries at most)."""
    # The bytes before the judged one: of a window all but its last, of a context its last two.
    pair = F.when(F.col("role") == 0, F.shiftright("code", 8)).otherwise(F.col("code")).bitwiseAND(F.lit(0xFFFF)).cast("int")
    placed = model.withColumn("pair", pair)
    sizes = placed.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).orderBy("pair").collect()
    number, filled, piece = {}, 0, 0
    for r in sizes:
        if filled and filled + r["n"] > entries:
            piece, filled = piece + 1, 0
        number[r["pair"]] = piece
        filled += r["n"]
    out = []
    for wanted in range(piece + 1):
        mine = [p for p, n in number.items() if n == wanted]
        part = placed if not piece else placed.filter(F.col("pair").between(min(mine), max(mine)))
        found = part.select("role", "size", "code", "value").toArrow()
        pairs = None
        if piece:
            pairs = np.zeros(1 << 16, bool)
            pairs[mine] = True
        out.append(Scorer(*[np.asarray(found.column(c)) for c in ("role", "size", "code", "value")], pairs))
    return out


def with_sums(docs: DataFrame, scorers: list[Scorer], text: str) -> DataFrame:
    """All columns of ``docs``, ``_worst`` (steps a byte of the most toxic stretch) and ``_mean`` (of the whole text)."""
    context = docs.sparkSession.sparkContext
    length = F.greatest(F.octet_length(F.coalesce(F.col(text), F.lit(""))), F.lit(1))
    if len(scorers) == 1:
        shared = context.broadcast(scorers[0].arrays())

        @F.pandas_udf("worst bigint, total bigint")
        def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            scorer = Scorer.restored(shared.value)
            for texts in batches:
                rows = [(int(s[1:].max()), int(s[0])) for _, block in blocks(texts) for s in scorer.sums(block)]
                yield pd.DataFrame(rows, columns=["worst", "total"])

        found = docs.withColumn("_sums", judged(F.col(text)))
    else:
        # Sums depend on the text alone, so they travel under its digest, once for all copies.
        digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
        texts = docs.select(digest.alias("_digest"), F.col(text).alias("_text"))
        partial = None
        for number, scorer in enumerate(scorers):
            shared = context.broadcast(scorer.arrays())

            def told(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
                own = Scorer.restored(shared.value)
                for batch in batches:
                    sums = [s for _, block in blocks(batch.column(1).to_pylist()) for s in own.sums(block)]
                    lists = pa.array(sums, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([number] * len(sums), pa.int32()), lists], ["_digest", "piece", "sums"])

            rows = texts.mapInArrow(told, "_digest string, piece int, sums array<bigint>")
            partial = rows if partial is None else partial.unionByName(rows)
        single = partial.groupBy("_digest", "piece").agg(F.any_value("sums").alias("sums"))
        places = single.select("_digest", F.posexplode("sums").alias("place", "value"))
        added = places.groupBy("_digest", "place").agg(F.sum("value").alias("value"))
        worst = F.max(F.when(F.col("place") > 0, F.col("value"))).alias("worst")
        total = F.max(F.when(F.col("place") == 0, F.col("value"))).alias("total")
        whole = added.groupBy("_digest").agg(worst, total).select("_digest", F.struct("worst", "total").alias("_sums"))
        found = docs.withColumn("_digest", digest).join(whole, "_digest").drop("_digest")
    mean = F.col("_sums.total") / length
    # A text shorter than a stretch is one short stretch; its few bytes count as if half a stretch at least.
    worst = F.col("_sums.worst") / F.greatest(F.least(length, F.lit(STRETCH)), F.lit(STRETCH // 2))
    return found.withColumn("_worst", worst / UNIT).withColumn("_mean", mean / UNIT).drop("_sums")


def remainder(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def calibrate(points: list[tuple[float, float, int]]) -> np.ndarray:
    """Weights of (1, worst, mean) by ridged logistic regression; of one class only, the shift that tells its share."""
    labels = np.array([p[2] for p in points], float)
    toxic, ordinary = labels.sum(), (1 - labels).sum()
    if not toxic or not ordinary:
        return np.array([math.log((toxic + 0.5) / (ordinary + 0.5)) if len(points) else 0.0, 0.0, 0.0])
    x = np.array([(1.0, p[0], p[1]) for p in points])
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    centre[0], scale[0] = 0, 1
    z, w = (x - centre) / scale, np.zeros(3)
    ridge = np.diag([1e-6, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (labels - p) - ridge @ w
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, slope)
    weights = w / scale
    weights[0] -= (weights[1:] * centre[1:]).sum()
    return weights


def with_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score``, the probability of a toxic text; replaces a column of that name.

    Labels count whose crc32(doc_id) mod 5 is not 0.  Models of half of them (remainders 3 and 4) calibrate the score on at most
    ``max_docs`` documents of the other half, those with the lowest hashes of their ids; the scores come from models of all.
    An id with several labels is toxic if one says so; NULL ids and labels tell nothing.  A row's score depends on its
    whole text alone: NULL is an empty text, equal texts score alike, no row is dropped.  Without labels every score is
    0.5; an empty table gives no rows.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    half = remainder(F.col("_id")).isin(1, 2)
    known = known.select("_id", "_toxic", half.alias("_half"))
    known = sized(written(known, "toxicity-labels"), settings.label_bytes)
    marked = docs.select(docs["doc_id"].alias("_key"), docs[text].alias("_text")).join(known, F.col("_key") == F.col("_id"), "left")
    part = (
        F.when(F.col("_toxic").isNull(), NEITHER)
        .when(F.col("_half"), F.when(F.col("_toxic") > 0, TOXIC_A).otherwise(ORDINARY_A))
        .otherwise(F.when(F.col("_toxic") > 0, TOXIC_B).otherwise(ORDINARY_B))
    )
    windows = written(count_windows(marked.select("_text", part.alias("part"))), "toxicity-windows")

    def scorers(toxic: Column, ordinary: Column) -> list[Scorer]:
        model = build_model(windows.select("code", "n", toxic.alias("toxic"), ordinary.alias("ordinary")))
        return pieces_of(model, settings.piece_entries)

    held_back = known.filter("_half").join(docs.select(docs["doc_id"].alias("_id")).distinct(), "_id")
    sample = held_back.orderBy(F.xxhash64("_id"), "_id").limit(settings.max_docs).collect()
    points: list[tuple[float, float, int]] = []
    if sample:
        ids = docs.sparkSession.createDataFrame([(r["_id"], int(r["_toxic"] > 0)) for r in sample], "_id bigint, _toxic int")
        # At most max_docs pairs of numbers: a proven bound for the broadcast.
        chosen = docs.select(docs["doc_id"].alias("_key"), docs[text].alias("_text")).join(F.broadcast(ids), F.col("_key") == F.col("_id"))
        judged = with_sums(chosen.select("_id", "_toxic", "_text"), scorers(F.col("toxic_b"), F.col("ordinary_b")), "_text")
        points = sorted((r["_worst"], r["_mean"], r["_toxic"]) for r in judged.select("_worst", "_mean", "_toxic").collect())
    shift, worst, mean = calibrate(points).tolist()
    both = scorers(F.col("toxic_a") + F.col("toxic_b"), F.col("ordinary_a") + F.col("ordinary_b"))
    kept = [c for c in docs.columns if c != score]
    logit = F.lit(shift) + F.lit(worst) * F.col("_worst") + F.lit(mean) * F.col("_mean")
    found = with_sums(docs.select(*kept), both, text)
    return found.select(*kept, (1 / (1 + F.exp(-logit))).alias(score))


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_toxicity(docs, read(spark, sf_dir, "labels"))
    held_out = remainder(F.col("doc_id")) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
