"""Periodic runs of words: recursive frequency splitting, then a scan by lags.

A run of period q is a stretch of words equal to the words q places on, at least max(12, 2 q) words
long, that no neighbour extends.  Every word of a run stands in it twice at least.  So within a segment (at
first a text) the words that stand there once end segments, those of fewer than 12 words go, and the rest is split
again until nothing changes.  The same is done with windows of two, four and six words, of which a run also repeats every one.

What is left is scanned for periods from 2^k to 2^(k+1) - 1, for each k: splitting goes on with windows of about
2^k words that recur at such a distance, not both inside one run of a smaller period (the theorem of Fine and Wilf
keeps such a pair from lying in a run of its own).  In each segment that survives, words are compared at the
distances at which its windows recurred.  Windows are compared by hashes, which can only make the scan look at more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import query, read

SHORTEST = 12
WORDS_PER_BLOCK = 100_000
FOUND = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def resegment(pos: np.ndarray, seg: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Number the stretches of neighbouring places of one segment anew; those of fewer than ``least`` words go."""
    first = np.r_[True, (pos[1:] != pos[:-1] + 1) | (seg[1:] != seg[:-1])][: len(pos)]
    seg = np.cumsum(first) - 1
    long = np.bincount(seg)[seg] >= least if len(seg) else np.zeros(0, bool)
    return pos[long], seg[long]


class Windows:
    """Hashes of all windows of a list of word numbers."""

    def __init__(self, ids: np.ndarray):
        count = len(ids) + 1
        base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        with np.errstate(over="ignore"):
            power = np.cumprod(np.r_[np.uint64(1), np.full(count - 1, base)])
            self.back = np.cumprod(np.r_[np.uint64(1), np.full(count - 1, inverse)])
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            self.sums = np.r_[np.uint64(0), np.cumsum(mixed * power[:-1])]

    def at(self, places: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[places + size] - self.sums[places]) * self.back[places]


def whole_windows(pos: np.ndarray, seg: np.ndarray, size: int) -> np.ndarray:
    """Which places begin a window that lies in their segment."""
    inside = np.zeros(len(pos), bool)
    if len(pos) >= size:
        inside[: len(pos) - size + 1] = seg[: len(pos) - size + 1] == seg[size - 1 :]
    return inside


def covered(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Places inside any of the windows."""
    edges = np.zeros(total + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return np.cumsum(edges[:-1]) > 0


def split_rare(windows: Windows, pos: np.ndarray, seg: np.ndarray, size: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Split at words in no window of ``size`` words that stands in its segment twice, until nothing changes."""
    while len(pos):
        inside = whole_windows(pos, seg, size)
        at, of = pos[inside], seg[inside]
        order = np.lexsort((windows.at(at, size), of))
        hashed, of_sorted = windows.at(at[order], size), of[order]
        same = (hashed[1:] == hashed[:-1]) & (of_sorted[1:] == of_sorted[:-1])
        twice = np.r_[False, same] | np.r_[same, False]
        alive = covered(at[order][twice[: len(at)]], size, total)[pos]
        if alive.all():
            break
        pos, seg = resegment(pos[alive], seg[alive], SHORTEST)
    return pos, seg


class Recurring:
    """Windows of a size and, for each, the equal windows of its segment that stand ``low`` to ``high`` places away."""

    def __init__(self, windows: Windows, pos: np.ndarray, seg: np.ndarray, size: int, low: int, high: int, runs: np.ndarray, total: int):
        inside = whole_windows(pos, seg, size)
        at, of = pos[inside], seg[inside]
        hashed = windows.at(at, size)
        order = np.lexsort((at, hashed, of))
        at, of, hashed = at[order], of[order], hashed[order]
        group = np.cumsum(np.r_[True, (hashed[1:] != hashed[:-1]) | (of[1:] != of[:-1])][: len(at)])
        self.at, self.of = at, of
        # Far enough apart that distances never reach another group.
        ahead = group * (4 * total + 4)
        key = ahead + at
        end, begin = np.zeros(total, np.int64), np.full(total, 2 * total)
        for start, length, _ in runs:
            if length >= size:
                part = slice(start, start + length - size + 1)
                end[part] = np.maximum(end[part], start + length)
                begin[part] = np.minimum(begin[part], start)
        # A partner inside the same run of smaller period does not count.
        self.first = np.searchsorted(key, ahead + np.maximum(at + low, end[at] - size + 1))
        self.last = np.searchsorted(key, key + high, "right")
        before = np.searchsorted(key, ahead + np.minimum(at - low, begin[at] - 1), "right") - 1
        self.recurs = (self.first < self.last) | ((before >= 0) & (key[before] >= key - high))

    def lags(self) -> np.ndarray:
        """Distinct (segment, distance) of the windows and their later partners."""
        found, place = [], np.flatnonzero(self.first < self.last)
        partner = self.first[place]
        while len(place):
            found.append(np.unique(np.stack([self.of[place], self.at[partner] - self.at[place]], 1), axis=0))
            more = partner + 1 < self.last[place]
            place, partner = place[more], partner[more] + 1
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def scan(ids: np.ndarray, begin: int, end: int, lag: int, text: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """Start and length of the stretches of ids[begin:end] equal at a lag, whole and long enough for a run."""
    equal = ids[begin : end - lag] == ids[begin + lag : end]
    edges = np.flatnonzero(np.diff(np.r_[False, equal, False].astype(np.int8))).reshape(-1, 2)
    for first, last in (edges + begin).tolist():
        if last - first < max(SHORTEST - lag, lag):
            continue
        # A stretch cut by its segment belongs to a run of smaller period, which has its own segment.
        goes_left = first == begin > text[0] and ids[begin - 1] == ids[begin - 1 + lag]
        goes_right = last + lag == end < text[1] and ids[last] == ids[end]
        if not goes_left and not goes_right:
            yield first, last - first + lag


def find_runs(ids: np.ndarray, sizes: list[int]) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of texts laid end to end, by start and period; ``sizes`` are the texts' lengths."""
    total, doc = len(ids), np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    windows = Windows(ids)
    pos, seg = resegment(np.arange(total), doc, SHORTEST)
    for size in (1, 2, 4, 6):
        pos, seg = split_rare(windows, pos, seg, size, total)
    found: dict[tuple[int, int], int] = {}
    low = 1
    while len(pos):
        high, least = 2 * low - 1, max(SHORTEST, 2 * low)
        # Windows no longer than the shortest stretch that equals itself at a lag of this size.
        size = {1: 8, 2: 8, 4: 6}.get(low, low)
        pos, seg = resegment(pos, seg, least)
        runs = np.array([(*k, p) for k, p in found.items()], np.int64).reshape(-1, 3)
        at, of = pos, seg
        while len(at):
            recurring = Recurring(windows, at, of, size, low, high, runs, total)
            alive = covered(recurring.at[recurring.recurs], size, total)[at]
            if alive.all():
                for number, lag in recurring.lags().tolist():
                    first = np.searchsorted(of, number)
                    begin, end = at[first], at[np.searchsorted(of, number, "right") - 1] + 1
                    text = doc[begin]
                    for run in scan(ids, int(begin), int(end), lag, (int(ends[text] - sizes[text]), int(ends[text]))):
                        found.setdefault(run, lag)
                break
            at, of = resegment(at[alive], of[alive], least)
        low *= 2
    return sorted((start, length, period) for (start, length), period in found.items())


def collapse(texts: list[list[bytes]]) -> list[tuple[list[dict], str]]:
    """For each text its runs, and the words that no run holds after its first period, joined by blanks."""
    sizes = [len(t) for t in texts]
    every = [w for t in texts for w in t]
    ids = pd.factorize(np.array([*every, None], object)[:-1])[0].astype(np.int64)
    ends = np.cumsum(sizes)
    per_text: dict[int, list[tuple[int, int, int]]] = {}
    for start, length, period in find_runs(ids, sizes):
        number = int(np.searchsorted(ends, start, "right"))
        per_text.setdefault(number, []).append((start - int(ends[number]) + sizes[number], length, period))
    out = []
    for number, words in enumerate(texts):
        runs = sorted(per_text.get(number, []), key=lambda r: (r[0], r[2]))
        if runs:
            edges = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                edges[start + period] += 1
                edges[start + length] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
        told = [{"start": s, "length": n, "period": p} for s, n, p in runs]
        out.append((told, b" ".join(words).decode("utf-8", "surrogatepass")))
    return out


def collapse_column():
    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows, block, filled = [], [], 0
        for text in texts:
            words = words_of(text)
            block.append(words)
            filled += len(words)
            if filled >= WORDS_PER_BLOCK:
                rows.extend(collapse(block))
                block, filled = [], 0
        rows.extend(collapse(block))
        return pd.DataFrame(rows, columns=["runs", "collapsed"])

    return found


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, with ``runs`` and ``collapsed``, the text without what repeats in runs.

    ``runs`` is an array of (start, length, period) by start and period, in words from 0, of every run of the
    whole text, also those that overlap or lie in each other.  ``collapsed`` has the words that no run holds
    after its first period, joined by one blank.  These replace columns of the same names.  NULL and empty
    texts have no runs and an empty text; rows given twice and NULL ids are judged alike, each row
    alone; an empty table gives no rows.  A text of any length is one row's work; the time grows with the
    number of distances at which its windows recur.
    """
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    return docs.select(*kept, collapse_column()(docs[text]).alias("_found")).select(*kept, "_found.*")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` with one run planted in every tenth document, by a hash of its id; NULL ids stay as they are."""

    def plant(key: int | None, text: str | None) -> str | None:
        h = 1 if key is None or pd.isna(key) else zlib.crc32(str(int(key)).encode())
        words = words_of(text) if h % 10 == 0 else []
        if not words:
            return text
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        planted = words[:a] + [words[a + i % p] for i in range(n - a)]
        return b" ".join(planted).decode("utf-8", "surrogatepass")

    @F.pandas_udf("string")
    def planted(keys: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([plant(k, t) for k, t in zip(keys, texts, strict=True)], dtype=object)

    # As text, an id keeps all its digits beside NULLs.
    return docs.select("doc_id", planted(F.col("doc_id").cast("string"), F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The run of greatest length; of equals the first by start, then period."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(order)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(read(spark, sf_dir, "documents"))
    found = collapse_runs(docs).drop("text").withColumn("_best", longest(F.col("runs")))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = -F.col("_best.by"), F.col("_best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("_best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
