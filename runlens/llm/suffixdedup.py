"""Removal of repeated byte strings by a sparse suffix array, sorted deep-shallow.

Of every string of ``length`` bytes the lowest-hashed gram inside it is an anchor, so equal
strings have anchors at the same place.  Anchors whose gram occurs once are done with.  The
others bring their neighbourhood to the task of their gram; there the suffixes that start at
the anchors, and the reversed texts that end there, are sorted by ``deep_shallow``.  Two
strings around two anchors are equal where both common prefixes reach far enough, and all but
the first of them are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import query, read, small_batches, written
from runlens.llm.suffixsort import deep_shallow
from runlens.operators.spread import number_rows

LENGTH, GRAM = 100, 32
# UTF-8 never has this byte, so it can stand behind the end of a text.
END = 0xFF
# Grams with more anchors than this are shared out by their surroundings, in so many pieces.
HOT, PIECES = 10_000, 8
CHUNK = 20_000
# Neighbourhoods made at a time.
BLOCK = 50_000
NO_ID = -(2**63)

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_MIX = [np.uint64(int(m) | 1) for m in _rng.integers(2**62, 2**63, 8)]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each run of ``gram`` bytes (a power of two), made of those of its halves."""
    hashes, half, level = _BYTE[data], 1, 0
    while half < gram:
        left = hashes[:-half] * _MIX[level]
        left ^= left >> np.uint64(31)
        left += hashes[half:]
        hashes, half, level = left, half * 2, level + 1
    hashes *= _MIX[level]
    hashes ^= hashes >> np.uint64(29)
    return hashes


def _extreme(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values."""
    reach = 1
    while reach * 2 <= width:
        values = pick(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are lowest in some run of ``length`` bytes (ties all count)."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(data, gram)
    width = length - gram + 1
    lowest = _extreme(hashes, width, np.minimum)
    # A place is an anchor if the highest of the minima around it is its own hash.
    edge = np.zeros(width - 1, np.uint64)
    around = _extreme(np.concatenate([edge, lowest, edge]), width, np.maximum)
    places = np.flatnonzero(around == hashes)
    return places, hashes[places]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a byte matrix as Arrow binaries."""
    count, width = rows.shape
    offsets = np.arange(count + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _texts(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def find_anchors(length: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, hashes = [], [], []
            for doc, text, first in zip(batch["id"].to_pylist(), _texts(batch["text"]), batch["first"].to_pylist(), strict=True):
                if first and len(text) >= length:
                    at, h = anchors(np.frombuffer(text, np.uint8), length, gram)
                    ids.append(np.full(len(at), doc, np.int64))
                    places.append(at.astype(np.int32))
                    hashes.append(h.view(np.int64))
            if ids:
                columns = [np.concatenate(x) for x in (hashes, ids, places)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "id", "place"])

    return find


CONTEXT = "key bigint, id bigint, place int, part int, context binary"


def pieces_of(length: int, gram: int, pieces: int) -> list[tuple[int, int]]:
    """Ranges of the bytes a string takes before its anchor: one for each piece, and last the whole."""
    reach = length - gram
    edges = [round(i * (reach + 1) / pieces) for i in range(pieces + 1)]
    return [*zip(edges, edges[1:], strict=False), (0, reach + 1)]


def bring_contexts(length: int, gram: int, pieces: int):
    """Neighbourhoods of candidate anchors; those equal to an earlier one in the batch are settled at once.

    A row is a neighbourhood to judge, for the range of its ``part``, or without one a settled
    span from ``place`` to -``part``.  Neighbourhoods are made for ``BLOCK`` anchors at a time, also within a text, so a
    text of one repeated character, where every place is an anchor, needs no more memory than its places.
    """
    reach = length - gram
    ranges = pieces_of(length, gram, pieces)

    def pieces_in_order(batch: pa.RecordBatch) -> Iterator[tuple]:
        docs = zip(batch["id"].to_pylist(), _texts(batch["text"]), batch["found"].to_pylist(), strict=True)
        for doc, text, found in sorted(docs, key=lambda d: d[0]):
            data = np.frombuffer(text, np.uint8)
            padded = np.full(len(data) + reach + length, END, np.uint8)
            padded[reach : reach + len(data)] = data
            views = np.lib.stride_tricks.sliding_window_view(padded, reach + length)
            hashes = gram_hashes(data, gram).view(np.int64)
            places = np.array(found, np.int64)
            hot = places < 0
            places = np.where(hot, ~places, places)
            order = np.argsort(places)
            for first in range(0, len(places), BLOCK):
                at = places[order[first : first + BLOCK]]
                yield np.full(len(at), doc, np.int64), at, hashes[at], hot[order[first : first + BLOCK]], np.minimum(at, reach), np.minimum(len(data) - at, length), views[at]

    def settle(parts: list[tuple], seen: dict[bytes, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        ids, at, h, hot, before, after, view = (np.concatenate(x) for x in zip(*parts, strict=True))
        # The earliest of equal neighbourhoods stands for all; the others are covered whole.
        stays = np.zeros(len(ids), bool)
        settled = np.r_[False, (ids[1:] == ids[:-1]) & (at[1:] != at[:-1]) & (view[1:] == view[:-1]).all(1)]
        for i in np.flatnonzero(~settled).tolist():
            own = (int(ids[i]), int(at[i]))
            first = seen.setdefault(view[i].tobytes(), own)
            # A row given twice is neither.
            stays[i], settled[i] = first is own, first != own
        low, high = np.maximum(0, length - after), before
        settled &= low <= high
        rows = [(h, pieces, stays & ~hot)]
        for part, (lo, hi) in enumerate(ranges[:-1]):
            if hi > lo and hot.any():
                # The bytes that all strings of this range share.
                key = np.zeros(len(h), np.int64)
                for i in np.flatnonzero(stays & hot):
                    core = view[i, reach - lo : reach + length - hi + 1].tobytes()
                    key[i] = xxhash.xxh64_intdigest(core, lo) - (1 << 63)
                rows.append((key, part, stays & hot))
        for key, part, c in rows:
            if c.any():
                numbers = [key[c], ids[c], at[c].astype(np.int32), np.full(int(c.sum()), part, np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), _binary(view[c])], _names())
        if settled.any():
            # Both ends follow the anchors' order, so overlapping spans of a document become one.
            own, start, stop = ids[settled], (at - high)[settled], (at - low + length)[settled]
            opens = np.r_[True, (own[1:] != own[:-1]) | (start[1:] > stop[:-1])]
            own, start, stop = own[opens], start[opens], stop[np.r_[opens[1:], True]]
            numbers = [own, own, start.astype(np.int32), -stop.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), pa.nulls(len(own), pa.binary())], _names())

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, tuple[int, int]] = {}
            parts: list[tuple] = []
            held = 0
            for piece in pieces_in_order(batch):
                parts.append(piece)
                held += len(piece[0])
                if held >= BLOCK:
                    yield from settle(parts, seen)
                    parts, held = [], 0
            if parts:
                yield from settle(parts, seen)

    return bring


def _names() -> list[str]:
    return [part.split()[0] for part in CONTEXT.split(", ")]


def repeated(key: np.ndarray, lo, hi, before, after, context: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of (key, id, place): the least and most bytes before the anchor of repeated strings; -1 if none.

    A string takes i bytes before the anchor and length - i from it on.
    """
    reach = length - gram
    count = len(key)
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]][:count])
    classes = []
    for strings, known in ((context[:, reach:], after), (np.ascontiguousarray(context[:, :reach][:, ::-1]), before)):
        order, common = deep_shallow(group, strings)
        known = known[order]
        common[1:] = np.minimum(common[1:], np.minimum(known[1:], known[:-1]))
        classes.append((order, common))
    (right, right_common), (left, left_common) = classes
    least, most = np.full(count, -1), np.full(count, -1)
    # Rows alone in their class at the shortest part of a string behind the anchor need no further look.
    for i in range(reach + 1):
        fits = (lo <= i) & (i < hi) & (before >= i) & (after >= length - i)
        a = np.empty(count, np.int64)
        a[right] = np.cumsum(right_common < length - i)
        b = np.empty(count, np.int64)
        # No byte before the anchor is needed for i = 0, but groups stay apart.
        b[left] = np.cumsum(left_common < i)
        rows = np.flatnonzero(fits & (np.bincount(a, minlength=count + 1)[a] > 1))
        if not len(rows):
            continue
        firsts = np.unique(a[rows] * (count + 1) + b[rows], return_index=True)[1]
        later = np.ones(len(rows), bool)
        later[firsts] = False
        rows = rows[later]
        least[rows] = np.where(least[rows] < 0, i, least[rows])
        most[rows] = i
    return least, most


def judge_contexts(length: int, gram: int, pieces: int, chunk: int):
    """Spans of repeated bytes from rows in order of (key, id, place); works on whole keys, ``chunk`` rows or more at a time."""

    reach = length - gram
    ranges = np.array(pieces_of(length, gram, pieces))

    def spans(table: pa.Table) -> pa.RecordBatch:
        key, ids, place, part = (table[n].to_numpy() for n in _names()[:4])
        joined = table["context"].combine_chunks()
        if isinstance(joined, pa.ChunkedArray):
            joined = pa.concat_arrays(joined.chunks)
        width = 2 * length - gram
        start = joined.offset * width
        context = np.frombuffer(joined.buffers()[2], np.uint8)[start : start + len(joined) * width].reshape(-1, width)
        # A row given twice is one.
        same = np.r_[False, (key[1:] == key[:-1]) & (ids[1:] == ids[:-1]) & (place[1:] == place[:-1])][: len(key)]
        if same.any():
            same[1:] &= (context[1:] == context[:-1]).all(1)
            key, ids, place, part, context = (x[~same] for x in (key, ids, place, part, context))
        lo, hi = ranges[part].T
        before = reach - (context[:, :reach] == END).sum(1)
        after = length - (context[:, reach:] == END).sum(1)
        least, most = repeated(key, lo, hi, before, after, context, length, gram)
        c = most >= 0
        columns = [ids[c], (place[c] - most[c]).astype(np.int32), (place[c] - least[c] + length).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "start", "stop"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        held = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            part = table["part"].to_numpy()
            if (part < 0).any():
                settled = table.filter(pa.array(part < 0))
                ends = [settled["id"].to_numpy(), settled["place"].to_numpy(), -settled["part"].to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["id", "start", "stop"])
                table = table.filter(pa.array(part >= 0))
            waiting.append(table)
            held += len(table)
            if held >= chunk:
                whole = pa.concat_tables(waiting)
                keys = whole["key"].to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield spans(whole.slice(0, cut))
                waiting = [whole.slice(cut)]
                held = len(whole) - cut
        if held:
            yield spans(pa.concat_tables(waiting))

    return judge


REMOVED = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def cut_out(length: int, keep_bytes: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, first, found in zip(
                batch["id"].to_pylist(), _texts(batch["text"]), batch["first"].to_pylist(), batch["found"].to_pylist(), strict=True
            ):
                if not first and len(text) >= length:
                    spans = [(0, len(text))]
                else:
                    spans = []
                    for span in sorted((f["start"], f["stop"]) for f in found or ()):
                        if spans and span[0] <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], span[1]))
                        else:
                            spans.append(span)
                edges = [0, *(x for span in spans for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else text
                digest = hashlib.sha256(kept).hexdigest()
                rows.append((doc, len(text), len(text) - len(kept), len(spans), digest, kept if keep_bytes else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = [part.split()[0] for part in REMOVED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return cut


def drop_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, pieces: int = PIECES, chunk: int = CHUNK, keep_bytes: bool = True
) -> DataFrame:
    """Each document without the bytes covered by a string of ``length`` bytes that also starts earlier.

    Columns: ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs), ``kept_sha256``
    (lowercase hex) and ``kept`` (the remaining bytes, which need not be UTF-8; NULL unless
    ``keep_bytes``).  Earlier means a smaller id, or the same id and an earlier start; strings
    never cross documents, may overlap, and are judged on the input.  Texts are UTF-8, NULL is
    empty.  Rows given twice are one document and get the same result twice.  NULL ids come
    before all others.  Rows of one id (or of NULL) with different texts are documents of their own, in order of
    their texts' SHA-256.  An empty table gives no rows; a very long text is one row's work.

    A document equal to an earlier one goes whole, by a grouped minimum, and takes no
    further part.  A gram with more than ``hot`` anchors is shared out by what surrounds it;
    this, ``pieces`` and ``chunk`` do not change the result.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(docs["doc_id"], F.lit(NO_ID)).alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    options = (length, gram, hot, pieces, chunk, keep_bytes)
    if several_texts(texts):
        numbers = numbered(texts)
        digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
        single = texts.select("id", digest, "text").join(numbers, ["id", "digest"]).select(F.col("number").alias("id"), "text")
        found = _drop_repeats(single, *options).withColumnRenamed("id", "number").join(numbers, "number").drop("number", "digest")
    else:
        found = _drop_repeats(texts, *options)
    return found.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def several_texts(texts: DataFrame) -> bool:
    """Whether any id occurs with different texts."""
    h = F.xxhash64("text", F.octet_length("text"))
    return not texts.groupBy("id").agg(F.min(h).alias("a"), F.max(h).alias("b")).filter("a <> b").isEmpty()


def numbered(texts: DataFrame) -> DataFrame:
    """``id, digest, number``: numbers from 1 for the different (id, text), in order of id and the text's SHA-256."""
    known = texts.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).distinct()
    table = number_rows(known.withColumn("all", F.lit(0)), ["all"], [F.asc("id"), F.asc("digest")], "number")
    return written(table.select("id", "digest", F.col("number").cast("bigint").alias("number")), "document-numbers")


def _drop_repeats(texts: DataFrame, length: int, gram: int, hot: int, pieces: int, chunk: int, keep_bytes: bool) -> DataFrame:
    """``drop_repeats`` of ``id, text`` where an id has one text."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    firsts = texts.select("id", digest.alias("digest")).groupBy("digest").agg(F.min("id").alias("own")).select("own").distinct()
    # The texts are shuffled once, by id; the plan below reuses that exchange.
    known = texts.join(firsts.hint("merge"), texts["id"] == firsts["own"], "left").select("id", "text", F.col("own").isNotNull().alias("first"))
    found = known.mapInArrow(find_anchors(length, gram), "h bigint, id bigint, place int")
    counted = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    wanted = found.join(counted.select(F.struct("h").alias("k"), "n"), F.struct("h") == F.col("k"))
    # Hot grams are marked by the complement of the place.
    candidate = F.when(F.col("n") > hot, F.bitwise_not("place")).otherwise(F.col("place"))
    per_doc = wanted.groupBy("id").agg(F.collect_list(candidate).alias("found")).withColumnRenamed("id", "of")
    near = known.join(per_doc, known["id"] == per_doc["of"]).filter("first").select("id", "text", "found")
    contexts = near.mapInArrow(bring_contexts(length, gram, pieces), CONTEXT)
    sorted_rows = contexts.repartition("key").sortWithinPartitions("key", "id", "place")
    spans = sorted_rows.mapInArrow(judge_contexts(length, gram, pieces, chunk), "id bigint, start int, stop int")
    per_doc = spans.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("found")).withColumnRenamed("id", "of")
    met = known.join(per_doc, known["id"] == per_doc["of"], "left").select("id", "text", "first", "found")
    return met.mapInArrow(cut_out(length, keep_bytes), REMOVED)


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(read(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")
