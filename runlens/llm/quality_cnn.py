"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks that cover all of it.  Learned filters
slide over the embedded bytes of a chunk and are max-pooled there; a document is the mean and
the maximum of its chunks' pooled features, which a small dense layer turns into one probability.
The network is trained on a bounded sample of labelled documents and applied to every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import query, read, small_batches

CHUNK, STEP = 512, 384
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 8, 2, 40, 16
BLOCK = 64


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit; nothing else of the operator depends on a sample."""

    max_docs: int = 4000
    max_chunks: int = 4
    epochs: int = 14
    min_steps: int = 400
    batch: int = 64
    rate: float = 0.004
    seed: int = 7


def chunks(data: bytes) -> np.ndarray:
    """All chunks of a text as rows of bytes; the last is filled up with zeros, an empty text is one chunk of them."""
    count = max(1, -(-max(0, len(data) - CHUNK) // STEP) + 1)
    padded = np.zeros((count - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (count, CHUNK), (STEP, 1))


class Network:
    """Embedding, filters, max pooling, two dense layers."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        span = WIDTH * EMBED
        self.weights = {
            "embed": (draw.standard_normal((256, EMBED)) * 0.7).astype(np.float32),
            "filter": normal(span, FILTERS),
            "shift": np.zeros(FILTERS, np.float32),
            "hidden": normal(2 * FILTERS, HIDDEN),
            "hidden_shift": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, 1)[:, 0],
            "out_shift": np.zeros(1, np.float32),
        }

    def pooled(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled features of each chunk, and the window each came from."""
        w = self.weights
        embedded = w["embed"][block].reshape(len(block), -1)
        windows = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        scores = windows @ w["filter"]
        best = scores.argmax(1)
        top = np.take_along_axis(scores, best[:, None], 1)[:, 0] + w["shift"]
        return np.maximum(top, 0), best

    def probability(self, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._dense(mean, top)[2], -30, 30)))

    def _dense(self, mean: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self.weights
        features = np.concatenate([mean, top], 1)
        hidden = np.maximum(features @ w["hidden"] + w["hidden_shift"], 0)
        return features, hidden, hidden @ w["out"] + w["out_shift"]

    def gradients(self, block: np.ndarray, doc: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss; ``doc`` is the ascending document number of each chunk."""
        w, n = self.weights, len(target)
        pooled, best = self.pooled(block)
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[starts, len(doc)]).astype(np.float32)
        mean = np.add.reduceat(pooled, starts) / count[:, None]
        top = np.maximum.reduceat(pooled, starts)
        features, hidden, logit = self._dense(mean, top)
        slope = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) / n).astype(np.float32)
        grads = {"out": hidden.T @ slope, "out_shift": slope.sum(keepdims=True)}
        back = (slope[:, None] * w["out"]) * (hidden > 0)
        grads["hidden"], grads["hidden_shift"] = features.T @ back, back.sum(0)
        back = back @ w["hidden"].T
        shared = back[:, :FILTERS] / count[:, None]
        into = shared[doc] + np.where(pooled == top[doc], back[doc, FILTERS:], 0)
        into = np.where(pooled > 0, into, 0).astype(np.float32)
        grads["shift"] = into.sum(0)
        # Only the window that won the pooling passes a gradient on.
        at = best[:, :, None] * STRIDE + np.arange(WIDTH)
        codes = block[np.arange(len(block))[:, None, None], at]
        windows = w["embed"][codes].reshape(len(block), FILTERS, -1)
        grads["filter"] = np.einsum("cf,cfk->kf", into, windows, optimize=True)
        spread = (into[:, :, None] * w["filter"].T).reshape(-1, EMBED)
        flat = codes.reshape(-1)
        grads["embed"] = np.stack([np.bincount(flat, spread[:, e], 256) for e in range(EMBED)], 1).astype(np.float32)
        return grads


def train(samples: list[tuple[bytes, int]], settings: Training = Training()) -> Network:
    """Fit by Adam.  A sample is (chunks of one document joined, label); the same samples give the same network.

    Without samples, or with one label only, the network is untrained but for its last shift,
    so that it answers with the share of good labels (0.5 without any).
    """
    network = Network(settings.seed)
    labels = np.array([label for _, label in samples], np.float32)
    if len(set(labels.tolist())) < 2:
        network.weights["out"][:] = 0
        network.weights["out_shift"][:] = 0 if not len(labels) else (4 if labels[0] else -4)
        return network
    docs = [np.frombuffer(data, np.uint8).reshape(-1, CHUNK) for data, _ in samples]
    draw = np.random.default_rng(settings.seed)
    first = {k: np.zeros_like(v) for k, v in network.weights.items()}
    second = {k: np.zeros_like(v) for k, v in network.weights.items()}
    per_epoch = -(-len(docs) // settings.batch)
    steps = max(settings.epochs * per_epoch, settings.min_steps)
    order, step = np.array([], int), 0
    while step < steps:
        if len(order) < settings.batch:
            order = np.concatenate([order, draw.permutation(len(docs))])
        chosen, order = order[: settings.batch], order[settings.batch :]
        block = np.concatenate([docs[i] for i in chosen])
        number = np.repeat(np.arange(len(chosen)), [len(docs[i]) for i in chosen])
        grads = network.gradients(block, number, labels[chosen])
        step += 1
        pace = settings.rate * min(1, 3 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            network.weights[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return network


def score_column(network: Network):
    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            total = np.zeros((len(texts), FILTERS))
            top = np.zeros((len(texts), FILTERS), np.float32)
            count = np.zeros(len(texts))
            block, owner, filled = np.zeros((BLOCK, CHUNK), np.uint8), np.zeros(BLOCK, int), 0

            def flush(n: int) -> None:
                found = network.pooled(block[:n])[0]
                np.add.at(total, owner[:n], found)
                np.maximum.at(top, owner[:n], found)

            for i, text in enumerate(texts):
                rows = chunks((text or "").encode("utf-8", "surrogatepass"))
                count[i] = len(rows)
                at = 0
                while at < len(rows):
                    n = min(BLOCK - filled, len(rows) - at)
                    block[filled : filled + n], owner[filled : filled + n] = rows[at : at + n], i
                    filled, at = filled + n, at + n
                    if filled == BLOCK:
                        flush(filled)
                        filled = 0
            if filled:
                flush(filled)
            mean = (total / np.maximum(count, 1)[:, None]).astype(np.float32)
            yield pd.Series(network.probability(mean, top).astype(float))

    return score


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, settings: Training = Training()) -> Network:
    """Train on at most ``max_docs`` labelled documents outside the held-out fold, at most ``max_chunks`` chunks of each.

    The documents are those with the lowest hashes of their ids, the chunks lie evenly over the
    whole text, so the driver gets at most max_docs * max_chunks * 512 bytes of text.  Ids with
    several labels count with the lowest one; NULL ids and labels are left out.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).join(docs.select("doc_id").distinct(), "doc_id")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_docs).collect()
    if not chosen:
        return train([], settings)
    ids = spark.createDataFrame([(r[0], int(r[1])) for r in chosen], "_id bigint, _label int")
    limit = settings.max_chunks

    @F.pandas_udf(T.BinaryType())
    def sample(texts: pd.Series) -> pd.Series:
        def few(text: str | None) -> bytes:
            rows = chunks((text or "").encode("utf-8", "surrogatepass"))
            return rows[np.unique(np.linspace(0, len(rows) - 1, min(limit, len(rows))).astype(int))].tobytes()

        return texts.map(few) if texts.notna().all() else pd.Series([few(t) for t in texts])

    # At most max_docs pairs of numbers: a proven bound for the broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    rows = found.select("doc_id", sample("text").alias("data"), "_label").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([(bytes(r["data"]), r["_label"]) for r in rows], settings)


def with_scores(docs: DataFrame, labels: DataFrame, settings: Training = Training(), score: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score``, the probability of a good document; replaces a column of that name.

    Every row gets a score from its text alone, over all of it; NULL is an empty text.  Rows
    given twice score alike.  An empty table gives no rows; without labels every score is 0.5.
    """
    small_batches(docs.sparkSession)
    network = fit(docs, labels, settings)
    return docs.withColumn(score, score_column(network)(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, settings: Training = Training()) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with the columns of ``docs``."""
    return with_scores(docs, labels, settings, "_quality_score").filter(F.col("_quality_score") >= least).drop("_quality_score")


@query("op6_quality_cnn")
def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
