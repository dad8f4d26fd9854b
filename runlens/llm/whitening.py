"""Embedding whitening: polarisation covariance.

Every entry becomes a whole number.  One pass gives the sums per dimension, a second the exact
sums of squares of each centred dimension and of each sum of two centred dimensions.  As
(a + b)^2 = a^2 + 2ab + b^2, differences of these variances are the covariances; the matrix, exact
up to its last division, goes to an eigendecomposition.  Tasks add up whole numbers in numpy and
send one row per pair of dimensions, so the driver gets d (d + 1) / 2 numbers however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import checkpointed, query, read

SCALE, SHIFT = 1024, 100_000
# Entries beyond this many steps count as this many, so that every sum below is exact.
FARTHEST = 1 << 40
# Rows whose squares are added in one go, and the largest centred value whose squares then fit 64 bits.
BLOCK, DIRECT = 4096, 1 << 24
LIMB = 21
SPREAD = 1e-12


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths (0: no usable vector) and starts of the rows, and all their entries as doubles."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    broken = np.r_[0, np.cumsum(~np.isfinite(values))]
    starts = ends - lengths
    return np.where(broken[ends] == broken[starts], lengths, 0), starts, values


def whole_numbers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of ``size`` finite entries, and these as rows of whole numbers."""
    lengths, starts, values = _lists(column)
    usable = lengths == size
    entries = values[starts[usable][:, None] + np.arange(size)]
    return usable, np.clip(np.floor(entries * SCALE), -FARTHEST, FARTHEST).astype(np.int64) + SHIFT


def square_sums(u: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of (u_i + u_j)^2 for i < j and of u_i^2 for i = j, as Python integers."""
    size = u.shape[1]
    total = np.zeros((size, size), object)
    for at in range(0, len(u), BLOCK):
        part = u[at : at + BLOCK]
        direct = np.abs(part).max(initial=0) < DIRECT
        for i in range(size):
            v = part[:, i:] + part[:, i : i + 1]
            v[:, 0] = part[:, i]
            if direct:
                total[i, i:] += np.einsum("rk,rk->k", v, v).astype(object)
                continue
            high, low = v >> LIMB, v & ((1 << LIMB) - 1)
            for left, right, power in ((high, high, 2 * LIMB), (high, low, LIMB + 1), (low, low, 0)):
                total[i, i:] += np.einsum("rk,rk->k", left, right).astype(object) * (1 << power)
    return total


@dataclass(frozen=True)
class Whitening:
    """The fit: ``n`` vectors, floor and remainder of each dimension's mean (sum = n * centre + rest), and the components."""

    n: int
    centre: np.ndarray
    rest: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    explained: list[float]

    @property
    def size(self) -> int:
        return len(self.rest)

    def loadings(self, components: int) -> tuple[np.ndarray, np.ndarray]:
        """Factors and subtrahends that make whitened values of centred whole numbers; zeros for a component without spread."""
        e = self.eigenvalues[:components]
        spread = e > SPREAD * max(self.eigenvalues[0], 0) if len(e) else e > 0
        factors = self.vectors[:, :components] * np.where(spread, 1 / np.sqrt(np.where(spread, e, 1)), 0)
        return factors, (np.array([float(r) for r in self.rest]) / max(self.n, 1)) @ factors

    def deviations(self, u: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n x - S)^2."""
        n, rest = self.n, self.rest
        reach = n * (int(np.abs(u).max(initial=0)) + 1)
        if reach * reach * max(self.size, 1) < 1 << 62:
            off = n * u - np.array(rest, np.int64)
            return (off * off).sum(1).tolist()
        wide = u.astype(object)
        own = (wide * wide).sum(1)
        cross = (wide * np.array(rest, object)).sum(1)
        return list(n * n * own - 2 * n * cross + sum(r * r for r in rest))


NOTHING = Whitening(0, np.zeros(0, np.int64), [], np.zeros(0), np.zeros((0, 0)), [])


def covariance(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariances, divisor n, from exact sums of squares; each is one correctly rounded division."""
    size = len(rest)
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            shared = squares[i, i] if i == j else (squares[i, j] - squares[i, i] - squares[j, j]) // 2
            out[i, j] = out[j, i] = (n * shared - rest[i] * rest[j]) / (n * n)
    return out


def fit_whitening(vectors: DataFrame, vector: str = "embedding") -> Whitening:
    """Fit over all usable vectors: those of finite entries and of the most frequent length (ties: the longer one).

    The driver gets two numbers per dimension and one per pair of dimensions.  Without usable vectors the fit is empty.
    """
    column = vectors.select(F.col(vector).alias("_vector"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for size in np.unique(_lists(batch.column(0))[0]).tolist():
                if size:
                    _, x = whole_numbers(batch.column(0), size)
                    entry = found.setdefault(size, [0, np.zeros(size, object)])
                    entry[0] += len(x)
                    entry[1] += x.sum(0).astype(object)
        for size, (count, total) in found.items():
            exact = pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))
            rows = [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([count] * size, pa.int64()), exact]
            yield pa.RecordBatch.from_arrays(rows, ["size", "i", "n", "total"])

    per_task = column.mapInArrow(sums, "size int, i int, n bigint, total decimal(38,0)")
    stats = checkpointed(per_task.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    chosen = stats.filter("i = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if chosen is None:
        return NOTHING
    size, n = chosen["size"], chosen["n"]
    totals = {r["i"]: int(r["total"]) for r in stats.filter(F.col("size") == size).collect()}
    centre = np.array([totals[i] // n for i in range(size)], np.int64)
    rest = [totals[i] % n for i in range(size)]

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object)
        for batch in batches:
            total += square_sums(whole_numbers(batch.column(0), size)[1] - centre)
        rows, columns = np.triu_indices(size)
        exact = pa.array([Decimal(int(t)) for t in total[rows, columns]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), exact], ["i", "j", "total"])

    found = column.mapInArrow(squares, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total"))
    matrix = covariance(n, rest, {(r["i"], r["j"]): int(r["total"]) for r in found.collect()})
    values, basis = np.linalg.eigh(matrix)
    values, basis = values[::-1].copy(), basis[:, ::-1].copy()
    # A component's sign is free; its largest entry is made positive.
    basis *= np.sign(basis[np.abs(basis).argmax(0), np.arange(size)])
    trace = float(np.trace(matrix))
    return Whitening(n, centre, rest, values, basis, [float(v / trace) if trace > 0 else 0.0 for v in values])


def whiten(vectors: DataFrame, fit: Whitening, components: int = 8, vector: str = "embedding") -> DataFrame:
    """Usable rows with all their columns, ``whitened`` (array<double>, one entry per component) and ``deviation`` (text).

    ``deviation`` is the exact sum over the dimensions of (n x - S)^2 in digits, as it outgrows 64 bits in
    large tables.  Both replace columns of these names.  Rows whose vector is NULL, empty, of another
    length than the fit's, or holds a NULL or a number that is not finite are left out; equal rows and
    NULL ids stay as they are.  A component without spread is 0 throughout.  Entries beyond 2^30 in size
    count as 2^30.  An empty table gives no rows.
    """
    kept = [c for c in vectors.columns if c not in ("whitened", "deviation")]
    factors, away = fit.loadings(components)
    at, size, centre = kept.index(vector), fit.size, fit.centre

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, x = whole_numbers(batch.column(at), size)
            if not size or not usable.any():
                continue
            u = x - centre
            values = u.astype(np.float64) @ factors - away
            ends = np.arange(len(u) + 1, dtype=np.int32) * values.shape[1]
            whitened = pa.ListArray.from_arrays(ends, pa.array(values.ravel()))
            told = pa.array([str(int(d)) for d in fit.deviations(u)], pa.string())
            chosen = batch.filter(pa.array(usable))
            yield pa.RecordBatch.from_arrays([*chosen.columns, whitened, told], [*kept, "whitened", "deviation"])

    fields = [vectors.schema[c] for c in kept]
    added = [T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.StringType())]
    return vectors.select(*[vectors[c] for c in kept]).mapInArrow(rows, T.StructType([*fields, *added]))


def identity_error(whitened: DataFrame, fit: Whitening, components: int = 8) -> float:
    """Largest absolute entry of the whitened values' covariance minus the identity, measured on all rows.

    Components without spread are not in it.  Without rows it is 0.
    """
    spread = np.abs(fit.loadings(components)[0]).max(0, initial=0) > 0
    count = len(spread)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, n = np.zeros(count), np.zeros((count, count)), 0
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, count)
            first, second, n = first + values.sum(0), second + values.T @ values, n + len(values)
        yield pa.RecordBatch.from_pylist([{"n": n, "first": first.tolist(), "second": second.ravel().tolist()}])

    if not count or not fit.n:
        return 0.0
    tasks = whitened.select("whitened").mapInArrow(sums, "n bigint, first array<double>, second array<double>")
    flat = tasks.select("n", F.posexplode(F.concat("first", "second")).alias("place", "value"))
    found = flat.groupBy("place").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect()
    n = found[0]["n"]
    total = np.zeros(count + count * count)
    for r in found:
        total[r["place"]] = r["value"]
    mean, second = total[:count] / n, total[count:].reshape(count, count) / n
    off = np.abs(second - np.outer(mean, mean) - np.eye(count))[np.ix_(spread, spread)]
    return float(off.max(initial=0))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector and component; ``deviation`` is NULL where it outgrows a long, ``deviation_digits`` never."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fit = fit_whitening(vectors)
    rows = whiten(vectors, fit)
    error = identity_error(rows, fit)
    component = F.posexplode("whitened").alias("_at", "whitened")
    explained = F.get(F.array(*[F.lit(v) for v in fit.explained[:8]]).cast("array<double>"), F.col("_at"))
    return rows.select("vec_id", "deviation", component).select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("bigint").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        explained.alias("explained"),
        F.lit(error).alias("identity_error"),
        F.col("deviation").alias("deviation_digits"),
    )
