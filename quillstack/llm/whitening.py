"""Embedding whitening from an exact integer scatter.

Entries become whole numbers. Tasks subtract a shift, the same for all, and sum the numbers and their cross-products without rounding: blocks of rows whose products stay below 2^53 are multiplied in doubles,
where every sum is a whole number that a double holds; other blocks in Python's integers. A task's sums are split into 32-bit limbs, which Spark adds up as longs, so sums of any size stay exact.
n X'X - S S' is formed in integers; only then it is divided, as doubles, and decomposed by eigh. A further scan measures the whitened rows' own covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: What is subtracted before anything is multiplied. Any whole number gives the same scatter; this one leaves small numbers.
SHIFT = OFFSET
#: Eigenvalues under this share of their sum are rounding: their components hold no variance and aren't given.
LEAST_SHARE = 1e-13
ROWS, _EXACT, _LONG, _LIMB = 4096, 1 << 53, 1 << 63, 32


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + OFFSET - SHIFT of each entry: longs, or Python's integers where one is too large for a double to be exact in a long."""
    scaled = np.floor(SCALE * vectors)
    if np.abs(scaled).max(initial=0.0) < _EXACT / 2:
        return scaled.astype(np.int64) + (OFFSET - SHIFT)
    return np.array([[int(c) + (OFFSET - SHIFT) if np.isfinite(c) else _large(v) for c, v in zip(row, raw, strict=True)] for row, raw in zip(scaled, vectors, strict=True)], dtype=object)


def _large(v: float) -> int:
    """For an entry whose multiple is beyond the doubles: it is whole itself."""
    return int(v) * SCALE + (OFFSET - SHIFT)


def products(y: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums and cross-products of the columns of y, exact."""
    most = int(np.abs(y).max(initial=0))
    if y.dtype != object and most * most * max(1, len(y)) < _EXACT:
        f = y.astype(float)
        return [int(v) for v in f.sum(axis=0)], [[int(v) for v in row] for row in f.T @ f]
    o = y.astype(object)
    return list(o.sum(axis=0)), [list(row) for row in o.T @ o]


def _rows(batch: pa.RecordBatch, place: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of a batch's vectors as doubles, with where they begin."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield at, np.asarray(part.column(place).flatten(), dtype=float).reshape(part.num_rows, width)


@dataclass
class Whitening:
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def deviations(self, vectors: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Of each vector the exact sum of squares of n*x - S, and (n*x - S)/n, rounded once."""
        y = whole(vectors)
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0)
        if y.dtype != object and most * most * max(1, y.shape[1]) < _LONG:
            d = self.n * y - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist(), d / self.n
        d = [[self.n * int(v) - s for v, s in zip(row, self.sums, strict=True)] for row in y]
        return [sum(v * v for v in row) for row in d], np.array([[v / self.n for v in row] for row in d], dtype=float).reshape(y.shape)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): rows whose vector has no null or non-finite entry, as doubles."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return v.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def scatter(rows: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, n X'X - S S') of the rows' shifted whole vectors, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, [0] * width, [[0] * width for _ in range(width)]
        for batch in batches:
            for _, v in _rows(batch, 0, width):
                s, c = products(whole(v))
                n += len(v)
                sums = [a + b for a, b in zip(sums, s, strict=True)]
                cross = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(cross, c, strict=True)]
        entries = [(-1, -1, n), *((-1, j, s) for j, s in enumerate(sums)), *((i, j, cross[i][j]) for i in range(width) for j in range(i, width))]
        limbs = []
        for i, j, value in entries:
            sign, value, k = -1 if value < 0 else 1, abs(value), 0
            while value:
                limbs.append((i, j, k, sign * (value & 0xFFFFFFFF)))
                value, k = value >> _LIMB, k + 1
        columns = list(zip(*limbs, strict=True)) if limbs else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.int64())], ["i", "j", "k", "limb"])

    found = rows.select("v").mapInArrow(run, "i int, j int, k int, limb long").groupBy("i", "j", "k").agg(F.sum("limb").alias("limb")).collect()
    total: dict[tuple[int, int], int] = {}
    for r in found:  # as many as a matrix of the vectors' width has places, times a few limbs
        total[r["i"], r["j"]] = total.get((r["i"], r["j"]), 0) + (r["limb"] << _LIMB * r["k"])
    n, sums = total.get((-1, -1), 0), [total.get((-1, j), 0) for j in range(width)]
    return n, sums, [[n * total.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(width)] for i in range(width)]


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """Mean and components of (id, v) rows, all of one width."""
    n, sums, exact = scatter(rows, width)
    covariance = np.array([[v / (n * n) for v in row] for row in exact], dtype=float).reshape(width, width)
    trace = sum(exact[i][i] for i in range(width)) / (n * n)
    values, vectors = np.linalg.eigh(covariance) if width else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST_SHARE * trace] if trace > 0 else order[:0]
    return Whitening(n, sums, values[order], vectors[:, order].T, values[order] / trace if trace > 0 else np.zeros(0))


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, from the rows themselves: they are centred exactly, so sums of their products are the covariance."""
    k, width = len(w.eigenvalues), len(w.sums)
    at = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for _, v in _rows(batch, 0, width):
                white = w.project(w.deviations(v)[1])
                total += white.T @ white
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], ["i", "j", "s"])

    summed = rows.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return summed.agg(F.max(F.abs(F.col("s") / w.n - (F.col("i") == F.col("j")).cast("double")))).first()[0]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component from 1, n, deviation decimal, whitened, explained, identity_error): each row's whitened values, at most `components` of them.

    An entry c counts as x = floor(SCALE*c) + OFFSET. n vectors are fitted, with sums S: components are unit eigenvectors of their covariance (divisor n) by falling eigenvalue e, `explained` is e over
    the trace, `deviation` the sum of (n*x - S)^2, exact (null if it has more than 38 digits), `whitened` x - S/n on the component over sqrt(e).

    Vectors that are null or have a null or non-finite entry take no part, and neither do those of another width than the commonest one (of equally common ones the larger). Repeated rows and rows with a null
    id count and are given. Equal eigenvalues have any orthogonal components, the same for all rows. Components without variance aren't given, so n equal vectors, a single one, and empty ones give no row, as does
    an empty table. Entries of any size are exact; only the eigenvectors are rounded. Only the two named columns are read, so others may have any name. The driver holds a matrix of the vectors' width.
    """
    rows = usable(vectors, id_col, vector_col)
    key = vectors.schema[id_col].dataType.simpleString()
    out = f"id {key}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.col("k").desc(), F.col("d").desc()).first()
    width = common["d"] if common else 0
    rows = rows.where(F.size("v") == width)
    w = fit(rows, width, components) if width else None
    k = len(w.eigenvalues) if w else 0
    if not k:
        return rows.sparkSession.createDataFrame([], out)
    error = identity_error(rows, w)
    most = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in _rows(batch, 1, width):
                deviation, centred = w.deviations(v)
                m = len(v)
                each = np.repeat(np.arange(m), k)
                told = pa.array([d if d < _LONG else None for d in deviation], pa.int64()).cast(pa.decimal128(38, 0)) if max(deviation) < _LONG else pa.array([d if d < most else None for d in deviation], pa.decimal128(38, 0))
                columns = [batch.column(0).slice(at, m).take(pa.array(each)), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, w.n), told.take(pa.array(each))]
                columns += [w.project(centred).reshape(-1), np.tile(w.explained, m), np.full(m * k, error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, out)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitened(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")
