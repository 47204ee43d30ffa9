"""Whitening of embeddings from exact integer covariances.

Entries become integers. Their products are summed by float64 matrix products of small limbs: limbs of 20 bits, 4,096 rows at a time, so that
no sum reaches 2^53 and every one is exact. Sums by pair of columns and limb weight are merged by a group-by and recombined as big integers;
the covariance is then a quotient of integers, rounded once, as if each row had been centred before it was multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

LIMB_BITS, BLOCK_ROWS = 20, 4096
#: Products of blocks, under 2^54 each, that an int64 holds summed.
BLOCKS = 256


def usable(col: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    bad = F.exists(col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return col.isNotNull() & ~bad


def integers(col: Column, scale: float = 64.0, offset: int = 1_000_000) -> Column:
    """floor(scale * c) + offset of each entry as long; beyond the range of long, its bounds."""
    low, high = -(1 << 63), (1 << 63) - 1 - offset
    return F.transform(col, lambda c: F.greatest(F.lit(low), F.least(F.lit(high), F.floor(c.cast("double") * scale).cast("long"))) + F.lit(offset).cast("long"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an array column of longs or doubles, each of ``dims`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Float64 matrices, the k-th weighing 2^(20 k), that sum to x: entries of the last are signed, others from 0 to 2^20 - 1."""
    out = []
    while True:
        if -(1 << LIMB_BITS) <= x.min() and x.max() <= 1 << LIMB_BITS:
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        x = x >> LIMB_BITS


def products(x: np.ndarray) -> dict[int, np.ndarray]:
    """x' x as exact int64 matrices by limb weight: their sum with weights 2^(20 e) is the product. Up to BLOCK_ROWS rows."""
    parts, out = limbs(x), {}
    for a, left in enumerate(parts):
        for b, right in enumerate(parts):
            own = (left.T @ right).astype(np.int64)
            out[a + b] = out[a + b] + own if a + b in out else own
    return out


def _gram(fit: DataFrame, dims: int) -> dict[tuple[int, int], int]:
    """Sums of x_i x_j over all rows by i <= j, as integers; column ``dims`` is a one, so it gives the sums and the number of rows."""
    i, j = np.triu_indices(dims + 1)

    def flushed(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for e, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), e), pa.int32()), pa.array(m[i, j])], names=["i", "j", "e", "v"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        blocks = 0
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            x = np.hstack([x, np.ones((len(x), 1), np.int64)])
            for at in range(0, len(x), BLOCK_ROWS):
                for e, m in products(x[at : at + BLOCK_ROWS]).items():
                    sums[e] = sums[e] + m if e in sums else m
                blocks += 1
                if blocks == BLOCKS:
                    yield from flushed(sums)
                    sums, blocks = {}, 0
        yield from flushed(sums)

    parts = fit.select("x").mapInArrow(task, "i int, j int, e int, v long")
    out: dict[tuple[int, int], int] = {}
    # as many rows as pairs of columns and weights, however many vectors there are
    for r in parts.groupBy("i", "j", "e").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        out[r.i, r.j] = out.get((r.i, r.j), 0) + (int(r.v) << (LIMB_BITS * r.e))
    return out


@dataclass
class Whitening:
    """Everything that maps an integer vector to its whitened components."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray  # falling
    vectors: np.ndarray  # dims x components, of length one
    trace: float

    def __post_init__(self):
        self.centre = [(2 * s + self.n) // (2 * self.n) for s in self.sums]  # the whole number nearest to the mean
        self.rest = [s - self.n * c for s, c in zip(self.sums, self.centre, strict=True)]
        self.mean_rest = np.array([r / self.n for r in self.rest])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of components: (x - mean) along each eigenvector, over the square root of its eigenvalue."""
        near = x - np.array(self.centre, np.int64) if np.abs(x).max(initial=0) < 1 << 61 else (x.astype(object) - np.array(self.centre, object)).astype(float)
        return (near.astype(np.float64) - self.mean_rest) @ (self.vectors / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of (n x - S)^2 of each row, exactly."""
        if not len(x):
            return []
        far = max(max(abs(int(x.min()) - c), abs(int(x.max()) - c)) for c in (min(self.centre), max(self.centre))) + 1
        small = len(self.sums) * (self.n * far) ** 2 < 1 << 63
        kind = np.int64 if small else object
        off = (x.astype(kind) - np.array(self.centre, kind)) * self.n - np.array(self.rest, kind)
        return [int(v) for v in (off * off).sum(axis=1)]


def fit_whitening(fit: DataFrame, dims: int, components: int) -> Whitening | None:
    """The whitening of staged distinct rows ``x``; None without rows or variance."""
    gram = _gram(fit, dims)
    n = gram.get((dims, dims), 0)
    if not n or not dims:
        return None
    sums = [gram[i, dims] for i in range(dims)]
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            cov[i, j] = cov[j, i] = (n * gram[i, j] - sums[i] * sums[j]) / n**2  # of integers: rounded once
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    # a direction without variance has no unit to be measured in
    k = min(components, int((values > max(values[0], 0) * dims * np.finfo(float).eps * 8).sum()))
    return Whitening(n, sums, values[:k], np.ascontiguousarray(vectors[:, :k]), float(np.trace(cov))) if k else None


def _identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of all whitened rows, minus the identity."""
    k, dims = len(w.eigenvalues), len(w.sums)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            own = w.project(_matrix(batch.column(0), dims))
            total += own.T @ own
        at = np.arange(k * k)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    rows = fit.select("x").mapInArrow(task, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    cov = np.zeros(k * k)
    cov[[r["at"] for r in rows]] = [r.v for r in rows]
    return float(np.abs(cov.reshape(k, k) / w.n - np.eye(k)).max())


def whiten(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """A row per vector and component: (id, component, n, deviation, whitened, explained, identity_error).

    Vectors that are null or hold null or non-finite entries are dropped. Those of the commonest length count (of lengths as common, the
    longer); others belong to another space and are dropped, too, and so are empty ones. Fitted on each distinct integer vector once, so copies
    weigh nothing. Components without variance are left out; without any, and for an empty table, there are no rows. Repeated rows and null ids
    stay. deviation is a decimal, null beyond 38 digits. Eigenvectors are those of a matrix of dims x dims on the driver, whose size doesn't
    depend on the number of rows; each has its largest entry positive.
    """
    out = f"{id_col} {df.select(id_col).schema[0].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = df.where(usable(F.col(vector_col))).select(F.col(id_col), integers(F.col(vector_col)).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dims = lengths[0].d if lengths else 0
    rows = rows.where(F.size("x") == dims)
    fit = stage(rows.select("x").distinct(), "fit")
    w = fit_whitening(fit, dims, components)
    if w is None:
        return df.sparkSession.createDataFrame([], out)
    w.vectors *= np.sign(w.vectors[np.abs(w.vectors).argmax(axis=0), np.arange(w.vectors.shape[1])])
    error = _identity_error(fit, w)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = _matrix(part.column(1), dims)
                own = w.project(x)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1]), pa.int32()), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(str, w.deviations(x)), pa.string()), flat], names=[id_col, "deviation", "w"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    made = rows.mapInArrow(task, f"{id_col} {kind}, deviation string, w array<double>")
    explained = F.array(*(F.lit(float(v / w.trace)) for v in w.eigenvalues))
    each = made.select(id_col, F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"), F.posexplode("w").alias("at", "whitened"))
    return each.select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
