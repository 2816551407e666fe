"""Embedding whitening: a randomised range finder with power passes, and Rayleigh-Ritz.

A random basis, a little wider than the components asked for, is multiplied by
the covariance in a pass over all centred rows and made orthonormal, again and
again.  Each pass also gives the covariance inside the basis (Rayleigh-Ritz), and
the residuals of its components.  When they do not vanish within the passes
allowed, or plainly will not at the rate at which they shrink, the basis is
expanded to the full dimension, where one more pass gives the covariance itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, matrix, whole_vector


class Centre:
    """Count and sums of the fit list; rows are centred by the whole part of the mean first, so that no digit is lost."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=object)
        self.part = np.array([s % n / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part

    def deviation(self, x: np.ndarray) -> list[int] | np.ndarray:
        """Sum over the dimensions of (n x - sum)^2, exact."""
        away = x - self.whole
        most = self.n * (int(np.abs(away).max()) + 1 if away.size else 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            scaled = self.n * away - self.rest.astype(np.int64)
            return np.einsum("ij,ij->i", scaled, scaled)
        scaled = self.n * away.astype(object) - self.rest
        return (scaled * scaled).sum(axis=1)


def _summed(fit: DataFrame, one: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all rows of what ``one`` gives for a batch, an array of a fixed number of values.

    A task adds up its batches and emits each value once; values are summed by place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = one(matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            value = pa.array(total) if kind == "double" else pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), value], ["place", "value"])

    shares = bounded_batches(fit).select("x").mapInArrow(run, f"place int, value {kind}")
    found = shares.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    return np.array([r["value"] for r in found], dtype=np.float64 if kind == "double" else object)


def _count_and_sums(x: np.ndarray) -> np.ndarray:
    wide = int(np.abs(x).max()) * len(x) >= 1 << 62
    return np.concatenate([[len(x)], (x.astype(object) if wide else x).sum(axis=0)]).astype(object)


def _orthonormal(m: np.ndarray) -> np.ndarray:
    return np.linalg.qr(m)[0]


def ritz(basis: np.ndarray, product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Rayleigh-Ritz: all values of the covariance inside the basis (falling), the first ``k`` unit vectors, their largest residual."""
    inside = basis.T @ product
    values, turn = np.linalg.eigh((inside + inside.T) / 2)
    values, turn = values[::-1], turn[:, ::-1][:, :k]
    vectors = basis @ turn
    residual = np.linalg.norm(product @ turn - vectors * values[:k], axis=0)
    return values, vectors, float(residual.max(initial=0.0))


def components_of(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, oversampling: int = 10, passes: int = 8, tolerance: float = 1e-13, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The first ``k`` eigenvalues and unit eigenvectors of the matrix that ``product`` multiplies by; passes made, and the last basis' width.

    A residual passes at ``tolerance`` of the largest value.  It shrinks in a pass about as the
    last value of the basis to the k-th; when the passes left cannot bring it down, the rest of them is saved.
    """
    k, width = min(k, d), min(d, k + oversampling)
    basis = np.eye(d) if width == d else _orthonormal(np.random.default_rng(seed).standard_normal((d, width)))
    for made in range(1, passes + 1):
        image = product(basis)
        values, vectors, residual = ritz(basis, image, k)
        bound = tolerance * max(values[0], 0)
        if residual <= bound or width == d:
            return values[:k], vectors, made, width
        rate = abs(values[-1]) / max(values[k - 1], 1e-300)
        if made >= 3 and residual * rate ** (passes - made) > bound:
            break
        basis = _orthonormal(image)
    full = np.eye(d)
    values, vectors, _ = ritz(full, product(full), k)
    return values[:k], vectors, made + 1, d


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = 16,
    scale: int = 64,
    shift: int = 1_000_000,
    oversampling: int = 10,
    passes: int = 8,
    tolerance: float = 1e-13,
    seed: int = 11,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Components become integers floor(scale * c) + shift.  The fit list is each
    distinct integer vector once: it is made by one exchange, in which equal vectors are one row after
    each task, and written; every pass reads it without an exchange but for the
    few sums of each task.  Means are exact; rows are centred before anything is multiplied.  A task holds
    one matrix of dimension times basis width, the driver holds one too.

    ``deviation`` is exact, as decimal(38,0).  ``identity_error`` is measured in a pass
    over the whitened fit list.

    Defined results: vectors that are null or hold null or non-finite components
    give no rows, nor do empty ones, or those of another length than the commonest of the fit list (the
    shortest of equally common ones); a component whose integer passes 2^53 counts as
    non-finite; directions without variance (below 1e-12 of the largest)
    give no component, so a fit list of one vector gives no rows; ids may be null
    or repeat; no rows give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    base = vectors.select(vectors[id_col].alias("vec_id"), whole_vector(vectors[vector_col], scale, shift).alias("x")).where("size(x) > 0")
    all_lengths = scratch.keep(base.select("x").distinct(), "fit")
    length = all_lengths.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    id_type = base.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, deviation decimal(38,0), whitened double, explained double"
    shape = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    if length is None:
        return spark.createDataFrame([], schema).withColumns({"n": F.lit(0).cast("bigint"), "identity_error": F.lit(0.0)}).select(*shape)
    d, fit = length["d"], all_lengths.where(F.size("x") == length["d"])
    n, *sums = map(int, _summed(fit, _count_and_sums, "decimal(38,0)"))
    centre = Centre(n, sums)

    def product(basis: np.ndarray) -> np.ndarray:
        def one(x: np.ndarray) -> np.ndarray:
            rows = centre.centred(x)
            return (rows.T @ (rows @ basis)).ravel()

        return _summed(fit, one, "double").reshape(d, basis.shape[1]) / n

    values, found, _, _ = components_of(product, d, components, oversampling, passes, tolerance, seed)
    rank = int((values > 1e-12 * max(values[0], 0)).sum())
    values, found = values[:rank], found[:, :rank]
    # either sign is right: the largest entry is positive
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(rank)]) if rank else found
    whitener = found / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        rows = centre.centred(x)
        white = rows @ whitener
        return np.concatenate([[float((rows * rows).sum())], white.sum(axis=0), (white.T @ white).ravel()])

    trace, *rest = _summed(fit, moments, "double")
    mean = np.array(rest[:rank]) / n
    covariance = np.array(rest[rank:]).reshape(rank, rank) / n - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(rank)).max(initial=0.0))
    explained = values / (trace / n) if rank else values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not rank:
                continue
            x = matrix(batch.column(1))
            white, away = centre.centred(x) @ whitener, centre.deviation(x)
            exact = pa.array([Decimal(int(v)) for v in away], pa.decimal128(38, 0)) if away.dtype == object else pa.array(away).cast(pa.decimal128(38, 0))
            row = pa.array(np.repeat(np.arange(len(x)), rank))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), pa.array(np.tile(np.arange(1, rank + 1), len(x)), pa.int32()), exact.take(row), pa.array(white.ravel()), pa.array(np.tile(explained, len(x)))],
                ["vec_id", "component", "deviation", "whitened", "explained"],
            )

    rows = bounded_batches(base.where(F.size("x") == d)).mapInArrow(project, schema)
    return rows.withColumns({"n": F.lit(n).cast("bigint"), "identity_error": F.lit(error)}).select(*shape)


def op11_whiten(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("bigint"))
