"""Whitening of embeddings: one aggregation of generated SQL sums gives the covariance's upper triangle, LAPACK its components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.centroids import finite
from quillmine.llm.common import stored

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Moments:
    """Number of vectors, exact sums, and covariance (divisor n) of a list of integer vectors."""

    n: int
    sums: list[int]
    covariance: np.ndarray


@dataclass
class Components:
    """Unit eigenvectors (rows) of a covariance by falling eigenvalue, eigenvalues and trace."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float


def _at(i: int) -> str:
    return f"coalesce(get(x, {i}), 0L)"


def integer_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and x, the long components floor(scale * c), of vectors that are there and hold no null or non-finite entry."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(finite(F.col("embedding")))
    return kept.select("vec_id", F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("x"))


def moments(fit: DataFrame) -> Moments | None:
    """Moments of the rows of fit (x: array of long; shorter ones count as zero beyond their end), None without any dimension.

    Sums come first, in one row. Then one aggregation of generated sums, one for each pair i <= j of dimensions, of centred
    products: the centre is floor(mean), so each product is an integer and the sums of doubles are exact, in whatever order, up to
    2**53. What floor() took from the means is put right in integers on the driver, so the result is rounded once.
    """
    dims = fit.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return None
    first = fit.selectExpr("count(*) as n", *[f"sum({_at(i)}) as s{i}" for i in range(dims)]).first()
    n, sums = first["n"], [first[f"s{i}"] for i in range(dims)]
    centre = [s // n for s in sums]
    centred = fit.selectExpr(*[f"double({_at(i)} - {m}L) as c{i}" for i, m in enumerate(centre)])
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    products = centred.selectExpr(*[f"sum(c{i} * c{j}) as p{i}_{j}" for i, j in pairs]).first()
    rest = [s - n * m for s, m in zip(sums, centre, strict=True)]
    covariance = np.zeros((dims, dims))
    for (i, j), p in zip(pairs, products, strict=True):
        covariance[i, j] = covariance[j, i] = (int(p) * n - rest[i] * rest[j]) / (n * n)
    return Moments(n, sums, covariance)


def components(covariance: np.ndarray, most: int) -> Components:
    """At most so many components, of eigenvalues that stand above rounding; the largest entry of each is positive, so reruns agree."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors, trace = values[::-1], vectors.T[::-1], float(np.trace(covariance))
    kept = min(most, int((values > trace * len(values) * 2.0**-50).sum()))
    values, vectors = values[:kept], vectors[:kept]
    largest = vectors[np.arange(kept), np.abs(vectors).argmax(axis=1)]
    return Components(vectors * np.sign(largest)[:, None], values, trace)


def _dense(x: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as a matrix, zero beyond a list's end."""
    out = np.zeros((len(x), dims), dtype=np.int64)
    out[np.arange(dims) < pc.list_value_length(x).to_numpy(zero_copy_only=False)[:, None]] = x.flatten().to_numpy(zero_copy_only=False)
    return out


def scored(vectors: DataFrame, found: Moments, axes: Components) -> DataFrame:
    """deviation, the exact sum of (n * x - S)**2 (null from 9e18 on), and white, x - S/n on each axis over the root of its
    eigenvalue, beside vec_id of vectors (vec_id, x)."""
    n, sums = found.n, np.array(found.sums, dtype=np.int64)
    mean, turn = np.array([s / n for s in found.sums]), (axes.vectors / np.sqrt(axes.values)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _dense(b.column("x"), len(sums))
            apart = n * x - sums
            large = (apart.astype(np.float64) ** 2).sum(axis=1) >= 9e18
            white = (x - mean) @ turn
            at = np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)
            columns = [b.column("vec_id"), pa.array((apart * apart).sum(axis=1), mask=large), pa.ListArray.from_arrays(at, white.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "white"])

    return vectors.mapInArrow(run, "vec_id long, deviation long, white array<double>")


def identity_error(fit: DataFrame, found: Moments, axes: Components) -> float:
    """The largest absolute entry of the whitened fit list's covariance (centred, divisor n) minus the identity."""
    k = len(axes.values)
    white = scored(fit.select(F.lit(0).cast("long").alias("vec_id"), "x"), found, axes).select(*[F.get("white", F.lit(i)).alias(f"w{i}") for i in range(k)])
    centre = white.agg(*[F.avg(f"w{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = white.agg(*[F.avg((F.col(f"w{i}") - centre[i]) * (F.col(f"w{j}") - centre[j])) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, got, strict=True))


def whitened(vectors: DataFrame, most: int = 4, scale: int = 256) -> DataFrame:
    """Per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors (vec_id, embedding) that are null or hold null or non-finite entries are left out; the others become x = floor(scale * c).
    The fit list has each distinct x once, so repeated vectors don't weigh more, and repeated rows get equal results each.
    Vectors shorter than the longest count as zero beyond their end. Components whose eigenvalue is no more than rounding are
    left out, so equal vectors, a lone vector, empty vectors and an empty table give no row. deviation, the exact sum of
    (n * x - S)**2, is null from 9e18 on, where a long ends. A null vec_id stays null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = integer_rows(vectors, scale)
    fit = stored(rows.select("x").distinct(), "fit")
    found = moments(fit)
    axes = components(found.covariance, most) if found else None
    if axes is None or not len(axes.values):
        return spark.createDataFrame([], RESULT)
    error = identity_error(fit, found, axes)
    share = F.array(*[F.lit(float(v) / axes.trace) for v in axes.values])
    out = scored(rows, found, axes).select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
