"""Special functions as native Column expressions; sums of many ln Gamma of one row in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# Coefficients B_2k / (2k (2k - 1)) of Stirling's series for ln Gamma.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
SHIFT = 8
UNROLL_LIMIT = 8


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def lgamma(x) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8 minus ln of the rising product."""
    if not isinstance(x, Column):
        return F.lit(math.lgamma(x))
    z = x + F.lit(float(SHIFT))
    inv = F.lit(1.0) / z
    inv2 = inv * inv
    tail: Column = F.lit(STIRLING[-1])
    for coefficient in reversed(STIRLING[:-1]):
        tail = F.lit(coefficient) + inv2 * tail
    rising = x
    for step in range(1, SHIFT):
        rising = rising * (x + F.lit(float(step)))
    return (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + inv * tail - F.ln(rising)


def lbeta(a, b) -> Column:
    """ln B(a, b)."""
    if not isinstance(a, Column) and not isinstance(b, Column):
        return F.lit(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    return lgamma(a) + lgamma(b) - lgamma(_col(a) + _col(b))


def lfactorial(n: Column) -> Column:
    """ln n!."""
    return lgamma(n.cast("double") + 1.0)


def log_multivariate_beta(parameters: Column) -> Column:
    """Sum of lgamma(a_j) minus lgamma(sum a_j), over an array column."""
    total = F.aggregate(parameters, F.lit(0.0), lambda acc, a: acc + a)
    parts = F.aggregate(parameters, F.lit(0.0), lambda acc, a: acc + lgamma(a))
    return parts - lgamma(total)


def lgammas(x: np.ndarray) -> np.ndarray:
    """``lgamma`` of an array of numbers above zero."""
    z = x + SHIFT
    inv2 = 1.0 / (z * z)
    tail = np.full(x.shape, STIRLING[-1])
    for coefficient in reversed(STIRLING[:-1]):
        tail = coefficient + inv2 * tail
    rising = np.log(x)
    for step in range(1, SHIFT):
        rising += np.log(x + step)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + tail / z - rising


def _table(arrays: pa.Array) -> np.ndarray:
    return arrays.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(arrays), -1)


@arrow_udf(T.DoubleType())
def log_beta_gain(parameters: pa.Array, counts: pa.Array) -> pa.Array:
    """ln B(parameters + counts) - ln B(parameters) of arrays of one length in all rows.

    Parameters beyond the counts are those of terms that were not counted.  One projection with
    as many ``lgamma`` as this takes is too long for the compiler.
    """
    if not len(counts):
        return pa.array([], pa.float64())
    a, c = _table(parameters), _table(counts)
    own, total = a[:, : c.shape[1]], a.sum(axis=1)
    return pa.array((lgammas(own + c) - lgammas(own)).sum(axis=1) + lgammas(total) - lgammas(total + c.sum(axis=1)))


def vector_sum(dim: int, term: Callable[[int | Column], Column]) -> Column:
    """Sum of ``term(i)`` for i = 0..dim-1: plain arithmetic when short, a fold when long."""
    if dim <= UNROLL_LIMIT:
        out = term(0)
        for i in range(1, dim):
            out = out + term(i)
        return out
    return F.aggregate(F.sequence(F.lit(0), F.lit(dim - 1)), F.lit(0.0), lambda acc, i: acc + term(i))


def constant_at(values: Sequence[float], i) -> Column:
    """Element ``i`` of a short driver-side vector, as a literal where ``i`` is known."""
    if isinstance(i, int):
        return F.lit(float(values[i]))
    return F.array(*[F.lit(float(v)) for v in values])[i]


def linear_map(matrix: np.ndarray, x: Column) -> Column:
    """``matrix @ x`` for an array column; diagonal and short matrices stay plain arithmetic."""
    dim = matrix.shape[0]
    if np.allclose(matrix, np.diag(np.diag(matrix))):
        return F.array(*[x[i] * F.lit(float(matrix[i, i])) for i in range(dim)])
    if dim <= UNROLL_LIMIT:
        return F.array(
            *[vector_sum(dim, lambda j, i=i: x[j] * F.lit(float(matrix[i, j]))) for i in range(dim)]
        )
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in matrix])
    return F.transform(
        rows,
        lambda row: F.aggregate(
            F.zip_with(row, x, lambda m, v: m * v), F.lit(0.0), lambda acc, v: acc + v
        ),
    )


def _whitened(x: Column, mean: Sequence[float], cov: np.ndarray) -> tuple[Column, int, float]:
    """Squared Mahalanobis distance, dimension and ln det of a covariance."""
    cov = np.atleast_2d(np.asarray(cov, dtype=float))
    dim = cov.shape[0]
    lower = np.linalg.cholesky(cov)
    inverse = np.linalg.inv(lower)
    centred = F.array(*[x[i] - F.lit(float(mean[i])) for i in range(dim)])
    z = linear_map(inverse, centred)
    return vector_sum(dim, lambda i: z[i] * z[i]), dim, 2.0 * float(np.log(np.diag(lower)).sum())


def mvn_logpdf(x: Column, mean: Sequence[float], cov: np.ndarray) -> Column:
    """Multivariate normal log density of an array column."""
    distance, dim, log_det = _whitened(x, mean, cov)
    return F.lit(-0.5 * (dim * math.log(2 * math.pi) + log_det)) - distance * 0.5


def mvt_logpdf(x: Column, location: Sequence[float], scale: np.ndarray, dof: float) -> Column:
    """Multivariate Student-t log density of an array column."""
    distance, dim, log_det = _whitened(x, location, scale)
    norm = (
        math.lgamma((dof + dim) / 2)
        - math.lgamma(dof / 2)
        - dim * math.log(dof * math.pi) / 2
        - log_det / 2
    )
    return F.lit(norm) - F.lit((dof + dim) / 2) * F.ln(F.lit(1.0) + distance / F.lit(float(dof)))
