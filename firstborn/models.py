"""Immutable model and sampler settings, validated on the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

START_TYPES = ("random", "all same cluster", "all different clusters")


def _positive_pair(name: str, pair) -> None:
    if len(pair) != 2 or not all(0 < v < math.inf for v in pair):
        raise ValueError(f"{name}: give two finite numbers above zero, not {pair}")


def _positive(name: str, *values: float) -> None:
    if not all(0 < v < math.inf for v in values):
        raise ValueError(f"{name} must be finite and above zero")


def _covariance(name: str, matrix: np.ndarray, dim: int) -> None:
    if matrix.shape != (dim, dim):
        raise ValueError(f"{name} is {matrix.shape}, but the prior mean has {dim} entries")
    if not np.isfinite(matrix).all() or not np.allclose(matrix, matrix.T) or np.linalg.eigvalsh(matrix)[0] <= 0:
        raise ValueError(f"{name} must be finite, symmetric and positive definite")


@dataclass(frozen=True)
class GaussianModel:
    """Known within-cluster covariance, normal prior on the cluster mean."""

    data_covariance: np.ndarray
    prior_mean: np.ndarray
    prior_covariance: np.ndarray
    whitening: np.ndarray = field(init=False, repr=False)
    prior_scale: np.ndarray = field(init=False, repr=False)
    white_mean: np.ndarray = field(init=False, repr=False)
    log_det: float = field(init=False, repr=False)

    def __post_init__(self):
        data = np.atleast_2d(np.asarray(self.data_covariance, dtype=float))
        prior = np.atleast_2d(np.asarray(self.prior_covariance, dtype=float))
        mean = np.atleast_1d(np.asarray(self.prior_mean, dtype=float))
        if not np.isfinite(mean).all():
            raise ValueError("the prior mean must be finite")
        _covariance("data_covariance", data, mean.size)
        _covariance("prior_covariance", prior, mean.size)
        # One change of basis makes the data covariance the identity and the
        # prior covariance diagonal, so every later formula is per dimension.
        inverse = np.linalg.inv(np.linalg.cholesky(data))
        scale, rotation = np.linalg.eigh(inverse @ prior @ inverse.T)
        if np.allclose(inverse @ prior @ inverse.T, np.diag(np.diag(inverse @ prior @ inverse.T))):
            scale, rotation = np.diag(inverse @ prior @ inverse.T).copy(), np.eye(mean.size)
        whitening = rotation.T @ inverse
        for name, value in (
            ("data_covariance", data),
            ("prior_covariance", prior),
            ("prior_mean", mean),
            ("whitening", whitening),
            ("prior_scale", scale),
            ("white_mean", whitening @ mean),
            ("log_det", float(np.linalg.slogdet(whitening)[1])),
        ):
            object.__setattr__(self, name, value)

    @property
    def dim(self) -> int:
        return self.prior_mean.size


@dataclass(frozen=True)
class CountModel:
    """Dirichlet-multinomial counts; ``scale`` is one number for all terms or one per term.

    ``counts_per_observation`` is what one observation counts in all, for simulated data; no
    score depends on it.
    """

    dim: int
    scale: float | Mapping[str, float] = 1.0
    counts_per_observation: int = 1

    def __post_init__(self):
        if self.counts_per_observation < 1:
            raise ValueError("counts_per_observation must be at least 1")
        per_term = isinstance(self.scale, Mapping)
        _positive("scale", *(self.scale.values() if per_term else [self.scale]))
        if self.dim < 2 or per_term and len(self.scale) != self.dim:
            raise ValueError(f"dim={self.dim} must be 2 or more and the number of terms in scale")

    @property
    def total(self) -> float:
        if isinstance(self.scale, Mapping):
            return float(sum(self.scale.values()))
        return float(self.scale) * self.dim

    def scale_at(self, term) -> float:
        if not isinstance(self.scale, Mapping):
            return float(self.scale)
        if term not in self.scale:
            raise ValueError(f"no Dirichlet scale for term {term}")
        return float(self.scale[term])

    def scale_of(self, term: Column) -> Column:
        if not isinstance(self.scale, Mapping):
            return F.lit(float(self.scale))
        pairs = [F.lit(v) for item in self.scale.items() for v in (item[0], float(item[1]))]
        unknown = F.raise_error(F.concat(F.lit("no Dirichlet scale for term "), term.cast("string"))).cast("double")
        return F.coalesce(F.create_map(*pairs)[term], F.when(term.isNotNull(), unknown))


@dataclass(frozen=True)
class TopicModel:
    """Documents as mixtures of a fixed number of topics shared within a cluster."""

    num_topics: int = 10
    num_words: int = 100
    topic_parameter: float = 0.1
    word_parameter: float = 0.1

    def __post_init__(self):
        if min(self.num_topics, self.num_words) < 2:
            raise ValueError("a topic model has at least two topics and two words")
        _positive("topic_parameter and word_parameter", self.topic_parameter, self.word_parameter)

    def topics_as_counts(self) -> CountModel:
        return CountModel(self.num_topics, self.topic_parameter)


@dataclass(frozen=True)
class StickArrivalPrior:
    """Clusters arrive as coin flips; later points break sticks over the clusters so far."""

    sticks: tuple[float, float] = (1.0, 1.0)
    arrivals: tuple[float, float] = (1.0, 1.0)
    sample_sticks: bool = False

    def __post_init__(self):
        _positive_pair("sticks", self.sticks)
        _positive_pair("arrivals", self.arrivals)

    @property
    def log_beta_sticks(self) -> float:
        a, b = self.sticks
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    @property
    def log_beta_arrivals(self) -> float:
        a, b = self.arrivals
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


@dataclass(frozen=True)
class DirichletProcessPrior:
    alpha: float = 1.0
    sample_alpha: bool = False

    def __post_init__(self):
        _positive("alpha", self.alpha)


@dataclass(frozen=True)
class SamplerSettings:
    """Settings shared by both kernels; one chain per entry of ``starts``.

    ``splits`` is the number of rounds of split and merge moves in a sweep.
    """

    iterations: int = 1000
    burn_in: int = 0
    skip: int = 1
    starts: tuple[str, ...] = ("random",)
    seed: int = 1
    splits: int = 1

    def __post_init__(self):
        if self.splits < 0:
            raise ValueError("splits is a number of rounds")
        if self.iterations < 1 or self.skip < 1 or self.burn_in < 0:
            raise ValueError("iterations and skip start at 1, burn_in at 0")
        if any(s not in START_TYPES for s in self.starts):
            raise ValueError(f"a start must be one of {START_TYPES}")


@dataclass(frozen=True)
class GibbsSettings(SamplerSettings):
    pass


@dataclass(frozen=True)
class MetropolisSettings(SamplerSettings):
    burn_in: int = 1000
    radius: int = 5
    adaptive: bool = False

    def __post_init__(self):
        super().__post_init__()
        if self.radius < 1:
            raise ValueError("the proposal radius must be at least 1")
