from .draws import gumbel, hash52, hash_uniform, row_uniform
from .special import (
    lbeta,
    lfactorial,
    lgamma,
    log_multivariate_beta,
    mvn_logpdf,
    mvt_logpdf,
    vector_sum,
)

__all__ = [
    "gumbel",
    "hash52",
    "hash_uniform",
    "row_uniform",
    "lbeta",
    "lfactorial",
    "lgamma",
    "log_multivariate_beta",
    "mvn_logpdf",
    "mvt_logpdf",
    "vector_sum",
]
