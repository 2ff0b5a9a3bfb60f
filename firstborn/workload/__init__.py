from . import basics, fits, scores, summaries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
