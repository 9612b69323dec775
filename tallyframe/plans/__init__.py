"""The registered queries, each with its SQL twin where SQL can say the same."""

from . import cleaning, history, metrics, models, profiles, reports, scalars, statistics  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
