"""Imports every query module so that the registry is complete."""

from . import queries_backtest, queries_collection, queries_extract, queries_features, queries_gates, queries_history, queries_learning, queries_ledger, queries_profile, queries_resolution, queries_reviews, queries_streaming, queries_what_if  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
