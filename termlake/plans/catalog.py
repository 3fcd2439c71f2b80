"""Imports every module that registers queries."""

from . import q_alignment, q_attribution, q_balance, q_candidates, q_convo, q_fuzzy, q_match, q_stats, q_streaming, q_text, q_vector, q_windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
