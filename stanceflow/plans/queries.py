"""Every registered query, imported so the registry fills up."""

from __future__ import annotations

from stanceflow.plans import q_align, q_generation, q_metrics, q_model, q_pairs, q_text  # noqa: F401
from stanceflow.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
