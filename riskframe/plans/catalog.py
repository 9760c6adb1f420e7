"""Imports every query module so the registry is complete."""

from riskframe.plans import (q_clean, q_ensembles, q_explain, q_features, q_files, q_metrics, q_more,  # noqa: F401
                             q_neighbours, q_ops, q_stats, q_stream, q_text, q_train)
from riskframe.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
