"""All registered queries, imported for their registration side effect."""

from pairforge.plans import q_io, q_merge, q_metrics, q_more, q_pairs, q_runs, q_schedule, q_text  # noqa: F401
from pairforge.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
