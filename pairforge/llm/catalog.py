"""All training-data queries, imported for their registration side effect."""

from pairforge.llm import (  # noqa: F401
    ann, chat_format, decontam, dual_tree, html_text, jaccard_join, lm, mixing, secret_spans, sharding, spelling, toxicity, url_rules,
)
from pairforge.llm.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
