"""Importing this package registers every query."""

from plumbline.plans import (  # noqa: F401
    curation_queries, date_queries, decision_queries, leakage_queries, metric_queries, retrieval_queries, run_queries, streaming_queries,
    strict_queries)
from plumbline.plans.registry import ORACLES, QUERIES  # noqa: F401
