"""Imports every query module, so the registry is complete."""

from gradeloom.plans import boards_queries, curation_queries, history_queries, panel_queries, source_queries, stats_queries, text_queries  # noqa: F401
from gradeloom.plans.registry import ORACLES, QUERIES  # noqa: F401
