"""All named queries of the library, and their SQL."""

from __future__ import annotations

import importlib

from .plans.registry import ORACLES, QUERIES

MODULES = ["text_queries", "dedup_queries", "vector_queries", "grading_queries", "trace_queries", "curate_queries", "workflows"]
for _name in MODULES:
    importlib.import_module(f".plans.{_name}", __package__)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
