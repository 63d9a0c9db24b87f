"""Operators bound to the given tables, each with its checking SQL."""

import importlib

from triagelake.plans.registry import ORACLES, QUERIES

MODULES = (
    "cleaning_queries",
    "text_queries",
    "table_queries",
    "search_queries",
    "answer_queries",
    "model_queries",
    "fitted_queries",
    "stream_queries",
)

for _name in MODULES:
    importlib.import_module(f"triagelake.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
