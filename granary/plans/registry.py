"""All registered queries outside the corpus subpackage, with their DuckDB statements."""

from __future__ import annotations

from importlib import import_module

from granary.plans.catalog import ORACLES, QUERIES

FLAGSHIP = "eval_by_source"
for _name in ("batch_queries", "group_queries", "token_queries", "text_queries", "evaluation_queries", "reward_queries", "grading_queries", "record_queries"):
    import_module(f"granary.plans.{_name}")

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
