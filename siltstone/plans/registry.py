"""The queries over the library's own operators, by the module that defines them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("search_plans", "rollup_plans", "history_plans", "text_plans", "posting_plans", "record_plans", "match_plans", "web_plans", "skill_plans", "queue_plans", "source_plans", "resume_plans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for name in MODULES for k, v in import_module(f"siltstone.plans.{name}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for name in MODULES for k, v in import_module(f"siltstone.plans.{name}").ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked search with facets, a stable order and a page."""
    return queries()["sco16_job_search"](spark, sf_dir)
