"""All registered queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from murmura.plans.star import Star

GROUPS = ["q_scores", "q_reports", "q_text", "q_streams", "q_more", "q_rest", "q_views", "q_rules"]


def _entries() -> dict[str, tuple[Callable[[Star], DataFrame], str | None]]:
    found: dict = {}
    for group in GROUPS:
        found |= import_module(f"murmura.plans.{group}").QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(Star(spark, sf_dir))) for name, (plan, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
