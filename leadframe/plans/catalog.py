"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadframe.plans import queries_leads, queries_sources, queries_text

GROUPS = [queries_text, queries_leads, queries_sources]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for g in GROUPS for name, q in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for g in GROUPS for name, s in g.ORACLES.items()}
