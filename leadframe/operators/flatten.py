"""Flat and nested export forms of the company record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadframe import schema as S
from leadframe.functions.collections import null_to_empty
from leadframe.functions.dates import iso_timestamp


def all_technologies(tech_stack: Column) -> Column:
    """All technologies, categories in their fixed order; null counts as none."""
    return F.concat(*[null_to_empty(tech_stack[c]) for c in S.TECH_CATEGORIES])


def flatten_companies(df: DataFrame, max_technologies: int | None = None) -> DataFrame:
    """The fixed 20-column export row, with all technologies or the first of them."""
    e, s = F.col("enrichment"), F.col("score")
    tech = e["tech_stack"]
    used = all_technologies(tech)
    if max_technologies is not None:
        used = F.slice(used, 1, max_technologies)
    names = F.array_join(used, ", ")
    return df.select(
        F.col("name").alias("company_name"),
        "domain",
        "website",
        "description",
        "source",
        "source_url",
        iso_timestamp("scraped_at").alias("scraped_at"),
        e["employee_count"].alias("employee_count"),
        e["company_size"].alias("company_size"),
        e["founded_year"].alias("founded_year"),
        e["industry"].alias("industry"),
        e["geographic_info"]["country"].alias("country"),
        e["geographic_info"]["city"].alias("city"),
        e["funding_info"]["stage"].alias("funding_stage"),
        e["funding_info"]["total_funding"].alias("total_funding"),
        e["hiring_intent"]["total_open_positions"].alias("open_positions"),
        e["hiring_intent"]["is_hiring"].alias("is_hiring"),
        F.when(tech.isNotNull(), names).alias("technologies"),
        s["total_score"].alias("total_score"),
        s["priority"].alias("priority"),
    )


def nested_companies(df: DataFrame) -> DataFrame:
    """The nested record with both timestamps as ISO text."""
    return df.withColumns(
        {c: iso_timestamp(c) for c in ("scraped_at", "updated_at") if c in df.columns}
    )


def by_priority(df: DataFrame, level: str = "high") -> DataFrame:
    return df.filter(F.col("score.priority") == level)
