"""Ranking and the top report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from leadframe.functions.text import blank, score_text
from leadframe.operators.flatten import all_technologies


def ranking_keys():
    """Highest rounded total first, no score counts as 0, ties in input order."""
    return [F.coalesce(F.col("score.total_score"), F.lit(0.0)).desc(), F.col("seq").asc()]


def rank(df: DataFrame) -> DataFrame:
    """All rows in ranking order (a range-partitioned sort)."""
    return df.orderBy(*ranking_keys())


def top_report(df: DataFrame, n: int = 5, techs: int = 5) -> DataFrame:
    """The ``n`` best leads as report lines.

    The limit is planned as a per-partition top-n, so the window that numbers
    the lines only ever sees ``n`` rows.
    """
    hiring = F.col("enrichment.hiring_intent")
    tech = F.col("enrichment.tech_stack")
    names = F.array_join(F.slice(all_technologies(tech), 1, techs), ", ")
    # flat rows first: a limit right on top of the sort is planned as a top-n
    lines = df.select(
        F.coalesce(F.col("score.total_score"), F.lit(0.0)).alias("_total"),
        "seq",
        "name",
        F.when(blank("domain"), "N/A").otherwise(F.col("domain")).alias("domain"),
        "source",
        score_text("score.total_score").alias("score"),
        F.coalesce(F.upper("score.priority"), F.lit("N/A")).alias("priority"),
        F.when(hiring["is_hiring"], hiring["total_open_positions"]).alias("open_positions"),
        F.nullif(names, F.lit("")).alias("technologies"),
    )
    order = [F.col("_total").desc(), F.col("seq").asc()]
    top = lines.orderBy(*order).limit(n)
    numbered = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return numbered.select(
        "rank", "name", "domain", "source", "score", "priority", "open_positions", "technologies"
    )
