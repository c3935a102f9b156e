"""Business rules: named boolean columns evaluated in one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadframe.functions.collections import null_to_empty

Rule = Column | Callable[[], Column]

# --- fixed values: country spellings ----------------------------------------
US_SPELLINGS = ["USA", "US", "United States"]


class RuleSet:
    """Rules in the order they were added, reported as rule_0 … rule_n."""

    def __init__(self, *rules: Rule):
        self._rules: list[Rule] = list(rules)

    def add(self, rule: Rule) -> "RuleSet":
        self._rules.append(rule)
        return self

    def columns(self) -> dict[str, Column]:
        return {
            f"rule_{i}": F.coalesce(r if isinstance(r, Column) else r(), F.lit(False))
            for i, r in enumerate(self._rules)
        }

    def apply(self, df: DataFrame, column: str = "rules") -> DataFrame:
        """Add a map of rule name to result."""
        pairs = [p for n, c in self.columns().items() for p in (F.lit(n), c)]
        results = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,boolean>")
        return df.withColumn(column, results)

    def flags(self, df: DataFrame) -> DataFrame:
        """Add one boolean column per rule."""
        return df.withColumns(self.columns())


def is_high_value_target() -> Column:
    """Uses frameworks, more than five open positions, in the US."""
    e = F.col("enrichment")
    return (
        (F.size(null_to_empty(e["tech_stack"]["frameworks"])) > 0)
        & (e["hiring_intent"]["total_open_positions"] > 5)
        & e["geographic_info"]["country"].isin(US_SPELLINGS)
    )
