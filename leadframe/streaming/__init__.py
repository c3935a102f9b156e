"""The stateless stages on a stream of company records.

Extraction, validation, enrichment by expressions, and scoring keep no state, so
the same functions run on a streaming DataFrame.  De-duplication depends on all
earlier records and stays a batch step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from leadframe.operators.enrich import Enricher, enrich_all
from leadframe.operators.score import min_score, score_companies
from leadframe.operators.validate import valid_rows


def score_stream(
    companies: DataFrame,
    ref_year: int,
    enrichers: list[Enricher] | None = None,
    weights: dict[str, float] | None = None,
    threshold: float = 0.0,
) -> DataFrame:
    """Valid, enriched and scored companies of a stream (append mode, no state)."""
    df = valid_rows(companies, ref_year)
    df = enrich_all(df, enrichers or [])
    return min_score(score_companies(df, weights), threshold)
