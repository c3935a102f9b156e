"""The whole run: union, de-duplicate, enrich, score, filter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from leadframe.operators import dedup
from leadframe.operators.aggregate import StageCounts
from leadframe.operators.enrich import Enricher, enrich_all
from leadframe.operators.score import min_score, score_companies
from leadframe.operators.union import union_sources
from leadframe.operators.validate import (
    country_filter,
    quality_filter,
    successful_sources,
    valid_rows,
)
from leadframe.session import cut_lineage


def _once(df: DataFrame) -> DataFrame:
    """The rows written once, as name matching reads them twice; a column without a type cannot be written."""
    return df if "void" in df.schema.simpleString() else cut_lineage(df)


@dataclass
class RunOptions:
    """Every stage can be switched; defaults are the usual run."""

    deduplicate: bool = True
    name_threshold: float | None = 0.85  # None: domain matching only
    enrich: bool = True
    score: bool = True
    weights: dict[str, float] | None = None
    min_score: float = 0.0
    ref_year: int | None = None  # check row constraints against this year
    min_name_length: int | None = None
    check_urls: bool = False
    include_countries: list[str] = field(default_factory=list)
    exclude_countries: list[str] = field(default_factory=list)


def run_leads(
    sources: list[DataFrame],
    enrichers: list[Enricher] | None = None,
    source_runs: DataFrame | None = None,
    options: RunOptions | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    counts: StageCounts | None = None,
) -> DataFrame:
    """Company sources in, scored companies out (unsorted; see ``rank``).

    ``counts`` has the rows after each stage once a sink has written the result.
    """
    o = options or RunOptions()
    seen = (lambda d, stage: d) if counts is None else counts.watch
    df = seen(union_sources(sources), "collected")
    # filters that need no score come first
    if source_runs is not None:
        df = successful_sources(df, source_runs)
    if o.ref_year is not None:
        df = valid_rows(df, o.ref_year)
    if o.min_name_length is not None or o.check_urls:
        df = quality_filter(df, o.min_name_length or 1, o.check_urls)
    if o.deduplicate:
        df = (
            dedup.first_per_domain(df)
            if o.name_threshold is None
            else dedup.deduplicate(_once(df), o.name_threshold)
        )
    df = seen(df, "distinct")
    if o.enrich and enrichers:
        df = enrich_all(df, enrichers)
    df = country_filter(df, o.include_countries, o.exclude_countries)
    if o.score:
        df = (scorer or (lambda d: score_companies(d, o.weights)))(df)
        df = min_score(df, o.min_score)
    return seen(df, "kept")
