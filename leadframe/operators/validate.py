"""Row constraints of the company record, as one reject-reason array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from leadframe import schema as S
from leadframe.functions.text import blank, strip_space
from leadframe.functions.urls import canonical_url, extract_domain, validate_url

_URL_FIELDS = ["website", "source_url"]
_SOCIAL_FIELDS = ["linkedin", "twitter", "facebook", "github", "crunchbase"]


def _violations(df: DataFrame, ref_year: int) -> dict[str, Column]:
    """Reason name to 'row violates it', for the columns that exist."""
    checks: dict[str, Column] = {}
    have = set(df.columns)
    if "name" in have:
        checks["name"] = F.coalesce(F.length("name"), F.lit(0)) < 1
    for c in _URL_FIELDS:
        if c in have:
            checks[c] = F.col(c).isNotNull() & canonical_url(c).isNull()
    if "source" in have:
        checks["source"] = ~F.coalesce(F.col("source").isin(S.DATA_SOURCES), F.lit(False))
    if "enrichment" in have:
        e = F.col("enrichment")
        year = e["founded_year"]
        checks["founded_year"] = (year < 1800) | (year > ref_year)
        checks["company_size"] = e.isNotNull() & ~F.coalesce(
            e["company_size"].isin(S.COMPANY_SIZES), F.lit(False)
        )
        checks["funding_stage"] = e["funding_info"].isNotNull() & ~F.coalesce(
            e["funding_info"]["stage"].isin(S.FUNDING_STAGES), F.lit(False)
        )
        for f in _SOCIAL_FIELDS:
            link = e["social_profiles"][f]
            checks[f] = link.isNotNull() & canonical_url(link).isNull()
    if "score" in have:
        s = F.col("score")
        for f in ("total_score", "intent_score", "fit_score", "tech_score", "engagement_score"):
            checks[f] = (s[f] < 0) | (s[f] > 100)
        checks["priority"] = s.isNotNull() & ~F.coalesce(
            F.lower(s["priority"]).isin(S.PRIORITIES), F.lit(False)
        )
    return checks


def with_reject_reasons(df: DataFrame, ref_year: int) -> DataFrame:
    """Add ``reject_reasons``; an empty array means the row is valid."""
    reasons = [
        F.when(F.coalesce(bad, F.lit(False)), F.lit(name))
        for name, bad in _violations(df, ref_year).items()
    ]
    return df.withColumn(
        "reject_reasons", F.array_compact(F.array(*reasons)).cast("array<string>")
    )


def valid_rows(df: DataFrame, ref_year: int) -> DataFrame:
    """Rows that meet every constraint, with name and URLs in stored form."""
    kept = with_reject_reasons(df, ref_year).filter(F.size("reject_reasons") == 0)
    stored = {"name": strip_space("name")} if "name" in df.columns else {}
    for c in _URL_FIELDS:
        if c in df.columns:
            stored[c] = canonical_url(c)
    return kept.withColumns(stored).drop("reject_reasons")


def rejected_rows(df: DataFrame, ref_year: int) -> DataFrame:
    return with_reject_reasons(df, ref_year).filter(F.size("reject_reasons") > 0)


def quality_filter(
    df: DataFrame, min_name_length: int = 2, check_urls: bool = True
) -> DataFrame:
    """Minimum name length and, if asked, a valid website where there is one."""
    df = df.filter(F.length("name") >= min_name_length)
    if check_urls:
        df = df.filter(blank("website") | validate_url("website"))
    return df


def country_filter(
    df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """Keep target countries, drop excluded ones; empty lists do not filter."""
    country = F.col("enrichment.geographic_info.country")
    if include:
        df = df.filter(country.isin(include))
    if exclude:
        df = df.filter(~F.coalesce(country.isin(exclude), F.lit(False)))
    return df


def successful_sources(df: DataFrame, source_runs: DataFrame) -> DataFrame:
    """Drop all rows of sources whose run failed."""
    return df.join(source_runs.filter("success").select("source"), "source", "left_semi")


def with_source_config(df: DataFrame, source_config: DataFrame) -> DataFrame:
    """Each source's rows with the settings of that source."""
    return df.join(source_config, "source")


def first_per_key(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """First-seen row per key; rows without a key all stay.

    Only the key's digest and the order are aggregated to find the winners (with map-side
    combine, so a hot key costs one row per task and a long key 32 bytes); the wide rows are
    read once and meet the winners in a join on the unique order column.
    """
    digest = F.unhex(F.sha2(F.col(key).cast("string"), 256))
    winners = (
        df.select(digest.alias("_digest"), order).filter("_digest IS NOT NULL")
        .groupBy("_digest").agg(F.min(order).alias(order))
        .select(order, F.lit(True).alias("_first"))
    )
    found = df.withColumn("_free", F.col(key).isNull()).join(winners, order, "left")
    return found.filter(F.col("_free") | F.col("_first")).drop("_free", "_first")


def cap_per_key(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """First ``n`` rows per key.  Spark limits each group before the shuffle."""
    pos = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_pos", pos).filter(F.col("_pos") <= n).drop("_pos")


def cap_per_site(df: DataFrame, n: int, url: str = "url", order: str = "seq") -> DataFrame:
    """At most ``n`` pages of each host, in order."""
    return cap_per_key(df.withColumn("_host", extract_domain(url)), "_host", order, n).drop("_host")
