"""Lead scoring: four component scores, weighted total, priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadframe import schema as S
from leadframe.functions.text import blank, round2

# --- fixed values: scoring tables -------------------------------------------
DEFAULT_WEIGHTS = {"intent": 0.35, "fit": 0.30, "tech": 0.20, "engagement": 0.15}
SIZE_SCORES = {
    "startup": 70.0, "small": 80.0, "medium": 90.0, "large": 70.0,
    "enterprise": 50.0, "unknown": 40.0,
}
STAGE_SCORES = {
    "seed": 60.0, "series_a": 80.0, "series_b": 90.0, "series_c": 85.0,
    "series_d_plus": 75.0,
}
MODERN_FRAMEWORKS = ["React", "Vue", "Angular", "Svelte", "Next.js"]
MODERN_DATABASES = ["MongoDB", "PostgreSQL", "Redis"]
SOCIAL_POINTS = {"linkedin": 15.0, "twitter": 10.0, "github": 15.0, "crunchbase": 10.0}


def normalize_weights(weights: dict[str, float] | None = None) -> dict[str, float]:
    """All four weights; scaled to a sum of one if off by more than 0.01."""
    weights = dict(weights or DEFAULT_WEIGHTS)
    missing = set(DEFAULT_WEIGHTS) - set(weights)
    if missing:
        raise ValueError(f"weights missing: {sorted(missing)}")
    total = sum(weights.values())
    if abs(total - 1.0) > 0.01:
        weights = {k: v / total for k, v in weights.items()}
    return weights


def _points(condition: Column, points) -> Column:
    points = points if isinstance(points, Column) else F.lit(float(points))
    return F.when(condition, points).otherwise(F.lit(0.0))


def _lookup(key: Column, table: dict[str, float], default: float) -> Column:
    """A constant table of a few entries as one CASE expression."""
    expr = None
    for k, v in table.items():
        expr = (F.when if expr is None else expr.when)(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def _capped(score: Column) -> Column:
    return F.least(score, F.lit(100.0))


def intent_score(enrichment: Column) -> Column:
    h = enrichment["hiring_intent"]

    def ramp(field: str, per_unit: float, cap: float) -> Column:
        n = h[field].cast("double")
        return _points(n > 0, F.least(n * per_unit, F.lit(cap)))

    score = (
        _points(h["is_hiring"], 30)
        + ramp("total_open_positions", 5.0, 30.0)
        + ramp("recent_postings", 10.0, 20.0)
        + ramp("hiring_velocity", 5.0, 20.0)
    )
    return F.when(h.isNull(), F.lit(0.0)).otherwise(_capped(score))


def fit_score(enrichment: Column) -> Column:
    size = _lookup(enrichment["company_size"], SIZE_SCORES, 50.0)
    funding = enrichment["funding_info"]
    stage = _lookup(funding["stage"], STAGE_SCORES, 0.0)
    base = F.when(funding.isNull(), size).otherwise((size + stage) / 2)
    n = enrichment["employee_count"]
    bonus = (
        F.when(n.between(20, 500), F.lit(10.0))
        .when((n != 0) & (n < 20), F.lit(5.0))
        .otherwise(F.lit(0.0))
    )
    return F.when(enrichment.isNull(), F.lit(50.0)).otherwise(_capped(base + bonus))


def _any_contains(items: Column, words: list[str], ignore_case: bool) -> Column:
    def hit(item: Column) -> Column:
        text = F.lower(item) if ignore_case else item
        found = F.lit(False)
        for w in words:
            found = found | text.contains(w.lower() if ignore_case else w)
        return found

    return F.coalesce(F.exists(items, hit), F.lit(False))


def tech_score(enrichment: Column, ignore_case: bool = False) -> Column:
    """Points for technologies.  The name test is case sensitive by default."""
    t = enrichment["tech_stack"]

    def filled(category: str) -> Column:
        return F.coalesce(F.size(t[category]), F.lit(0)) > 0

    any_tech = F.lit(False)
    for category in S.TECH_CATEGORIES:
        any_tech = any_tech | filled(category)
    score = (
        _points(any_tech, 40)
        + _points(_any_contains(t["frameworks"], MODERN_FRAMEWORKS, ignore_case), 20)
        + _points(filled("cloud_providers"), 15)
        + _points(_any_contains(t["databases"], MODERN_DATABASES, ignore_case), 15)
        + _points(filled("analytics"), 10)
    )
    return F.when(t.isNull(), F.lit(0.0)).otherwise(_capped(score))


def engagement_score(
    website: Column, domain: Column, description: Column, enrichment: Column
) -> Column:
    score = _points(~blank(website) | ~blank(domain), 30) + _points(~blank(description), 20)
    social = enrichment["social_profiles"]
    for network, points in SOCIAL_POINTS.items():
        score = score + _points(~blank(social[network]), points)
    return _capped(score)


def alternative_intent_score(enrichment: Column) -> Column:
    """Hiring-only intent: 50 for hiring and up to 50 for recent postings."""
    h = enrichment["hiring_intent"]
    recent = F.least(h["recent_postings"].cast("double") * 10, F.lit(50.0))
    score = _points(h["is_hiring"], 50) + F.coalesce(recent, F.lit(0.0))
    return F.when(h.isNull(), F.lit(0.0)).otherwise(_capped(score))


def priority(total: Column) -> Column:
    return F.when(total >= 70, "high").when(total >= 40, "medium").otherwise("low")


def score_companies(
    df: DataFrame, weights: dict[str, float] | None = None, ignore_case: bool = False
) -> DataFrame:
    """Fill ``score``.  Only projections; see ``rank`` for the ordering.

    The components are their own projection, so each is computed once although
    the total, the priority and the stored parts all use it.
    """
    w = normalize_weights(weights)
    e = F.col("enrichment")
    parts = {
        "intent": intent_score(e),
        "fit": fit_score(e),
        "tech": tech_score(e, ignore_case),
        "engagement": engagement_score(
            F.col("website"), F.col("domain"), F.col("description"), e
        ),
    }
    total = F.lit(0.0)
    for name in parts:
        total = total + F.col(f"_{name}") * F.lit(w[name])
    staged = df.withColumns({f"_{n}": c for n, c in parts.items()}).withColumn(
        "_total", F.least(total, F.lit(100.0))
    )
    score = S.build(
        S.SCORE,
        total_score=round2("_total"),
        priority=priority(F.col("_total")),
        **{f"{name}_score": round2(f"_{name}") for name in parts},
    )
    return staged.withColumn("score", score).drop("_total", *[f"_{n}" for n in parts])


def min_score(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Keep rows whose rounded total reaches the threshold; 0 keeps all rows."""
    if threshold <= 0:
        return df
    return df.filter(F.col("score.total_score") >= threshold)
