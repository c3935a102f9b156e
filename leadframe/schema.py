"""The company record: struct types, allowed values and struct builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: enumerations ---------------------------------------------
COMPANY_SIZES = ["startup", "small", "medium", "large", "enterprise", "unknown"]
FUNDING_STAGES = [
    "bootstrapped", "pre_seed", "seed", "series_a", "series_b", "series_c",
    "series_d_plus", "ipo", "acquired", "unknown",
]
DATA_SOURCES = [
    "product_hunt", "angellist", "crunchbase", "clutch", "job_boards",
    "linkedin", "manual", "api", "other",
]
PRIORITIES = ["low", "medium", "high"]
TECH_CATEGORIES = [
    "languages", "frameworks", "databases", "cloud_providers", "tools",
    "analytics", "marketing",
]

_STRINGS = T.ArrayType(T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


TECH_STACK = _struct(*[(c, _STRINGS) for c in TECH_CATEGORIES])
HIRING_INTENT = _struct(
    ("total_open_positions", T.LongType()),
    ("recent_postings", T.LongType()),
    ("engineering_positions", T.LongType()),
    ("sales_positions", T.LongType()),
    ("marketing_positions", T.LongType()),
    ("hiring_velocity", T.DoubleType()),
    ("is_hiring", T.BooleanType()),
)
FUNDING_INFO = _struct(
    ("stage", T.StringType()),
    ("total_funding", T.DoubleType()),
    ("last_funding_date", T.TimestampNTZType()),
    ("last_funding_amount", T.DoubleType()),
    ("investors", _STRINGS),
    ("valuation", T.DoubleType()),
)
GEOGRAPHIC_INFO = _struct(
    *[(c, T.StringType()) for c in ("country", "region", "city", "timezone", "headquarters")]
)
SOCIAL_PROFILES = _struct(
    *[(c, T.StringType()) for c in ("linkedin", "twitter", "facebook", "github", "crunchbase")]
)
ENRICHMENT = _struct(
    ("tech_stack", TECH_STACK),
    ("hiring_intent", HIRING_INTENT),
    ("funding_info", FUNDING_INFO),
    ("geographic_info", GEOGRAPHIC_INFO),
    ("social_profiles", SOCIAL_PROFILES),
    ("employee_count", T.LongType()),
    ("company_size", T.StringType()),
    ("founded_year", T.LongType()),
    ("industry", T.StringType()),
    ("tags", _STRINGS),
)
SCORE = _struct(
    *[(c, T.DoubleType()) for c in (
        "total_score", "intent_score", "fit_score", "tech_score", "engagement_score")],
    ("priority", T.StringType()),
)
COMPANY = _struct(
    ("seq", T.LongType()),
    ("name", T.StringType()),
    ("domain", T.StringType()),
    ("website", T.StringType()),
    ("description", T.StringType()),
    ("source", T.StringType()),
    ("source_url", T.StringType()),
    ("enrichment", ENRICHMENT),
    ("score", SCORE),
    ("scraped_at", T.TimestampNTZType()),
    ("updated_at", T.TimestampNTZType()),
    ("extra_data", T.MapType(T.StringType(), T.StringType())),
)

# Values a new struct takes where the caller gives none.
_DEFAULTS = {
    "company_size": "unknown",
    "stage": "unknown",
    "total_open_positions": 0,
    "recent_postings": 0,
    "engineering_positions": 0,
    "sales_positions": 0,
    "marketing_positions": 0,
    "hiring_velocity": 0.0,
    "is_hiring": False,
    "source": "other",
}


def build(struct: T.StructType, **given: Column) -> Column:
    """A complete struct column: given fields, else defaults, else null."""
    unknown = set(given) - set(struct.fieldNames())
    if unknown:
        raise ValueError(f"no such field: {sorted(unknown)}")
    return F.struct(*[_field(f, given) for f in struct.fields])


def _field(field: T.StructField, given: dict[str, Column]) -> Column:
    if field.name in given:
        value = given[field.name]
        value = value if isinstance(value, Column) else F.lit(value)
        return value.cast(field.dataType).alias(field.name)
    return F.expr(_default_sql(field))


def _default_sql(field: T.StructField) -> str:
    default = _DEFAULTS.get(field.name)
    if default is not None:
        value = f"'{default}'" if isinstance(default, str) else str(default)
    elif isinstance(field.dataType, T.ArrayType):
        value = "array()"
    elif isinstance(field.dataType, T.MapType):
        value = "map()"
    else:
        value = "NULL"
    return f"CAST({value} AS {field.dataType.simpleString()}) AS {field.name}"


def companies(df: DataFrame, **given: Column) -> DataFrame:
    """Select full company records from ``df``; missing fields get defaults."""
    return df.select(*[_field(f, given) for f in COMPANY.fields])


def ensure_enrichment(c: Column | None = None) -> Column:
    """The enrichment, or an empty one where it is null (not the same thing)."""
    c = F.col("enrichment") if c is None else c
    return F.coalesce(c, build(ENRICHMENT))
