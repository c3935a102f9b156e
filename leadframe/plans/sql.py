"""SQL text shared by the reference statements of the registered queries."""

from __future__ import annotations

from leadframe.functions.text import EMAIL_PATTERN, LEGAL_SUFFIXES, PHONE_PATTERN
from leadframe.operators.enrich import CATEGORIES, SIGNATURES

SPACE = r"\s\x0b\pZ\x{85}\x1c-\x1f"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(x: str) -> str:
    collapsed = f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"
    return f"coalesce(trim(regexp_replace({collapsed}, '[^\\pL\\pN_ \\-.,!?()&]', '', 'g')), '')"


def company(x: str) -> str:
    for suffix in LEGAL_SUFFIXES:
        x = f"regexp_replace({x}, '(?i)[{SPACE}]+{suffix}$', '')"
    return clean(x)


def with_protocol(x: str) -> str:
    return (f"(CASE WHEN starts_with({x}, 'http://') OR starts_with({x}, 'https://') "
            f"THEN {x} ELSE 'https://' || {x} END)")


def domain(x: str) -> str:
    host = f"regexp_extract({with_protocol(x)}, '^https?://([^/?#]*)', 1)"
    return f"nullif(regexp_replace({host}, '^www\\.', ''), '')"


def normalize(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '' "
            f"ELSE regexp_replace({with_protocol(x)}, '/+$', '') END)")


def title(html: str) -> str:
    x = f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&amp;", "&")):
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return x


def email(x: str) -> str:
    return f"nullif(regexp_extract({x}, {lit(EMAIL_PATTERN)}, 0), '')"


def phone(x: str) -> str:
    pattern = PHONE_PATTERN.replace(r"\s", SPACE)
    return f"nullif(regexp_extract({x}, {lit(pattern)}, 0), '')"


def digits(x: str) -> str:
    return f"coalesce(try_cast(regexp_replace({x}, '[^0-9]', '', 'g') AS BIGINT), 0)"


def round2(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18,6)), 2) AS DOUBLE)"


def nth(k: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"(CASE {k} % {len(values)} {cases} END)"


def texts(*values: str) -> list[str]:
    return [lit(v) for v in values]


# --- pages ----------------------------------------------------------------------

PAGE_COMPANIES = f"""
page_companies AS (
  SELECT page_id AS seq, {title('html')} AS name, url AS website, {domain('url')} AS domain
  FROM pages
)"""

MARKED = """
marked AS (
  SELECT page_id, url, html || CASE page_id % 5
    WHEN 0 THEN '<script src="/js/jquery.min.js"></script>'
    WHEN 1 THEN '<div data-reactroot>'
    WHEN 2 THEN '<link href="/wp-content/a.css">'
    WHEN 3 THEN '<!-- cdn: x.cloudfront.net, redis -->'
    ELSE '' END AS html
  FROM pages
)"""


def has_tech(name: str, text: str = "t") -> str:
    return f"regexp_matches({text}, {lit('|'.join(SIGNATURES[name]))})"


def tech_title(name: str) -> str:
    return name.replace("-", " ").title()


def tech_list(text: str = "t") -> str:
    """Comma-joined technology names in signature order."""
    cases = ", ".join(f"CASE WHEN {has_tech(n, text)} THEN {lit(n)} END" for n in SIGNATURES)
    return f"concat_ws(',', {cases})"


def tech_category(category: str, text: str = "t") -> str:
    names = sorted(CATEGORIES[category], key=tech_title)
    cases = ", ".join(
        f"CASE WHEN {has_tech(n, text)} THEN {lit(tech_title(n))} END" for n in names
    )
    return f"concat_ws(', ', {cases})" if names else "''"


# --- leads ------------------------------------------------------------------------

_STAGES = texts("bootstrapped", "pre_seed", "seed", "series_a", "series_b", "series_c",
                "series_d_plus", "ipo", "acquired", "unknown")
_SOURCES = texts("product_hunt", "angellist", "crunchbase", "clutch", "job_boards",
                 "linkedin", "manual", "api", "other")

LEADS = f"""
per_customer AS (
  SELECT o_custkey, count(*) AS n,
    count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY) AS recent
  FROM orders GROUP BY o_custkey
),
base AS (
  SELECT c.*, c_custkey AS k, coalesce(n, 0) AS n, coalesce(recent, 0) AS recent
  FROM customer c LEFT JOIN per_customer ON c_custkey = o_custkey
),
leads AS (
  SELECT k AS seq, c_name AS name, c_mktsegment AS segment,
    CASE WHEN k % 3 <> 0 THEN 'c' || k || '.example.com' END AS domain,
    CASE WHEN k % 2 <> 0 THEN 'https://c' || k || '.example.com/' END AS website,
    CASE WHEN k % 5 <> 0 THEN 'Leader in ' || lower(c_mktsegment) END AS description,
    {nth('k', _SOURCES)} AS source,
    k % 13 <> 0 AS has_enr,
    k % 13 <> 0 AND k % 11 <> 0 AS has_tech,
    k % 13 <> 0 AND k % 7 <> 0 AS has_hiring,
    k % 13 <> 0 AND k % 4 <> 0 AS has_funding,
    k % 13 <> 0 AND k % 9 <> 0 AS has_geo,
    n * 3 AS open, recent, {round2('n * 3 / 12.0::DOUBLE')} AS velocity, n > 10 AS hiring,
    {nth('k', texts('', 'React', 'Django'))} AS framework,
    {nth('k', texts('', 'PostgreSQL', 'Postgresql', 'Redis'))} AS db,
    CASE WHEN k % 5 = 0 THEN 'Aws' ELSE '' END AS cloud,
    CASE WHEN k % 6 = 0 THEN 'Hotjar' ELSE '' END AS analytics,
    {nth('k', _STAGES)} AS stage, abs(c_acctbal) * 1000 AS total_funding,
    {nth('k', texts('USA', 'US', 'United States', 'UK', 'United Kingdom', 'Germany', 'France', 'India'))}
      AS country,
    'City ' || c_nationkey AS city,
    CAST(floor(c_acctbal / 10) AS BIGINT) AS employees,
    {nth('k', texts('startup', 'small', 'medium', 'large', 'enterprise', 'unknown'))} AS size,
    1790 + k % 300 AS founded, lower(c_mktsegment) AS industry,
    k % 2 <> 0 AS linkedin, k % 3 <> 0 AS twitter, k % 5 <> 0 AS github, k % 7 <> 0 AS crunchbase
  FROM base
)"""


def score_ctes(source: str = "leads", weights=(0.35, 0.30, 0.20, 0.15)) -> str:
    w = [f"{x!r}::DOUBLE" for x in weights]
    return f"""
parts AS (
  SELECT *,
    CASE WHEN NOT has_hiring THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE,
      (CASE WHEN hiring THEN 30.0::DOUBLE ELSE 0 END)
      + (CASE WHEN open > 0 THEN least(open * 5.0::DOUBLE, 30.0::DOUBLE) ELSE 0 END)
      + (CASE WHEN recent > 0 THEN least(recent * 10.0::DOUBLE, 20.0::DOUBLE) ELSE 0 END)
      + (CASE WHEN velocity > 0 THEN least(velocity * 5.0::DOUBLE, 20.0::DOUBLE) ELSE 0 END)) END
      AS intent,
    CASE WHEN NOT has_enr THEN 50.0::DOUBLE ELSE least(100.0::DOUBLE,
      (CASE WHEN has_funding THEN (size_points + stage_points) / 2 ELSE size_points END)
      + (CASE WHEN employees BETWEEN 20 AND 500 THEN 10.0::DOUBLE
              WHEN employees <> 0 AND employees < 20 THEN 5.0::DOUBLE ELSE 0 END)) END AS fit,
    CASE WHEN NOT has_tech THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE,
      (CASE WHEN framework <> '' OR db <> '' OR cloud <> '' OR analytics <> ''
            THEN 40.0::DOUBLE ELSE 0 END)
      + (CASE WHEN framework = 'React' THEN 20.0::DOUBLE ELSE 0 END)
      + (CASE WHEN cloud <> '' THEN 15.0::DOUBLE ELSE 0 END)
      + (CASE WHEN db IN ('PostgreSQL', 'Redis') THEN 15.0::DOUBLE ELSE 0 END)
      + (CASE WHEN analytics <> '' THEN 10.0::DOUBLE ELSE 0 END)) END AS tech,
    least(100.0::DOUBLE,
      (CASE WHEN website IS NOT NULL OR domain IS NOT NULL THEN 30.0::DOUBLE ELSE 0 END)
      + (CASE WHEN description IS NOT NULL THEN 20.0::DOUBLE ELSE 0 END)
      + (CASE WHEN has_enr AND linkedin THEN 15.0::DOUBLE ELSE 0 END)
      + (CASE WHEN has_enr AND twitter THEN 10.0::DOUBLE ELSE 0 END)
      + (CASE WHEN has_enr AND github THEN 15.0::DOUBLE ELSE 0 END)
      + (CASE WHEN has_enr AND crunchbase THEN 10.0::DOUBLE ELSE 0 END)) AS engagement
  FROM (SELECT *,
    CASE size WHEN 'startup' THEN 70.0::DOUBLE WHEN 'small' THEN 80 WHEN 'medium' THEN 90
      WHEN 'large' THEN 70 WHEN 'enterprise' THEN 50 ELSE 40 END AS size_points,
    CASE stage WHEN 'seed' THEN 60.0::DOUBLE WHEN 'series_a' THEN 80 WHEN 'series_b' THEN 90
      WHEN 'series_c' THEN 85 WHEN 'series_d_plus' THEN 75 ELSE 0 END AS stage_points
    FROM {source})
),
totals AS (
  SELECT *, least(intent * {w[0]} + fit * {w[1]} + tech * {w[2]} + engagement * {w[3]},
                  100.0::DOUBLE) AS raw_total FROM parts
),
scored AS (
  SELECT *, {round2('raw_total')} AS total_score, {round2('intent')} AS intent_score,
    {round2('fit')} AS fit_score, {round2('tech')} AS tech_score,
    {round2('engagement')} AS engagement_score,
    CASE WHEN raw_total >= 70 THEN 'high' WHEN raw_total >= 40 THEN 'medium' ELSE 'low' END
      AS priority
  FROM totals
)"""


TECHNOLOGIES = """concat_ws(', ', nullif(framework, ''), nullif(db, ''), nullif(cloud, ''),
    nullif(analytics, ''))"""


def flat_row() -> str:
    e = lambda x: f"CASE WHEN has_enr THEN {x} END"
    return f"""name AS company_name, domain, website, description, source,
  CAST(NULL AS VARCHAR) AS source_url, '2024-01-31T12:00:00' AS scraped_at,
  {e('employees')} AS employee_count, {e('size')} AS company_size, {e('founded')} AS founded_year,
  {e('industry')} AS industry,
  CASE WHEN has_geo THEN country END AS country, CASE WHEN has_geo THEN city END AS city,
  CASE WHEN has_funding THEN stage END AS funding_stage,
  CASE WHEN has_funding THEN total_funding END AS total_funding,
  CASE WHEN has_hiring THEN open END AS open_positions,
  CASE WHEN has_hiring THEN hiring END AS is_hiring,
  CASE WHEN has_tech THEN {TECHNOLOGIES} END AS technologies,
  total_score, priority"""
