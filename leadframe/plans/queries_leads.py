"""Registered queries: scoring, rules, summaries, validity, enrichment, ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe import schema as S
from leadframe.operators import aggregate as A
from leadframe.operators import enrich as E
from leadframe.operators import flatten as P
from leadframe.operators import rank as R
from leadframe.operators import robots as B
from leadframe.operators import score as C
from leadframe.operators import validate as V
from leadframe.operators.rules import RuleSet, is_high_value_target
from leadframe.operators.union import union_sources
from leadframe.plans import inputs as I
from leadframe.plans import sql as Q
from leadframe.session import cut_lineage, work_dir
from leadframe.sinks import workbook_sets, write_leads, write_run_metrics

# --- scoring ----------------------------------------------------------------------


def _scored(spark, d, **kw) -> DataFrame:
    return C.score_companies(I.leads(spark, d), **kw)


def _score_part(name):
    def query(spark, d):
        return _scored(spark, d).select("seq", F.col(f"score.{name}").alias(name))

    return query


def c_total_priority(spark, d):
    return _scored(spark, d).select("seq", "score.total_score", "score.priority")


def c_custom_weights(spark, d):
    weights = {"intent": 2.0, "fit": 1.0, "tech": 0.5, "engagement": 0.5}
    return _scored(spark, d, weights=weights).select("seq", "score.total_score", "score.priority")


def c_ignore_case(spark, d):
    return _scored(spark, d, ignore_case=True).select("seq", "score.tech_score")


def c_intent_alt(spark, d):
    return I.leads(spark, d).select(
        "seq", C.alternative_intent_score(F.col("enrichment")).alias("intent_alt")
    )


def r_rules(spark, d):
    e = F.col("enrichment")
    rules = RuleSet(is_high_value_target).add(e["hiring_intent"]["is_hiring"]).add(
        e["employee_count"] > 500
    )
    df = rules.apply(I.leads(spark, d))
    return df.select("seq", *[F.col("rules")[f"rule_{i}"].alias(f"rule_{i}") for i in range(3)])


def r_flags(spark, d):
    return RuleSet(is_high_value_target).flags(I.leads(spark, d)).groupBy("rule_0").agg(
        F.count(F.lit(1)).alias("companies")
    )


# --- summaries --------------------------------------------------------------------


def a_summary(spark, d):
    return A.summary(_scored(spark, d))


def a_priority(spark, d):
    return A.count_by_priority(_scored(spark, d))


def a_source_runs(spark, d):
    docs = I.table(spark, d, "documents")
    rows = S.companies(
        docs, seq=F.col("doc_id"), name=F.col("text"), source=F.col("source"),
        enrichment=F.when(F.col("lang") == "en", S.build(S.ENRICHMENT)),
    )
    out = A.source_metrics(rows, I.source_runs(spark, d))
    return out.select(
        "source", "success", "total_scraped", "total_enriched", "total_scored", "execution_time",
        F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"),
    )


def _attempts(spark, d):
    return I.table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("bad "), (F.col("user_id") % 3).cast("string")))
        .alias("error"),
        F.when(F.col("event_type") == "view", F.lit("slow")).alias("warning"),
        F.floor("value").alias("seconds"),
    )


def a_run_messages(spark, d):
    """Errors and warnings of each source with the attempts that had them."""
    return A.source_run_messages(_attempts(spark, d))


def a_run_records(spark, d):
    out = A.source_run_records(_attempts(spark, d))
    return out.select(
        "source", "success", F.array_join("errors", "|").alias("errors"),
        F.array_join("warnings", "|").alias("warnings"), "execution_time",
    )


def a_technologies(spark, d):
    return A.distinct_technologies(I.leads(spark, d))


def a_stage_counts(spark, d):
    df = _scored(spark, d)
    return A.stage_counts(
        read=df, keyed=V.first_per_key(df, "domain"), high=P.by_priority(df),
    )


def a_stage_counts_once(spark, d):
    """The same counts and those of rows per sink, gathered while the leads are written."""
    counts = A.StageCounts()
    scored = counts.watch(_scored(spark, d), "read")
    high = F.col("score.priority") == "high"
    watched = counts.watch(scored, "high", high)
    cut_lineage(counts.watch(watched.filter(high), "written"))
    return counts.table(spark)


def n_hiring_rollup(spark, d):
    return A.hiring_rollup(I.postings(spark, d), I.POSTING_REFERENCE)


# --- projections and filters --------------------------------------------------------


def p_flatten(spark, d):
    return P.flatten_companies(_scored(spark, d))


def p_nested(spark, d):
    """The nested record as JSON text, one line per company."""
    df = P.nested_companies(_scored(spark, d))
    return df.select("seq", F.to_json(F.struct(*df.columns)).alias("record"))


def p_technologies(spark, d):
    names = P.all_technologies(F.col("enrichment.tech_stack"))
    return I.leads(spark, d).select("seq", F.array_join(names, ", ").alias("technologies"))


def _flawed(spark, d):
    k = F.col("seq")
    df = I.leads(spark, d)
    return df.withColumns({
        "name": F.when(k % 17 == 0, F.lit("")).when(k % 19 == 0, F.concat(F.lit(" "), "name", F.lit(" ")))
        .otherwise(F.col("name")),
        "website": F.when(k % 23 == 0, F.lit("/relative")).otherwise(F.col("website")),
        "source": F.when(k % 29 == 0, F.lit("nowhere")).otherwise(F.col("source")),
    })


def p_valid(spark, d):
    return V.valid_rows(_flawed(spark, d), 2024).select("seq", "name", "website")


def p_reject(spark, d):
    return V.rejected_rows(_flawed(spark, d), 2024).select(
        "seq", F.array_join("reject_reasons", ",").alias("reasons")
    )


def p_country(spark, d):
    df = V.country_filter(
        I.leads(spark, d), include=["USA", "UK", "Germany"], exclude=["Germany"]
    )
    return df.select("seq", F.col("enrichment.geographic_info.country").alias("country"))


def p_quality(spark, d):
    return V.quality_filter(_flawed(spark, d), min_name_length=2).select("seq", "website")


def p_min_score(spark, d):
    return C.min_score(_scored(spark, d), 45.0).select("seq", "score.total_score")


def p_truth(spark, d):
    return I.leads(spark, d).select(
        "seq", A.is_hiring().alias("hiring"), A.has_tech().alias("tech"),
        A.has_funding().alias("funding"),
    )


def p_failed_source(spark, d):
    return V.successful_sources(
        I.table(spark, d, "documents").select("doc_id", "source"), I.source_runs(spark, d)
    )


def p_source_settings(spark, d):
    """Every document with the settings of its source and whether it keeps to them."""
    docs = I.table(spark, d, "documents").select("doc_id", "source", "n_chars")
    config = docs.select("source").distinct().select(
        "source", (F.length("source") * 100).alias("max_chars")
    )
    return V.with_source_config(docs, config).select(
        "doc_id", "max_chars", (F.col("n_chars") <= F.col("max_chars")).alias("within")
    )


def p_robots(spark, d):
    return B.allowed_urls(
        I.table(spark, d, "pages").select("page_id", "url"), I.robots_texts(spark, d)
    ).select("page_id", "allowed")


def p_robots_agent(spark, d):
    return B.allowed_urls(
        I.table(spark, d, "pages").select("page_id", "url"), I.robots_texts(spark, d),
        user_agent="BadBot/2.0",
    ).select("page_id", "allowed")


# --- ranking and caps ---------------------------------------------------------------


def o_rank(spark, d):
    return R.rank(_scored(spark, d)).select("seq", "score.total_score")


def o_top5(spark, d):
    return R.top_report(_scored(spark, d))


def w_cap(spark, d):
    orders = I.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return V.cap_per_key(orders, "o_custkey", "o_orderkey", 3)


def w_site_cap(spark, d):
    pages = I.table(spark, d, "pages").select(F.col("page_id").alias("seq"), "url")
    return V.cap_per_site(pages, 2).select("seq")


def u_union(spark, d):
    docs = I.table(spark, d, "documents").select(
        F.col("doc_id").alias("seq"), F.col("lang").alias("name"), "source"
    )
    pages = I.table(spark, d, "pages").select(
        F.col("page_id").alias("seq"), F.lit("page").alias("name"), "url"
    )
    return union_sources([docs, pages])


def k_workbook_sets(spark, d):
    """Rows of the three workbook sheets."""
    sheets = workbook_sets(_scored(spark, d))
    main, high = (
        sheets[s].select(F.lit(s).alias("sheet"), F.col("company_name").alias("item"),
                         F.col("total_score").alias("value"))
        for s in ("companies", "high_priority")
    )
    summary = sheets["summary"].select(
        F.lit("summary").alias("sheet"), F.col("Metric").alias("item"),
        F.col("Count").cast("double").alias("value"),
    )
    return main.unionByName(high).unionByName(summary)


def _exported(spark, d, fmt):
    """All scored companies written in one format, and the path."""
    path = write_leads(_scored(spark, d), fmt, f"{work_dir(spark)}/{uuid.uuid4().hex}", "leads")
    return path, P.flatten_companies(_scored(spark, d)).schema


def k_csv(spark, d):
    """The CSV export, read back."""
    path, schema = _exported(spark, d, "csv")
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def k_json(spark, d):
    """The nested export, read back and flattened."""
    path, _ = _exported(spark, d, "json")
    schema = P.nested_companies(_scored(spark, d)).schema
    return P.flatten_companies(spark.read.schema(schema).json(path))


def k_parquet(spark, d):
    """The Parquet export, read back."""
    return spark.read.parquet(_exported(spark, d, "parquet")[0])


def k_run_metrics(spark, d):
    """Run records of the sources with the time of the run, written and read back."""
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    write_run_metrics(a_source_runs(spark, d), path, "2024-01-31 12:00:00")
    at = F.date_format("written_at", "yyyy-MM-dd HH:mm:ss")
    return spark.read.parquet(path).withColumn("written_at", at)


# --- enrichment ----------------------------------------------------------------------


def n_tech_detect(spark, d):
    df = E.detect_technologies(I.marked_pages(spark, d))
    return df.select("page_id", F.array_join("technologies", ",").alias("technologies"))


def n_tech_page_headers(spark, d):
    """Signatures found in the text of a page or in its response headers."""
    pages = I.marked_pages(spark, d).withColumn(
        "headers",
        F.when(F.col("page_id") % 2 == 0, F.lit("X-Powered-By: PHP, Express"))
        .otherwise(F.lit("Server: cloudflare")),
    )
    df = E.detect_technologies(pages, headers="headers")
    return df.select("page_id", F.array_join("technologies", ",").alias("technologies"))


def n_tech_many(spark, d):
    """Thousands of signatures, by one reading of each page."""
    more = {f"tool{k}": [rf"tool\.{k}\.js", f"data-tool{k}=[a-z]+"] for k in range(3000)}
    k = F.col("page_id")
    mark = F.when(k % 2 == 0, F.format_string("<script src='tool.%d.js'>", k % 3000)).otherwise(
        F.format_string("<p data-tool%d=x><p data-tool%d=1>", k % 3000, (k + 1) % 3000))
    pages = I.marked_pages(spark, d).withColumn("html", F.concat("html", mark))
    df = E.detect_technologies(pages, signatures=E.SIGNATURES | more)
    return df.select("page_id", F.array_join("technologies", ",").alias("technologies"))


def n_tech_category(spark, d):
    df = E.detect_technologies(I.marked_pages(spark, d))
    stack = df.select("page_id", E.categorize(F.col("technologies")).alias("t"))
    return stack.select(
        "page_id", *[F.array_join(f"t.{c}", ", ").alias(c) for c in S.TECH_CATEGORIES]
    )


def _sites(spark, d):
    p = I.page_companies(spark, d)
    k = F.col("seq")
    return S.companies(
        p, seq=k, name=F.col("name"),
        website=F.when(k % 3 != 0, F.col("website")),
        domain=F.when(k % 4 != 0, F.col("domain")),
        source=F.col("source"),
        enrichment=F.when(k % 2 == 0, S.build(S.ENRICHMENT, industry="web")),
    )


def n_site_stack(spark, d):
    """Tech stacks of sites by the pages of their address; sites without one keep their enrichment."""
    df = E.tech_enricher(I.marked_pages(spark, d))(_sites(spark, d))
    e = F.col("enrichment")
    return df.select(
        "seq", e.isNotNull().alias("has_enrichment"), e["tech_stack"].isNotNull().alias("has_tech"),
        e["industry"].alias("industry"),
        F.array_join(P.all_technologies(e["tech_stack"]), ", ").alias("technologies"),
    )


def _flaky_industry(lead: dict) -> dict:
    """An enricher of a user that cannot take every row."""
    number = lead["seq"]
    if number % 7 == 3:
        raise ValueError(f"no answer for {number}")
    return {"industry": f"sector {number % 5}"}


def _flaky_size(lead: dict) -> dict:
    """Fails on rows without an enrichment, and on those whose result has no valid form."""
    positions = lead["enrichment"]["hiring_intent"]["total_open_positions"]
    return {"employee_count": "many" if positions > 40 else positions}


def n_isolated(spark, d):
    """A chain in which single rows of two enrichers fail: they stay as they were, with the error."""
    chain = [
        E.size_enricher, E.row_enricher("industry", _flaky_industry), E.region_enricher,
        E.row_enricher("positions", _flaky_size),
    ]
    df = E.enrich_all(I.leads(spark, d), chain)
    e, errors = F.col("enrichment"), F.col("enrich_errors")
    return df.select(
        "seq", e["industry"].alias("industry"), e["employee_count"].alias("employee_count"),
        e["company_size"].alias("company_size"),
        F.array_join(F.transform(errors, lambda x: x["enricher"]), ",").alias("failed"),
        F.array_join(F.transform(errors, lambda x: F.element_at(F.split(x["error"], ":"), 1)), ",").alias("errors"),
    )


def n_size(spark, d):
    df = E.size_enricher(I.leads(spark, d))
    return df.select("seq", F.col("enrichment.company_size").alias("company_size"))


def n_region(spark, d):
    df = E.region_enricher(I.leads(spark, d))
    return df.select("seq", F.col("enrichment.geographic_info.region").alias("region"))


def n_ip(spark, d):
    df = E.address_enricher(I.dns(spark, d))(_sites(spark, d))
    return df.select(
        "seq", F.col("extra_data")["ip_address"].alias("ip_address"),
        F.col("enrichment").isNotNull().alias("has_enrichment"),
        F.col("enrichment.geographic_info").isNotNull().alias("has_geo"),
    )


def n_funding(spark, d):
    df = E.funding_enricher(I.leads(spark, d))
    return df.select(
        "seq", F.col("enrichment").isNotNull().alias("has_enrichment"),
        C.fit_score(F.col("enrichment")).alias("fit"),
    )


def n_hiring(spark, d):
    """Hiring intent from postings where none is known."""
    rollup = A.hiring_rollup(I.postings(spark, d), I.POSTING_REFERENCE)
    found = A.hiring_struct(rollup).select(
        F.concat(F.lit("c"), F.col("company").cast("string"), F.lit(".example.com")).alias("domain"),
        "hiring_intent",
    )
    df = E.hiring_enricher(found)(I.leads(spark, d))
    h = F.col("enrichment.hiring_intent")
    return df.select("seq", h["total_open_positions"].alias("open"), h["is_hiring"].alias("hiring"))


def n_chain(spark, d):
    """Size, region and funding enrichers in order, then the score."""
    df = E.enrich_all(
        I.leads(spark, d), [E.size_enricher, E.region_enricher, E.funding_enricher]
    )
    return C.score_companies(df).select(
        "seq", "enrichment.company_size", F.col("enrichment.geographic_info.region").alias("region"),
        "score.fit_score",
    )


QUERIES = {f"c_{p}": _score_part(f"{p}_score") for p in ("intent", "fit", "tech", "engagement")}
QUERIES |= {f.__name__: f for f in (
    c_total_priority, c_custom_weights, c_ignore_case, c_intent_alt, r_rules, r_flags,
    a_summary, a_priority, a_source_runs, a_run_records, a_run_messages, a_technologies, a_stage_counts, a_stage_counts_once,
    n_hiring_rollup, p_flatten, p_nested, p_technologies, p_valid, p_reject, p_country, p_quality,
    p_min_score, p_truth, p_failed_source, p_source_settings, p_robots, p_robots_agent,
    o_rank, o_top5, w_cap, w_site_cap, u_union, k_workbook_sets, k_csv, k_json, k_parquet,
    k_run_metrics,
    n_tech_detect, n_tech_many, n_tech_page_headers, n_tech_category, n_site_stack, n_isolated, n_size, n_region, n_ip,
    n_funding, n_hiring, n_chain,
)}

# --- SQL -----------------------------------------------------------------------------

_SCORED = f"WITH {Q.LEADS}, {Q.score_ctes()}"
_LEADS = f"WITH {Q.LEADS}"
_FLAWED = f"""{_LEADS}, flawed AS (SELECT * REPLACE (
    CASE WHEN seq % 17 = 0 THEN '' WHEN seq % 19 = 0 THEN ' ' || name || ' ' ELSE name END AS name,
    CASE WHEN seq % 23 = 0 THEN '/relative' ELSE website END AS website,
    CASE WHEN seq % 29 = 0 THEN 'nowhere' ELSE source END AS source) FROM leads)"""
_BAD_YEAR = "(has_enr AND (founded < 1800 OR founded > 2024))"
_IS_TARGET = """(has_tech AND framework <> '' AND has_hiring AND open > 5 AND has_geo
    AND country IN ('USA', 'US', 'United States'))"""
_SUMMARY_ROWS = """
  SELECT 'Total Companies' AS "Metric", count(*) AS "Count" FROM scored
  UNION ALL SELECT 'High Priority', count(*) FILTER (WHERE priority = 'high') FROM scored
  UNION ALL SELECT 'Medium Priority', count(*) FILTER (WHERE priority = 'medium') FROM scored
  UNION ALL SELECT 'Low Priority', count(*) FILTER (WHERE priority = 'low') FROM scored
  UNION ALL SELECT 'Currently Hiring', count(*) FILTER (WHERE has_hiring AND hiring) FROM scored
  UNION ALL SELECT 'With Tech Stack Data', count(*) FILTER (WHERE has_tech) FROM scored
  UNION ALL SELECT 'With Funding Data', count(*) FILTER (WHERE has_funding) FROM scored"""
_NUMBER = "CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER)"
_POSTINGS = """(SELECT user_id AS company, ts AS posted_at, CASE event_type WHEN 'signup' THEN 'engineering'
    WHEN 'purchase' THEN 'sales' WHEN 'click' THEN 'marketing' ELSE 'other' END AS dept
    FROM events WHERE ts <= TIMESTAMP '2024-01-31')"""
_ROLLUP = f"""SELECT company, count(*) AS total_open_positions,
    count(*) FILTER (WHERE posted_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY) AS recent_postings,
    count(*) FILTER (WHERE dept = 'engineering') AS engineering_positions,
    count(*) FILTER (WHERE dept = 'sales') AS sales_positions,
    count(*) FILTER (WHERE dept = 'marketing') AS marketing_positions,
    {Q.round2("count(*) * 30.0::DOUBLE / greatest(date_diff('day', min(posted_at), TIMESTAMP '2024-01-31'), 1)")}
      AS hiring_velocity, count(*) > 0 AS is_hiring
    FROM {_POSTINGS} GROUP BY company"""
_HOST = Q.domain("url")
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1)"
_MARKED = f"WITH {Q.MARKED}, m AS (SELECT page_id, url, lower(html) AS t FROM marked)"
_CATEGORIES = ["languages", "frameworks", "databases", "cloud_providers", "tools", "analytics",
               "marketing"]
_ALL_TECH = "concat_ws(', ', " + ", ".join(
    f"nullif({Q.tech_category(c)}, '')" for c in _CATEGORIES) + ")"
_SITES = f"""{Q.PAGE_COMPANIES}, sites AS (SELECT seq,
    CASE WHEN seq % 3 <> 0 THEN website END AS website,
    CASE WHEN seq % 4 <> 0 THEN domain END AS domain, seq % 2 = 0 AS has_enr FROM page_companies)"""
_WEIGHTS = [2.0 / 4.0, 1.0 / 4.0, 0.5 / 4.0, 0.5 / 4.0]
_SIZED = """CASE WHEN NOT has_enr THEN 'unknown' WHEN size <> 'unknown' THEN size
    WHEN NOT has_hiring OR open = 0 THEN 'unknown' WHEN open > 50 THEN 'large'
    WHEN open > 10 THEN 'medium' ELSE 'small' END"""
_REGION = """CASE WHEN NOT has_geo THEN NULL WHEN country IN ('USA', 'United States', 'US') THEN 'North America'
    WHEN country IN ('UK', 'United Kingdom', 'Germany', 'France') THEN 'Europe' END"""

ORACLES = {
    f"c_{p}": f"{_SCORED} SELECT seq, {p}_score FROM scored"
    for p in ("intent", "fit", "tech", "engagement")
}
ORACLES |= {
    "c_total_priority": f"{_SCORED} SELECT seq, total_score, priority FROM scored",
    "c_custom_weights": f"""WITH {Q.LEADS}, {Q.score_ctes(weights=_WEIGHTS)}
        SELECT seq, total_score, priority FROM scored""",
    "c_ignore_case": f"""{_SCORED} SELECT seq, least(100.0::DOUBLE, tech_score +
        CASE WHEN has_tech AND db = 'Postgresql' THEN 15.0::DOUBLE ELSE 0 END) AS tech_score FROM scored""",
    "c_intent_alt": f"""{_LEADS} SELECT seq, CASE WHEN NOT has_hiring THEN 0.0::DOUBLE ELSE
        least(100.0::DOUBLE, CASE WHEN hiring THEN 50.0::DOUBLE ELSE 0 END
        + least(recent * 10.0::DOUBLE, 50.0::DOUBLE)) END AS intent_alt FROM leads""",
    "r_rules": f"""{_LEADS} SELECT seq, {_IS_TARGET} AS rule_0, has_hiring AND hiring AS rule_1,
        has_enr AND employees > 500 AS rule_2 FROM leads""",
    "r_flags": f"""{_LEADS} SELECT {_IS_TARGET} AS rule_0, count(*) AS companies FROM leads GROUP BY 1""",
    "a_summary": f"{_SCORED} {_SUMMARY_ROWS}",
    "a_priority": f"{_SCORED} SELECT priority, count(*) AS companies FROM scored GROUP BY priority",
    "a_source_runs": f"""SELECT source, {_NUMBER} % 3 <> 0 AS success, count(*) AS total_scraped,
        count(*) FILTER (WHERE lang = 'en') AS total_enriched, 0::BIGINT AS total_scored,
        {_NUMBER} * 0.5::DOUBLE AS execution_time,
        CASE WHEN {_NUMBER} % 3 = 0 THEN 'page could not be read' ELSE '' END AS errors, '' AS warnings
        FROM documents GROUP BY source""",
    "a_run_records": """SELECT 'u' || user_id AS source,
        bool_and(event_type <> 'error') AS success,
        coalesce(max(CASE WHEN event_type = 'error' THEN 'bad ' || (user_id % 3) END), '') AS errors,
        coalesce(max(CASE WHEN event_type = 'view' THEN 'slow' END), '') AS warnings,
        CAST(sum(floor(value)) AS BIGINT) AS execution_time FROM events GROUP BY user_id""",
    "a_run_messages": """SELECT 'u' || user_id AS source, CASE event_type WHEN 'error' THEN 'error' ELSE 'warning' END
        AS kind, CASE event_type WHEN 'error' THEN 'bad ' || (user_id % 3) ELSE 'slow' END AS message,
        count(*) AS attempts FROM events WHERE event_type IN ('error', 'view') GROUP BY ALL""",
    "a_technologies": f"""{_LEADS}, t AS (
        SELECT framework AS technology FROM leads WHERE has_tech UNION ALL SELECT db FROM leads WHERE has_tech
        UNION ALL SELECT cloud FROM leads WHERE has_tech UNION ALL SELECT analytics FROM leads WHERE has_tech)
        SELECT technology, count(*) AS companies FROM t WHERE technology <> '' GROUP BY technology""",
    "a_stage_counts": f"""{_SCORED} SELECT 'read' AS stage, count(*) AS rows FROM scored
        UNION ALL SELECT 'keyed', count(DISTINCT domain) + count(*) FILTER (WHERE domain IS NULL) FROM scored
        UNION ALL SELECT 'high', count(*) FILTER (WHERE priority = 'high') FROM scored""",
    "a_stage_counts_once": f"""{_SCORED} SELECT 'read' AS stage, count(*) AS rows FROM scored
        UNION ALL SELECT 'high', count(*) FILTER (WHERE priority = 'high') FROM scored
        UNION ALL SELECT 'written', count(*) FILTER (WHERE priority = 'high') FROM scored""",
    "n_hiring_rollup": _ROLLUP,
    "p_flatten": f"{_SCORED} SELECT {Q.flat_row()} FROM scored",
    "p_technologies": f"""{_LEADS} SELECT seq, CASE WHEN has_tech THEN {Q.TECHNOLOGIES} ELSE '' END
        AS technologies FROM leads""",
    "p_valid": f"""{_FLAWED} SELECT seq, trim(name) AS name, website FROM flawed
        WHERE name <> '' AND coalesce(website, '') <> '/relative' AND source <> 'nowhere'
        AND NOT {_BAD_YEAR}""",
    "p_reject": f"""{_FLAWED}, r AS (SELECT seq, concat_ws(',', CASE WHEN name = '' THEN 'name' END,
        CASE WHEN website = '/relative' THEN 'website' END,
        CASE WHEN source = 'nowhere' THEN 'source' END,
        CASE WHEN {_BAD_YEAR} THEN 'founded_year' END) AS reasons FROM flawed)
        SELECT * FROM r WHERE reasons <> ''""",
    "p_country": f"""{_LEADS} SELECT seq, country FROM leads WHERE has_geo AND country IN ('USA', 'UK')""",
    "p_quality": f"""{_FLAWED} SELECT seq, website FROM flawed WHERE length(name) >= 2
        AND coalesce(website, '') <> '/relative'""",
    "p_min_score": f"{_SCORED} SELECT seq, total_score FROM scored WHERE total_score >= 45",
    "p_truth": f"""{_LEADS} SELECT seq, has_hiring AND hiring AS hiring, has_tech AS tech,
        has_funding AS funding FROM leads""",
    "p_failed_source": f"SELECT doc_id, source FROM documents WHERE {_NUMBER} % 3 <> 0",
    "p_source_settings": """SELECT doc_id, length(source) * 100 AS max_chars,
        n_chars <= length(source) * 100 AS within FROM documents""",
    "p_robots": f"""SELECT page_id, CASE WHEN length({_HOST}) % 2 <> 0 THEN true
        WHEN starts_with({_PATH}, '/en/1') THEN true WHEN starts_with({_PATH}, '/en') THEN false
        WHEN starts_with({_PATH}, '/fr/' || length({_HOST}) % 10) THEN false ELSE true END AS allowed
        FROM pages""",
    "p_robots_agent": f"SELECT page_id, length({_HOST}) % 2 <> 0 AS allowed FROM pages",
    "o_rank": f"{_SCORED} SELECT seq, total_score FROM scored",
    "o_top5": f"""{_SCORED}, top AS (SELECT * FROM scored ORDER BY total_score DESC, seq LIMIT 5)
        SELECT CAST(row_number() OVER (ORDER BY total_score DESC, seq) AS INTEGER) AS rank, name,
        coalesce(domain, 'N/A') AS domain, source,
        CAST(round(CAST(total_score AS DECIMAL(18,6)), 1) AS VARCHAR) AS score, upper(priority) AS priority,
        CASE WHEN has_hiring AND hiring THEN open END AS open_positions,
        CASE WHEN has_tech THEN nullif({Q.TECHNOLOGIES}, '') END AS technologies FROM top""",
    "w_cap": """SELECT o_custkey, o_orderkey FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3""",
    "w_site_cap": f"""SELECT page_id AS seq FROM pages
        QUALIFY row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) <= 2""",
    "u_union": """SELECT doc_id AS seq, lang AS name, source, CAST(NULL AS VARCHAR) AS url FROM documents
        UNION ALL SELECT page_id + 72057594037927936, 'page', NULL, url FROM pages""",
    **{f"k_{kind}": f"{_SCORED} SELECT {Q.flat_row()} FROM scored" for kind in ("csv", "json", "parquet")},
    "k_run_metrics": f"""SELECT source, {_NUMBER} % 3 <> 0 AS success, count(*) AS total_scraped,
        count(*) FILTER (WHERE lang = 'en') AS total_enriched, 0::BIGINT AS total_scored,
        {_NUMBER} * 0.5::DOUBLE AS execution_time,
        CASE WHEN {_NUMBER} % 3 = 0 THEN 'page could not be read' ELSE '' END AS errors, '' AS warnings,
        '2024-01-31 12:00:00' AS written_at FROM documents GROUP BY source""",
    "k_workbook_sets": f"""{_SCORED}, summary AS ({_SUMMARY_ROWS})
        SELECT 'companies' AS sheet, name AS item, total_score AS value FROM scored
        UNION ALL SELECT 'high_priority', name, total_score FROM scored WHERE priority = 'high'
        UNION ALL SELECT 'summary', "Metric", "Count"::DOUBLE FROM summary""",
    "n_tech_detect": f"{_MARKED} SELECT page_id, {Q.tech_list()} AS technologies FROM m",
    "n_tech_many": f"""{_MARKED} SELECT page_id, concat_ws(',', nullif({Q.tech_list()}, ''),
        'tool' || page_id % 3000) AS technologies FROM m""",
    "n_tech_page_headers": f"""WITH {Q.MARKED}, m AS (SELECT page_id, lower(html) || chr(10) ||
        CASE WHEN page_id % 2 = 0 THEN 'x-powered-by: php, express' ELSE 'server: cloudflare' END AS t FROM marked)
        SELECT page_id, {Q.tech_list()} AS technologies FROM m""",
    "n_tech_category": f"{_MARKED} SELECT page_id, "
        + ", ".join(f"{Q.tech_category(c)} AS {c}" for c in _CATEGORIES) + " FROM m",
    "n_site_stack": f"""{_MARKED}, {_SITES},
        found AS (SELECT regexp_replace(url, '/+$', '') AS page, string_agg(t, ' ') AS t FROM m
                  GROUP BY 1),
        named AS (SELECT page, {_ALL_TECH} AS technologies FROM found),
        joined AS (SELECT s.seq, s.has_enr, n.page IS NOT NULL AS hit, n.technologies FROM sites s
          LEFT JOIN named n ON n.page = coalesce(regexp_replace(s.website, '/+$', ''), 'https://' || s.domain))
        SELECT seq, has_enr OR hit AS has_enrichment, hit AS has_tech,
        CASE WHEN has_enr THEN 'web' END AS industry,
        CASE WHEN hit THEN technologies ELSE '' END AS technologies FROM joined""",
    "n_isolated": f"""{_LEADS} SELECT seq,
        CASE WHEN seq % 7 <> 3 THEN 'sector ' || seq % 5 WHEN has_enr THEN industry END AS industry,
        CASE WHEN has_hiring AND open <= 40 THEN open WHEN has_enr THEN employees END AS employee_count,
        {_SIZED} AS company_size,
        concat_ws(',', CASE WHEN seq % 7 = 3 THEN 'industry' END,
          CASE WHEN NOT has_hiring OR open > 40 THEN 'positions' END) AS failed,
        concat_ws(',', CASE WHEN seq % 7 = 3 THEN 'ValueError' END, CASE WHEN NOT has_hiring THEN 'TypeError'
          WHEN open > 40 THEN 'no valid enrichment' END) AS errors FROM leads""",
    "n_size": f"{_LEADS} SELECT seq, {_SIZED} AS company_size FROM leads",
    "n_region": f"{_LEADS} SELECT seq, {_REGION} AS region FROM leads",
    "n_ip": f"""WITH {_SITES}, keyed AS (SELECT *, coalesce(domain, {Q.domain('website')}) AS d FROM sites)
        SELECT seq, CASE WHEN length(d) % 2 = 0 THEN '10.0.0.' || length(d) END AS ip_address,
        has_enr OR coalesce(length(d) % 2 = 0, false) AS has_enrichment,
        coalesce(length(d) % 2 = 0, false) AS has_geo FROM keyed""",
    "n_funding": f"""{_SCORED} SELECT seq, true AS has_enrichment,
        CASE WHEN has_enr THEN fit ELSE 40.0::DOUBLE END AS fit FROM scored""",
    "n_hiring": f"""{_LEADS}, rollup AS ({_ROLLUP}) SELECT seq,
        CASE WHEN has_hiring THEN open ELSE total_open_positions END AS open,
        CASE WHEN has_hiring THEN hiring ELSE is_hiring END AS hiring
        FROM leads LEFT JOIN rollup ON domain = 'c' || company || '.example.com'""",
    "n_chain": f"""{_LEADS}, sized AS (SELECT * REPLACE ({_SIZED} AS size, true AS has_enr), has_enr AS enr0,
        {_REGION} AS region FROM leads),
        {Q.score_ctes('sized')}
        SELECT seq, size AS company_size, region, CASE WHEN enr0 THEN fit_score ELSE 40.0::DOUBLE END
        AS fit_score FROM scored""",
}
