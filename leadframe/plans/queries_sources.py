"""Registered queries: pages, listing profiles, payloads, series, de-duplication, whole runs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from leadframe.operators import dedup as D
from leadframe.operators import enrich as E
from leadframe.operators import rank as R
from leadframe.operators.kept import KeptIndex
from leadframe.plans import inputs as I
from leadframe.plans import sql as Q
from leadframe.plans.run import RunOptions, run_leads
from leadframe.schema import companies
from leadframe.sources import payloads as J
from leadframe.sources import profiles as P
from leadframe.sources import series as N
from leadframe.sources.html import TEXT, html_nodes

# --- pages --------------------------------------------------------------------------


def s_nodes(spark, d):
    """Elements per tag over all pages."""
    nodes = I.table(spark, d, "pages").select(F.explode(html_nodes("html")).alias("n"))
    return nodes.groupBy(F.col("n.tag").alias("tag")).agg(F.count(F.lit(1)).alias("nodes"))


def s_tag_counts(spark, d):
    """Elements of each page by tag."""
    nodes = F.filter(html_nodes("html"), lambda n: n["tag"] != TEXT)
    tags = I.table(spark, d, "pages").select("page_id", F.explode(nodes).alias("n"))
    return tags.groupBy("page_id", F.col("n.tag").alias("tag")).agg(F.count(F.lit(1)).alias("elements"))


def s_links(spark, d):
    """Links of each page (containment of anchors in list items)."""
    tags = ["li", "a"]
    nodes = F.col("nodes")
    pages = I.table(spark, d, "pages").select("page_id", html_nodes("html", tags).alias("nodes"))
    items = F.filter(nodes, lambda n: n["tag"] == "li")
    inside = F.transform(
        items,
        lambda li: F.size(
            F.filter(nodes, lambda n: (n["tag"] == "a") & (n["pos"] > li["pos"]) & (n["pos"] <= li["end_pos"]))
        ),
    )
    total = F.aggregate(inside, F.lit(0), lambda acc, x: acc + x)
    return pages.select("page_id", total.cast("bigint").alias("links"))


# --- listing profiles ------------------------------------------------------------------


def _record(df: DataFrame, *extra) -> DataFrame:
    return df.select("name", "domain", "website", "description", "source", "source_url", *extra)


def s_generic(spark, d):
    return _record(P.read_generic(I.generic_pages(spark, d)),
                   F.array_join("enrichment.tags", ",").alias("tags"))


def s_dir_a(spark, d):
    e = F.col("enrichment")
    df = P.read_directory_a(I.directory_a_pages(spark, d))
    return _record(
        df, e["company_size"].alias("company_size"), e["employee_count"].alias("employee_count"),
        e["geographic_info"]["city"].alias("city"), e["geographic_info"]["country"].alias("country"),
        e["hiring_intent"]["total_open_positions"].alias("open"),
        e["hiring_intent"]["is_hiring"].alias("hiring"), F.array_join(e["tags"], ",").alias("tags"),
    )


def s_dir_b(spark, d):
    e = F.col("enrichment")
    df = P.read_directory_b(I.directory_b_pages(spark, d))
    return _record(
        df, e["company_size"].alias("company_size"), e["geographic_info"]["city"].alias("city"),
        F.col("extra_data")["rating"].alias("rating"),
        F.col("extra_data")["hourly_rate"].alias("hourly_rate"),
        F.array_join(e["tags"], ",").alias("tags"),
    )


def s_launch(spark, d):
    df = P.read_launches(I.launch_pages(spark, d))
    x = F.col("extra_data")
    return _record(
        df, x["upvotes"].alias("upvotes"), x["product_name"].alias("product_name"),
        F.col("enrichment.company_size").alias("company_size"),
    )


def s_launch_top(spark, d):
    """The first 50 launches over all pages, in page order."""
    return _record(P.read_launches(I.launch_pages(spark, d), max_products=50))


def s_news(spark, d):
    df = P.read_news_board(I.news_pages(spark, d))
    return _record(df, F.col("enrichment.hiring_intent.is_hiring").alias("hiring"))


def s_api_json(spark, d):
    e = F.col("enrichment")
    df = J.read_organisations(I.organisation_payloads(spark, d))
    return _record(
        df, e["funding_info"]["total_funding"].alias("total_funding"),
        e["funding_info"]["stage"].alias("stage"), e["geographic_info"]["city"].alias("city"),
        e["geographic_info"]["region"].alias("region"),
        e["geographic_info"]["country"].alias("country"),
    )


def s_payload_rejects(spark, d):
    """Payloads that gave no record, with the reason."""
    found = J.unreadable_payloads(I.broken_payloads(spark, d))
    return found.select("page_id", "reason", F.substring("near", 1, 20).alias("begins"))


def s_product_details(spark, d):
    """Launch records with website, domain and topics of their detail pages."""
    c = I.table(spark, d, "customer")
    k = F.col("c_custkey")
    details = c.select(
        F.format_string(f"{P.LAUNCH_ROOT}/posts/%d", k).alias("url"),
        F.format_string(
            '<a data-test="website-link" href="https://www.P%d.example.com/x">Visit website</a>'
            '<a data-test="maker-link">Ann %d</a><a data-test="maker-link">Bob</a>'
            '<a data-test="topic-link">%s</a>', k, k, F.lower("c_mktsegment"),
        ).alias("html"),
    )
    launches = P.read_launches(I.launch_pages(spark, d))
    joined = P.with_product_details(launches, P.read_product_details(I.spread(details)))
    return joined.select(
        "name", "website", "domain", F.array_join("enrichment.tags", ",").alias("tags")
    )


def s_makers(spark, d):
    c = I.table(spark, d, "customer")
    k = F.col("c_custkey")
    pages = c.select(
        k.alias("k"),
        F.when(k % 2 == 0, F.format_string('<a data-test="maker-link">Ann <b>%d</b></a><a>website</a>', k))
        .otherwise(F.lit("<p>none</p>")).alias("html"),
        F.lit("u").alias("url"),
    )
    out = P.read_product_details(I.spread(pages))
    return out.select("k", F.array_join("makers", "|").alias("makers"), "website")


def s_date_spine(spark, d):
    """Day pages of the last ten days."""
    pages = I.table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit("https://l.example.com/posts/"), F.date_format("ts", "yyyy/MM/dd")).alias("url"),
    )
    out = N.day_pages(spark, pages, "https://l.example.com", "2024-01-30", 10)
    return out.select("event_id", "day_offset", F.col("day").cast("string").alias("day"))


def s_take_while(spark, d):
    """Orders of each customer as pages by number; one not filled is empty, cheap ones are missing."""
    orders = I.table(spark, d, "orders")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pages = orders.withColumn("page", number).filter("o_totalprice >= 20000").select(
        F.col("o_custkey").alias("category"), "page",
        F.when(F.col("o_orderstatus") != "F", F.lit(1)).alias("rows"),
    )
    return N.take_while_filled(pages, "category", "page", "rows").select("category", "page")


def e_size_bands(spark, d):
    k = F.col("c_custkey")
    options = ["1-10", "11-50", "51-200", "201-1000", "1000+", "10,000+ staff", "1,000 - 9,999",
               "250 - 999", "50 - 249", "10 - 49", "2 - 9", "none"]
    text = F.get(F.array(*[F.lit(o) for o in options]), F.pmod(k, F.lit(12)).cast("int"))
    bands = {"a": P.STARTUP_BANDS, "b": P.AGENCY_BANDS}
    cols = []
    for n, table in bands.items():
        for mode, sub in (("", False), ("_sub", True)):
            s = P.size_band(text, table, sub)
            cols += [s["company_size"].alias(f"size_{n}{mode}")]
            if n == "a":
                cols += [s["employee_count"].alias(f"count_{n}{mode}")]
    return I.table(spark, d, "customer").select(k.alias("k"), *cols)


def e_location(spark, d):
    k = F.col("c_custkey")
    text = (
        F.when(k % 3 == 0, F.concat(F.lit(" City "), F.col("c_nationkey").cast("string"),
                                    F.lit(" , TX,  USA ")))
        .when(k % 3 == 1, F.lit("Remote")).otherwise(F.lit(""))
    )
    loc = P.location_parts(text)
    return I.table(spark, d, "customer").select(
        k.alias("k"), loc["city"].alias("city"), loc["country"].alias("country")
    )


# --- de-duplication ---------------------------------------------------------------------


def d_key(spark, d):
    p = I.page_companies(spark, d)
    k = F.col("seq")
    p = p.withColumns({
        "domain": F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.upper("domain")),
        "website": F.when(k % 9 != 0, F.col("website")),
    })
    return p.select("seq", D.dedup_key().alias("key"), D.name_key().alias("name_key"))


def d_domain_first(spark, d):
    return D.first_per_domain(I.page_companies(spark, d)).select("seq", "domain")


def d_exact_name(spark, d):
    docs = I.table(spark, d, "documents").select(
        F.col("doc_id").alias("seq"), F.col("text").alias("name")
    )
    return D.first_per_name(docs).select("seq")


def d_fuzzy(spark, d):
    return D.deduplicate(I.page_companies(spark, d)).select("seq", "domain", "name")


def d_fuzzy_names(spark, d):
    """Name matching only."""
    p = I.page_companies(spark, d)
    none = F.lit(None).cast("string")
    return D.deduplicate(p.withColumns({"domain": none, "website": none})).select("seq", "name")


def d_batches(spark, d):
    """The kept pages, collected in three batches of which each meets the kept ones of the earlier."""
    p = I.page_companies(spark, d)
    third = p.agg(F.max("seq")).first()[0] // 3 + 1
    index = KeptIndex(spark, f"kept_{uuid.uuid4().hex}", buckets=8)
    kept = [index.add(p.filter(F.floor(F.col("seq") / third) == k)) for k in range(3)]
    index.drop()
    return reduce(DataFrame.unionByName, kept)


def d_representatives(spark, d):
    return D.representatives(I.page_companies(spark, d))


def d_merge_fuzzy(spark, d):
    return D.merge_duplicates(I.page_companies(spark, d)).select("seq", "name", "domain")


def d_merge(spark, d):
    """Orders of a customer merged: first known value of each column."""
    orders = I.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("rep"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("level"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderstatus") == "F", F.lit("done")).alias("state"),
    )
    return D.merge_by(orders, "rep")


def d_counts(spark, d):
    """Rows before and after domain matching."""
    p = I.page_companies(spark, d)
    kept = D.first_per_domain(p)
    marks = p.select(F.lit(1).alias("t"), F.lit(0).alias("k")).unionByName(
        kept.select(F.lit(0).alias("t"), F.lit(1).alias("k"))
    )
    counts = marks.agg(F.sum("t").alias("total"), F.sum("k").alias("kept"))
    return counts.withColumn("removed", F.col("total") - F.col("kept"))


# --- whole runs ---------------------------------------------------------------------------


def _site_records(spark, d) -> DataFrame:
    p = I.page_companies(spark, d)
    return companies(
        p, seq=F.col("seq"), name=F.col("name"), website=F.col("website"), domain=F.col("domain"),
        source=F.col("source"),
    )


def _sites_scored(spark, d, threshold=None, minimum=0.0) -> DataFrame:
    options = RunOptions(name_threshold=threshold, min_score=minimum)
    enrich = E.tech_enricher(I.marked_pages(spark, d))
    return run_leads([_site_records(spark, d)], [enrich], options=options)


def l_best_sites(spark, d):
    return R.top_report(_sites_scored(spark, d))


def l_sites(spark, d):
    """All sites: domain matching, technologies, score, minimum score."""
    return _sites_scored(spark, d, minimum=25.0).select(
        "seq", "domain", "score.total_score", "score.priority"
    )


def l_sites_fuzzy(spark, d):
    """The same with name matching."""
    return _sites_scored(spark, d, 0.85).select("seq", "domain", "score.total_score")


def l_sources(spark, d):
    """Four kinds of sources in one run, with name matching, enrichers and score."""
    sources = [
        J.read_organisations(I.organisation_payloads(spark, d)),
        P.read_news_board(I.news_pages(spark, d)),
        P.read_generic(I.generic_pages(spark, d)),
        _site_records(spark, d),
    ]
    steps = [E.tech_enricher(I.marked_pages(spark, d)), E.size_enricher, E.region_enricher]
    return run_leads(sources, steps, options=RunOptions(ref_year=2024)).select(
        "seq", "name", "source", "score.total_score", "score.priority"
    )


QUERIES = {f.__name__: f for f in (
    s_nodes, s_tag_counts, s_links, s_generic, s_dir_a, s_dir_b, s_launch, s_launch_top, s_news, s_api_json, s_payload_rejects,
    s_product_details, s_makers, s_date_spine, s_take_while, e_size_bands, e_location, d_key,
    d_domain_first, d_exact_name, d_fuzzy, d_fuzzy_names, d_batches, d_representatives,
    d_merge_fuzzy, d_merge, d_counts, l_best_sites, l_sites, l_sites_fuzzy, l_sources,
)}

# --- SQL -------------------------------------------------------------------------------------

_N = "replace(c_name, '#', '')"
_K = "c_custkey"
_GENERIC_NAME = f"'Firm ' || c_mktsegment || ' ' || {_K} % 7"
_BAND_TEXT = Q.nth(_K, Q.texts("1-10", "11-50", "51-200", "201-1000", "1000+", "10,000+ staff",
                               "1,000 - 9,999", "250 - 999", "50 - 249", "10 - 49", "2 - 9", "none"))
_SITES_SCORED = f"""WITH {Q.PAGE_COMPANIES}, {Q.MARKED},
    firsts AS (SELECT * FROM page_companies
      QUALIFY row_number() OVER (PARTITION BY lower(domain) ORDER BY seq) = 1),
    found AS (SELECT regexp_replace(url, '/+$', '') AS page, string_agg(lower(html), ' ') AS t FROM marked GROUP BY 1),
    leads AS (SELECT seq, name, domain, website, CAST(NULL AS VARCHAR) AS description, 'other' AS source,
      page IS NOT NULL AS has_enr, page IS NOT NULL AS has_tech, false AS has_hiring, false AS has_funding,
      0 AS open, 0 AS recent, 0.0::DOUBLE AS velocity, false AS hiring,
      CASE WHEN {Q.has_tech('react')} THEN 'React' WHEN {Q.tech_category('frameworks')} <> '' THEN 'x' ELSE '' END
        AS framework,
      CASE WHEN {Q.has_tech('redis')} THEN 'Redis' WHEN {Q.tech_category('databases')} <> '' THEN 'x' ELSE '' END AS db,
      {Q.tech_category('cloud_providers')} AS cloud, {Q.tech_category('analytics')} AS analytics,
      concat_ws(', ', {", ".join(f"nullif({Q.tech_category(c)}, '')" for c in
        ("frameworks", "databases", "cloud_providers", "tools", "analytics", "marketing"))}) AS all_tech,
      'unknown' AS stage, NULL::BIGINT AS employees, 'unknown' AS size,
      false AS linkedin, false AS twitter, false AS github, false AS crunchbase
      FROM firsts LEFT JOIN found ON page = regexp_replace(website, '/+$', '')),
    {Q.score_ctes()}"""
# other technologies of the sites count for the base points too
_SITES_SCORED = _SITES_SCORED.replace(
    "framework <> '' OR db <> '' OR cloud <> '' OR analytics <> ''", "all_tech <> ''")

ORACLES = {
    "s_generic": f"""WITH cards AS (SELECT *, floor({_K} / 10) AS page, {_GENERIC_NAME} AS name FROM customer),
        firsts AS (SELECT * FROM cards QUALIFY row_number() OVER (PARTITION BY page, name ORDER BY {_K}) = 1)
        SELECT name, CASE page % 3 WHEN 2 THEN 't.example.org' ELSE 'list.example.com' END AS domain,
        CASE page % 3 WHEN 0 THEN 'https://list.example.com/c/' || {_K}
          WHEN 1 THEN 'https://list.example.com/p/c/' || {_K} || '?x=1'
          ELSE 'https://t.example.org/' || {_K} END AS website,
        CASE page % 3 WHEN 0 THEN c_mktsegment || ' & more' WHEN 1 THEN c_mktsegment END AS description,
        'manual' AS source, 'https://list.example.com/p/' || CAST(page AS BIGINT) AS source_url,
        'generic-scrape' AS tags FROM firsts""",
    "s_dir_a": f"""WITH sized AS (SELECT *, {Q.nth(_K, Q.texts('startup', 'small', 'medium', 'large',
          'enterprise', 'unknown'))} AS size FROM customer)
        SELECT {_N} AS name, CAST(NULL AS VARCHAR) AS domain, CAST(NULL AS VARCHAR) AS website,
        'Makes ' || lower(c_mktsegment) AS description, 'angellist' AS source,
        'https://www.angellist.com/c/' || {_K} AS source_url, size AS company_size,
        CASE size WHEN 'startup' THEN 5 WHEN 'small' THEN 30 WHEN 'medium' THEN 125 WHEN 'large' THEN 600
          WHEN 'enterprise' THEN 2000 END AS employee_count,
        {Q.nth(_K, Q.texts('Paris', 'Austin', 'Remote'))} AS city,
        {Q.nth(_K, ["'France'", "'USA'", "NULL"])} AS country,
        1000 + {_K} % 1000 AS open, true AS hiring, 'angellist,startup' AS tags FROM sized""",
    "s_dir_b": f"""SELECT {_N} AS name, CAST(NULL AS VARCHAR) AS domain, CAST(NULL AS VARCHAR) AS website,
        'Best ' || c_mktsegment AS description, 'clutch' AS source,
        'https://h' || {_K} || '.example.com/' AS source_url,
        {Q.nth(_K, Q.texts('enterprise', 'enterprise', 'large', 'medium', 'small', 'startup', 'unknown'))}
          AS company_size, 'City ' || c_nationkey AS city,
        {Q.nth(_K, ["'4.5'", "'5.0'", "NULL"])} AS rating, '25  hr' AS hourly_rate,
        'agency,b2b-service' AS tags FROM customer""",
    "s_launch": f"""SELECT {_N} AS name, CAST(NULL AS VARCHAR) AS domain, CAST(NULL AS VARCHAR) AS website,
        'Tool for ' || lower(c_mktsegment) AS description, 'product_hunt' AS source,
        'https://www.producthunt.com/posts/' || {_K} AS source_url, CAST({_K} * 3 AS VARCHAR) AS upvotes,
        {_N} || ' GmbH' AS product_name, 'startup' AS company_size FROM customer""",
    "s_launch_top": f"""SELECT {_N} AS name, CAST(NULL AS VARCHAR) AS domain, CAST(NULL AS VARCHAR) AS website,
        'Tool for ' || lower(c_mktsegment) AS description, 'product_hunt' AS source,
        'https://www.producthunt.com/posts/' || {_K} AS source_url FROM customer
        ORDER BY {_K} LIMIT 50""",
    "s_news": f"""SELECT {_N} || '  ' || lower(c_mktsegment) AS name, 'H' || {_K} || '.example.com' AS domain,
        'https://h' || {_K} || '.example.com/' AS website, '' AS description, 'job_boards' AS source,
        'https://news.ycombinator.com/item?id=' || {_K} AS source_url, true AS hiring
        FROM customer WHERE {_K} % 7 <> 0""",
    "s_api_json": """SELECT replace(s_name, '#', '') AS name,
        CASE WHEN s_suppkey % 3 <> 0 THEN 's' || s_suppkey || '.example.com' END AS domain,
        CASE WHEN s_suppkey % 5 <> 0 THEN 'https://s' || s_suppkey || '.example.com/' END AS website,
        'Supplier of ' || n_name AS description, 'crunchbase' AS source, CAST(NULL AS VARCHAR) AS source_url,
        CASE WHEN s_suppkey % 4 <> 0 THEN round(s_acctbal, 2) ELSE 0.0::DOUBLE END AS total_funding,
        'unknown' AS stage, n_name AS city, r_name AS region,
        CASE s_suppkey % 3 WHEN 0 THEN 'USA' WHEN 1 THEN 'UK' ELSE 'IND' END AS country
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "s_tag_counts": r"""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
          '(<(?:script|style)[^>]*>).*?(</(?:script|style)>)', '\1\2', 'gis') AS h FROM pages),
        tags AS (SELECT page_id, unnest(regexp_extract_all(h, '<([A-Za-z][^\s/>]*)', 1)) AS tag FROM bare)
        SELECT page_id, lower(tag) AS tag, count(*) AS elements FROM tags GROUP BY ALL""",
    "s_payload_rejects": """SELECT page_id, reason, begins FROM (
          SELECT page_id, ['malformed', 'no items', 'empty', 'malformed'][page_id % 11] AS reason,
            ['{"data":{"items":[{"', '{"data": {"entities"', ' ', '{"data": {"items": 7'][page_id % 11] AS begins
          FROM (SELECT DISTINCT s_suppkey // 10 AS page_id FROM supplier)) WHERE reason IS NOT NULL""",
    "s_product_details": f"""SELECT {_N} AS name, 'https://www.p' || {_K} || '.example.com/x' AS website,
        'P' || {_K} || '.example.com' AS domain, 'product-hunt,new-launch,' || lower(c_mktsegment) AS tags
        FROM customer""",
    "s_makers": f"""SELECT {_K} AS k, CASE WHEN {_K} % 2 = 0 THEN 'Ann ' || {_K} ELSE '' END AS makers,
        CAST(NULL AS VARCHAR) AS website FROM customer""",
    "s_date_spine": """SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') AS day_offset,
        CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events
        WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-21' AND DATE '2024-01-30'""",
    "s_take_while": """WITH numbered AS (SELECT o_custkey AS category, o_orderstatus, o_totalprice,
          CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page FROM orders)
        SELECT category, page FROM numbered
        QUALIFY count(*) FILTER (WHERE o_orderstatus = 'F' OR o_totalprice < 20000) OVER
          (PARTITION BY category ORDER BY page) = 0""",
    "e_size_bands": f"""WITH b AS (SELECT {_K} AS k, {_K} % 12 AS i FROM customer) SELECT k,
        CASE i WHEN 0 THEN 'startup' WHEN 1 THEN 'small' WHEN 2 THEN 'medium' WHEN 3 THEN 'large'
          WHEN 4 THEN 'enterprise' ELSE 'unknown' END AS size_a,
        CASE i WHEN 0 THEN 5 WHEN 1 THEN 30 WHEN 2 THEN 125 WHEN 3 THEN 600 WHEN 4 THEN 2000 END AS count_a,
        CASE i WHEN 0 THEN 'startup' WHEN 1 THEN 'small' WHEN 2 THEN 'medium' WHEN 3 THEN 'startup'
          ELSE 'unknown' END AS size_a_sub,
        CASE i WHEN 0 THEN 5 WHEN 1 THEN 30 WHEN 2 THEN 125 WHEN 3 THEN 5 END AS count_a_sub,
        CASE i WHEN 5 THEN 'enterprise' WHEN 6 THEN 'enterprise' WHEN 7 THEN 'large' WHEN 8 THEN 'medium'
          WHEN 9 THEN 'small' WHEN 10 THEN 'startup' ELSE 'unknown' END AS size_b,
        CASE i WHEN 6 THEN 'enterprise' WHEN 7 THEN 'large' WHEN 8 THEN 'medium'
          WHEN 9 THEN 'small' WHEN 10 THEN 'startup' ELSE 'unknown' END AS size_b_sub FROM b""",
    "e_location": f"""SELECT {_K} AS k, {Q.nth(_K, ["'City ' || c_nationkey", "'Remote'", "NULL"])} AS city,
        {Q.nth(_K, ["'USA'", "NULL", "NULL"])} AS country FROM customer""",
    "s_links": """SELECT page_id, CAST(len(regexp_extract_all(html, '<li><a href="[^"]*">')) AS BIGINT) AS links
        FROM pages""",
    "d_key": f"""WITH {Q.PAGE_COMPANIES} SELECT seq, CASE WHEN seq % 3 = 1 THEN lower(domain)
        WHEN seq % 9 <> 0 THEN domain END AS key, lower({Q.company('name')}) AS name_key FROM page_companies""",
    "d_domain_first": f"""WITH {Q.PAGE_COMPANIES} SELECT seq, domain FROM page_companies
        QUALIFY row_number() OVER (PARTITION BY lower(domain) ORDER BY seq) = 1""",
    "d_exact_name": "SELECT min(doc_id) AS seq FROM documents GROUP BY text",
    "d_merge": """SELECT o_custkey AS seq,
        arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 3 = 0 AND o_orderpriority IS NOT NULL) AS level,
        arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS price,
        max(CASE WHEN o_orderstatus = 'F' THEN 'done' END) AS state FROM orders GROUP BY o_custkey""",
    "d_counts": f"""WITH {Q.PAGE_COMPANIES} SELECT count(*) AS total, count(DISTINCT lower(domain)) AS kept,
        count(*) - count(DISTINCT lower(domain)) AS removed FROM page_companies""",
    "l_best_sites": f"""{_SITES_SCORED}, top AS (SELECT * FROM scored ORDER BY total_score DESC, seq LIMIT 5)
        SELECT CAST(row_number() OVER (ORDER BY total_score DESC, seq) AS INTEGER) AS rank, name, domain, source,
        CAST(round(CAST(total_score AS DECIMAL(18,6)), 1) AS VARCHAR) AS score, upper(priority) AS priority,
        NULL::BIGINT AS open_positions,
        nullif(array_to_string(string_split(all_tech, ', ')[1:5], ', '), '') AS technologies FROM top""",
    "l_sites": f"""{_SITES_SCORED} SELECT seq, domain, total_score, priority FROM scored
        WHERE total_score >= 25""",
}
