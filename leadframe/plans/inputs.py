"""Input tables of the registered queries, derived in Spark from the given ones.

All rules read whole tables; row numbers in them only choose which branch of an
operator a row exercises, never whether it takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadframe import schema as S
from leadframe.functions.text import round2
from leadframe.functions.urls import extract_domain
from leadframe.sources.html import page_title

HIRING_REFERENCE = "2001-08-02 00:00:00"
POSTING_REFERENCE = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over the session's shuffle width: costly ones may come from few parts of a small file."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def page_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as minimal company rows: title, address, host."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"),
        page_title("html").alias("name"),
        F.col("url").alias("website"),
        extract_domain("url").alias("domain"),
        F.lit("other").alias("source"),
    )


def _nth(k: Column, values: list) -> Column:
    """The (k mod n)-th of a short list of constants."""
    options = F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])
    return F.get(options, F.pmod(k, F.lit(len(values))).cast("int"))


def _strings(*items: str) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full company records from customers and their orders."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey"), F.col("o_orderdate").cast("timestamp").alias("at")
    )
    ref = F.lit(HIRING_REFERENCE).cast("timestamp")
    per_customer = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("at") >= ref - F.expr("INTERVAL 365 DAYS")).alias("recent"),
    )
    c = table(spark, sf_dir, "customer")
    joined = c.join(per_customer, c.c_custkey == per_customer.o_custkey, "left")
    k = F.col("c_custkey")
    n = F.coalesce("n", F.lit(0))
    present = lambda m, v: F.when(k % m != 0, v)
    host = F.concat(F.lit("c"), k.cast("string"), F.lit(".example.com"))
    link = lambda site: F.concat(F.lit(f"https://{site}.example/"), k.cast("string"))
    hiring = S.build(
        S.HIRING_INTENT,
        total_open_positions=n * 3,
        recent_postings=F.coalesce("recent", F.lit(0)),
        hiring_velocity=round2(n * 3 / F.lit(12.0)),
        is_hiring=n > 10,
    )
    tech = S.build(
        S.TECH_STACK,
        frameworks=_nth(k, [_strings(), _strings("React"), _strings("Django")]),
        databases=_nth(k, [_strings(), _strings("PostgreSQL"), _strings("Postgresql"),
                           _strings("Redis")]),
        cloud_providers=F.when(k % 5 == 0, _strings("Aws")).otherwise(_strings()),
        analytics=F.when(k % 6 == 0, _strings("Hotjar")).otherwise(_strings()),
    )
    funding = S.build(
        S.FUNDING_INFO,
        stage=_nth(k, S.FUNDING_STAGES),
        total_funding=F.abs("c_acctbal") * 1000,
    )
    geo = S.build(
        S.GEOGRAPHIC_INFO,
        country=_nth(k, ["USA", "US", "United States", "UK", "United Kingdom", "Germany",
                         "France", "India"]),
        city=F.concat(F.lit("City "), F.col("c_nationkey").cast("string")),
    )
    social = S.build(
        S.SOCIAL_PROFILES,
        linkedin=present(2, link("linkedin")), twitter=present(3, link("twitter")),
        github=present(5, link("github")), crunchbase=present(7, link("crunchbase")),
    )
    enrichment = S.build(
        S.ENRICHMENT,
        tech_stack=F.when(k % 11 != 0, tech),
        hiring_intent=F.when(k % 7 != 0, hiring),
        funding_info=F.when(k % 4 != 0, funding),
        geographic_info=F.when(k % 9 != 0, geo),
        social_profiles=social,
        employee_count=F.floor(F.col("c_acctbal") / 10).cast("bigint"),
        company_size=_nth(k, S.COMPANY_SIZES),
        founded_year=1790 + k % 300,
        industry=F.lower("c_mktsegment"),
        tags=F.array(F.lower("c_mktsegment")),
    )
    return S.companies(
        joined,
        seq=k,
        name=F.col("c_name"),
        domain=present(3, host),
        website=present(2, F.concat(F.lit("https://"), host, F.lit("/"))),
        description=present(5, F.concat(F.lit("Leader in "), F.lower("c_mktsegment"))),
        source=_nth(k, S.DATA_SOURCES),
        enrichment=F.when(k % 13 != 0, enrichment),
        scraped_at=F.lit("2024-01-31 12:00:00"),
        updated_at=F.lit("2024-01-31 12:00:00"),
    )


def broken_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads of the organisations, some of them broken in one of four ways."""
    k = F.col("page_id")
    return organisation_payloads(spark, sf_dir).withColumn(
        "payload",
        F.when(k % 11 == 1, F.expr("substring(payload, 1, length(payload) - 5)"))
        .when(k % 11 == 2, F.lit('{"data": {"entities": []}}'))
        .when(k % 11 == 3, F.lit(" "))
        .when(k % 11 == 4, F.lit('{"data": {"items": 7}}'))
        .otherwise(F.col("payload")),
    )


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with technology markers appended, so that signatures fire."""
    marks = [
        '<script src="/js/jquery.min.js"></script>',
        "<div data-reactroot>",
        '<link href="/wp-content/a.css">',
        "<!-- cdn: x.cloudfront.net, redis -->",
        "",
    ]
    return table(spark, sf_dir, "pages").withColumn(
        "html", F.concat("html", _nth(F.col("page_id"), marks))
    )


def listing_pages(spark: SparkSession, sf_dir: str, card: Column, head: str = "", foot: str = "",
                  salt: int = 10) -> DataFrame:
    """Customers rendered as listing pages of ten cards, in key order."""
    c = table(spark, sf_dir, "customer")
    page = F.floor(F.col("c_custkey") / salt).cast("bigint")
    # the session's shuffle width, so that small but costly pages stay spread
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cards = c.select(
        page.alias("page_id"), F.col("c_custkey").alias("k"), card.alias("card")
    ).repartition(width, "page_id")
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda x: x["card"]), "\n"
    )
    html = F.concat(F.lit(f"<!DOCTYPE html><html><body>{head}"), body, F.lit(f"{foot}</body></html>"))
    return cards.groupBy("page_id").agg(html.alias("html")).select(
        "page_id",
        F.concat(F.lit("https://list.example.com/p/"), F.col("page_id").cast("string")).alias("url"),
        "html",
    )


def _fmt(template: str, *cols) -> Column:
    return F.format_string(template, *cols)


def generic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of pages: headings, item lists, table rows."""
    k = F.col("c_custkey")
    kind = F.pmod(F.floor(k / 10), F.lit(3))
    name = F.concat(F.lit("Firm "), F.col("c_mktsegment"), F.lit(" "), (k % 7).cast("string"))
    card = (
        F.when(kind == 0, _fmt('<h2><a href="/c/%d">%s</a></h2><p>%s &amp; more',
                               k, name, F.col("c_mktsegment")))
        .when(kind == 1, _fmt('<li class="card"><a href="c/%d?x=1">%s</a><p>%s</p></li>',
                              k, name, F.col("c_mktsegment")))
        .otherwise(_fmt('<tr><td><a href="//t.example.org/%d">%s</a></td><td>1</td></tr>', k, name))
    )
    pages = listing_pages(spark, sf_dir, card)
    table_kind = F.pmod("page_id", F.lit(3)) == 2
    return pages.withColumn(
        "html",
        F.when(table_kind, F.concat(F.lit("<table>"), "html", F.lit("</table>"))).otherwise(F.col("html")),
    )


def directory_a_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    size = _nth(k, ["1-10", "11-50", "51-200", "201-1000", "1000+", "some"])
    place = _nth(k, ["Paris, France", "Austin, TX, USA", "Remote"])
    card = _fmt(
        '<div class="Company-card"><h2>%s Inc.</h2><p>Makes %s</p><a href="/c/%d">go</a>'
        '<span class="location">%s</span><span class="size">%s employees</span>'
        '<span class="jobs">1,%03d jobs</span></div>',
        F.col("c_name"), F.lower("c_mktsegment"), k, place, size, k % 1000,
    )
    return listing_pages(spark, sf_dir, card)


def directory_b_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    size = _nth(k, ["10,000+", "1,000 - 9,999", "250 - 999", "50 - 249", "10 - 49", "2 - 9", "-"])
    rating = _nth(k, ["4.5", " 5.0 ", "n/a"])
    card = _fmt(
        '<li class="provider-row sponsor"><h3 class="company_info">%s Ltd</h3>'
        '<a class="website-link" href="https://H%d.example.com">site</a><p class="tagline">Best %s</p>'
        '<span class="locality">City %d</span><span class="rating">%s</span>'
        '<div class="hourly-rate">$25 / hr</div><div class="employees">%s</div></li>',
        F.col("c_name"), k, F.col("c_mktsegment"), F.col("c_nationkey"), rating, size,
    )
    return listing_pages(spark, sf_dir, card, "<ul>", "</ul>")


def launch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Launch pages of three markups; 25 cards each, one page per day."""
    k = F.col("c_custkey")
    kind = F.pmod(F.floor(k / 25), F.lit(3))
    inner = _fmt(
        '<h3>%s GmbH</h3><p>Tool for %s</p><a href="/posts/%d">x</a>'
        '<button class="upVote">%d votes</button>',
        F.col("c_name"), F.lower("c_mktsegment"), k, k * 3,
    )
    card = (
        F.when(kind == 0, F.concat(F.lit('<div data-test="post-item">'), inner, F.lit("</div>")))
        .when(kind == 1, F.concat(F.lit("<article>"), inner, F.lit("</article>")))
        .otherwise(F.concat(F.lit('<div class="Post-box">'), inner, F.lit("</div>")))
    )
    return listing_pages(spark, sf_dir, card, salt=25)


def news_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News boards of 30 rows; every seventh link is internal."""
    k = F.col("c_custkey")
    href = F.when(k % 7 == 0, _fmt("item?id=%d", k)).otherwise(_fmt("https://H%d.example.com", k))
    card = _fmt(
        '<tr class="athing" id="%d"><td><span class="titleline"><a href="%s">Show HN: %s &#8211; %s'
        "</a></span></td></tr>",
        k, href, F.col("c_name"), F.lower("c_mktsegment"),
    )
    return listing_pages(spark, sf_dir, card, "<table>", "</table>", salt=30)


def organisation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier payloads of ten organisations as JSON text."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    k = F.col("s_suppkey")
    host = F.concat(F.lit("s"), k.cast("string"), F.lit(".example.com"))
    item = F.struct(
        F.struct(
            F.concat(F.col("s_name"), F.lit(" Corp")).alias("name"),
            F.when(k % 3 != 0, host).alias("domain"),
            F.when(k % 5 != 0, F.concat(F.lit("https://"), host)).alias("homepage_url"),
            F.concat(F.lit("Supplier of  "), F.col("n_name")).alias("short_description"),
            F.when(k % 4 != 0, F.round("s_acctbal", 2)).alias("total_funding_usd"),
            F.col("n_name").alias("city_name"),
            F.col("r_name").alias("region_name"),
            _nth(k, ["USA", "UK", "IND"]).alias("country_code"),
        ).alias("properties")
    )
    rows = (
        s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        .select(F.floor(k / 10).cast("bigint").alias("page_id"), k.alias("k"), item.alias("i"))
    )
    items = F.transform(F.array_sort(F.collect_list(F.struct("k", "i"))), lambda x: x["i"])
    return rows.groupBy("page_id").agg(
        F.to_json(F.struct(F.struct(items.alias("items")).alias("data"))).alias("payload")
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job postings."""
    dept = (
        F.when(F.col("event_type") == "signup", "engineering")
        .when(F.col("event_type") == "purchase", "sales")
        .when(F.col("event_type") == "click", "marketing")
        .otherwise("other")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("company"), F.col("ts").cast("timestamp").alias("posted_at"),
        dept.alias("dept"),
    )


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(extract_domain("url").alias("host")).distinct()


def robots_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots rules for the hosts of even name length."""
    body = F.concat(
        F.lit("# rules\nUser-agent: badbot\nDisallow: /\n\nUser-agent: *\nCrawl-delay: 2\n"
              "Allow: /en/1\nDisallow: /en\nDisallow: /fr/"),
        (F.length("host") % 10).cast("string"),
        F.lit("\n"),
    )
    return _hosts(spark, sf_dir).filter(F.length("host") % 2 == 0).select(
        "host", body.alias("body")
    )


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hosts(spark, sf_dir).filter(F.length("host") % 2 == 0).select(
        F.col("host").alias("domain"),
        F.concat(F.lit("10.0.0."), F.length("host").cast("string")).alias("ip_address"),
    )


def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per document source; every third one failed."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    failed = number % 3 == 0
    return table(spark, sf_dir, "documents").select("source").distinct().select(
        "source",
        (~failed).alias("success"),
        F.when(failed, F.array(F.lit("page could not be read"))).otherwise(F.array())
        .cast("array<string>").alias("errors"),
        F.array().cast("array<string>").alias("warnings"),
        (number * 0.5).alias("execution_time"),
    )
