"""Enrichment: technologies, size, region, address, hiring.

Each enricher is a function DataFrame -> DataFrame for ``DataFrame.transform``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadframe import schema as S
from leadframe.functions.text import blank, title_name
from leadframe.functions.urls import extract_domain, normalize_url
from leadframe.operators.detect import technologies_in

Enricher = Callable[[DataFrame], DataFrame]

# --- fixed values: technology signatures (regular expressions) --------------
SIGNATURES: dict[str, list[str]] = {
    "react": [r"react\.js", r"react-dom", r"_react", r"data-reactroot", r"data-reactid"],
    "vue": [r"vue\.js", r"vue\.min\.js", r"data-v-", r"__vue__"],
    "angular": [r"angular\.js", r"ng-app", r"ng-controller", r"@angular"],
    "jquery": [r"jquery\.js", r"jquery\.min\.js", r"jquery-[0-9]"],
    "svelte": [r"svelte", r"__svelte"],
    "django": [r"csrfmiddlewaretoken", r"django", r"__admin"],
    "flask": [r"flask", r"werkzeug"],
    "express": [r"express", r"x-powered-by.*express"],
    "rails": [r"rails", r"ruby on rails", r"csrf-param"],
    "laravel": [r"laravel", r"laravel_session"],
    "spring": [r"spring", r"jsessionid"],
    "wordpress": [r"wp-content", r"wp-includes", r"wordpress"],
    "shopify": [r"shopify", r"cdn\.shopify\.com"],
    "wix": [r"wix\.com", r"wixstatic"],
    "squarespace": [r"squarespace", r"sqsp"],
    "google-analytics": [r"google-analytics\.com", r"ga\.js", r"gtag"],
    "mixpanel": [r"mixpanel", r"cdn\.mxpnl\.com"],
    "segment": [r"segment\.com", r"analytics\.js"],
    "hotjar": [r"hotjar", r"static\.hotjar\.com"],
    "aws": [r"amazonaws\.com", r"cloudfront\.net", r"s3\.amazonaws"],
    "google-cloud": [r"googleapis\.com", r"gstatic\.com"],
    "azure": [r"azure", r"windows\.net"],
    "cloudflare": [r"cloudflare", r"cf-ray"],
    "mongodb": [r"mongodb", r"mongo"],
    "postgresql": [r"postgresql", r"postgres"],
    "mysql": [r"mysql"],
    "redis": [r"redis"],
    "webpack": [r"webpack"],
    "vite": [r"vite"],
    "parcel": [r"parcel"],
    "bootstrap": [r"bootstrap"],
    "tailwind": [r"tailwind"],
    "material-ui": [r"material-ui", r"mui"],
}

# --- fixed values: technology categories, first match wins -------------------
CATEGORIES: dict[str, list[str]] = {
    "languages": [],
    "frameworks": ["react", "vue", "angular", "django", "flask", "express", "rails",
                   "laravel", "spring", "svelte"],
    "databases": ["mongodb", "postgresql", "mysql", "redis"],
    "cloud_providers": ["aws", "google-cloud", "azure", "cloudflare"],
    "tools": ["webpack", "vite", "parcel", "jquery"],
    "analytics": ["google-analytics", "mixpanel", "segment", "hotjar"],
    "marketing": ["wordpress", "shopify", "wix", "squarespace", "bootstrap", "tailwind",
                  "material-ui"],
}

# --- fixed values: regions of countries --------------------------------------
REGIONS: dict[str, list[str]] = {
    "North America": ["USA", "United States", "US"],
    "Europe": ["UK", "United Kingdom", "Germany", "France"],
}


#: Patterns that are searched one by one in generated code.
PROBES = 200


def _literal(pattern: str) -> str | None:
    """The plain text a pattern stands for, or None if it is a real regex."""
    if re.search(r"(?<!\\)[.\[\](){}*+?^$|]", pattern):
        return None
    return pattern.replace("\\", "")


def _probes(patterns: list[str]) -> tuple[list[str], list[str]]:
    """Split patterns in substrings and regexes, dropping implied ones.

    A substring that contains another one of the same technology never adds a
    match, and neither does a regex that ends in one: fewer scans per page.
    """
    plain = [p for p in map(_literal, patterns) if p is not None]
    plain = [p for p in plain if not any(q != p and q in p for q in plain)]
    regexes = [p for p in patterns if _literal(p) is None]
    regexes = [p for p in regexes if not any(p.endswith(".*" + q) for q in plain)]
    return plain, regexes


def technology_present(text: Column, patterns: list[str]) -> Column:
    """Substring probes run on bytes in generated code; regexes only if needed."""
    plain, regexes = _probes(patterns)
    tests = [text.contains(p) for p in plain]
    if regexes:
        tests.append(text.rlike("|".join(f"(?:{p})" for p in regexes)))
    return reduce(Column.__or__, tests)


def detect_technologies(
    df: DataFrame,
    html: str = "html",
    headers: str | None = None,
    signatures: dict[str, list[str]] | None = None,
    column: str = "technologies",
) -> DataFrame:
    """Add the names of all technologies found in page text or headers.

    Meta and script passes would only re-search parts of the same text.  Up to ``PROBES`` patterns
    are probes in generated code, no UDF; more are one automaton that reads each page once.  No
    explode, no shuffle.
    """
    parts = [html] if headers is None else [html, headers]
    text = F.lower(F.concat_ws("\n", *parts))
    signatures = SIGNATURES if signatures is None else signatures
    if sum(map(len, signatures.values())) > PROBES:
        return df.withColumn(column, technologies_in(text, signatures))
    found = [
        F.when(technology_present(F.col("_text"), patterns), F.lit(name))
        for name, patterns in signatures.items()
    ]
    return (
        df.withColumn("_text", text)
        .withColumn(column, F.array_compact(F.array(*found)))
        .drop("_text")
    )


def categorize(technologies: Column) -> Column:
    """Technology names as the seven sorted category arrays."""
    taken: set[str] = set()
    arrays = {}
    for category, names in CATEGORIES.items():
        own = [n for n in names if n not in taken]
        taken.update(own)
        members = F.array(*[F.lit(n) for n in own]).cast("array<string>")
        hits = F.array_intersect(technologies, members)
        arrays[category] = F.array_sort(F.transform(hits, title_name))
    return S.build(S.TECH_STACK, **arrays)


def page_key(url: Column | str) -> Column:
    """Join key of a page address."""
    return normalize_url(url)


def tech_enricher(pages: DataFrame, url: str = "url", html: str = "html",
                  headers: str | None = None) -> Enricher:
    """Attach the tech stack of each company's web site.

    Pages are scanned where they lie and reduced to (address, technologies)
    before the join, so the shuffle carries names instead of HTML; several
    copies of an address are merged with a map-side combine.
    """

    def enrich(df: DataFrame) -> DataFrame:
        found = (
            detect_technologies(pages.filter(F.col(html).isNotNull()), html, headers)
            .select(page_key(url).alias("_page"), F.explode_outer("technologies").alias("_t"))
            .groupBy("_page")
            .agg(F.collect_set("_t").alias("_techs"))
        )
        address = F.when(~blank("website"), page_key("website")).when(
            ~blank("domain"), page_key(F.concat(F.lit("https://"), F.col("domain")))
        )
        joined = df.withColumn("_page", address).join(found, "_page", "left")
        enriched = S.ensure_enrichment().withField("tech_stack", categorize(F.col("_techs")))
        return joined.withColumn(
            "enrichment",
            F.when(F.col("_techs").isNotNull(), enriched).otherwise(F.col("enrichment")),
        ).drop("_page", "_techs")

    return enrich


def size_enricher(df: DataFrame) -> DataFrame:
    """Estimate an unknown size from the number of open positions."""
    e = S.ensure_enrichment()
    n = F.col("enrichment.hiring_intent.total_open_positions")
    guess = (
        F.when(n > 50, "large").when(n > 10, "medium").when(n != 0, "small")
        .otherwise("unknown")
    )
    size = F.col("enrichment.company_size")
    return df.withColumn("enrichment", e).withColumn(
        "enrichment",
        F.col("enrichment").withField(
            "company_size", F.when(size == "unknown", guess).otherwise(size)
        ),
    )


def region_enricher(df: DataFrame) -> DataFrame:
    """Region of the country, where it is a known spelling."""
    geo = F.col("enrichment.geographic_info")
    region = geo["region"]
    for name, countries in REGIONS.items():
        region = F.when(geo["country"].isin(countries), name).otherwise(region)
    return df.withColumn(
        "enrichment",
        F.when(
            geo.isNotNull(),
            F.col("enrichment").withField("geographic_info.region", region),
        ).otherwise(F.col("enrichment")),
    )


def address_enricher(dns: DataFrame) -> Enricher:
    """IP address from ``dns(domain, ip_address)`` into the extra data.

    No broadcast is forced: the resolution table grows with the data, so Spark
    decides by its size.
    """

    def enrich(df: DataFrame) -> DataFrame:
        key = F.when(~blank("domain"), F.col("domain")).otherwise(extract_domain("website"))
        known = dns.select(F.col("domain").alias("_d"), F.col("ip_address").alias("_ip"))
        known = known.groupBy("_d").agg(F.min("_ip").alias("_ip"))
        joined = df.withColumn("_d", key).join(known, "_d", "left")
        full = S.ensure_enrichment()
        with_geo = full.withField(
            "geographic_info", F.coalesce(full["geographic_info"], S.build(S.GEOGRAPHIC_INFO))
        )
        found = F.col("_ip").isNotNull()
        extra = F.coalesce(F.col("extra_data"), F.create_map().cast("map<string,string>"))
        others = F.map_filter(extra, lambda k, _: k != "ip_address")
        return joined.withColumns({
            "enrichment": F.when(found, with_geo).otherwise(F.col("enrichment")),
            "extra_data": F.when(
                found, F.map_concat(others, F.create_map(F.lit("ip_address"), F.col("_ip")))
            ).otherwise(F.col("extra_data")),
        }).drop("_d", "_ip")

    return enrich


def funding_enricher(df: DataFrame) -> DataFrame:
    """Only guarantees that an enrichment exists."""
    return df.withColumn("enrichment", S.ensure_enrichment())


def hiring_enricher(hiring: DataFrame | None = None, key: str = "domain") -> Enricher:
    """Keep a known hiring intent; otherwise take it from ``hiring(key, hiring_intent)``.

    Of several rows with one key, the one with the most open positions counts, so that a company
    stays one row.
    """

    def enrich(df: DataFrame) -> DataFrame:
        if hiring is None:
            return df
        found = hiring.select(F.col(key).alias("_k"), F.col("hiring_intent").alias("_h"))
        order = F.struct(F.coalesce("_h.total_open_positions", F.lit(0)), F.xxhash64("_h"))
        found = found.filter("_h IS NOT NULL").groupBy("_k").agg(F.max_by("_h", order).alias("_h"))
        joined = df.withColumn("_k", F.col(key)).join(found, "_k", "left")
        missing = F.col("enrichment.hiring_intent").isNull() & F.col("_h").isNotNull()
        return joined.withColumn(
            "enrichment",
            F.when(missing, S.ensure_enrichment().withField("hiring_intent", F.col("_h")))
            .otherwise(F.col("enrichment")),
        ).drop("_k", "_h")

    return enrich


ENRICH_ERRORS = "array<struct<enricher:string,error:string>>"


def row_enricher(name: str, function: Callable[[dict], dict]) -> Enricher:
    """Enricher of a user function that takes one lead and returns fields of its enrichment.

    A lead is a dictionary of all columns, nested ones as dictionaries.  A row whose call raises, or
    whose result does not have the enrichment's form, stays as it was and gets (name, error) in
    ``enrich_errors``; the others go on, in this enricher and the next ones.  The function runs in
    Arrow batches; its result is checked and merged in the JVM.
    """

    @F.pandas_udf("fields string, error string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for leads in batches:
            rows = []
            for lead in leads:
                try:
                    rows.append((json.dumps(function(json.loads(lead))), None))
                except Exception as e:  # whatever a user function raises concerns its row alone
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["fields", "error"], dtype=object)

    def enrich(df: DataFrame) -> DataFrame:
        if "enrich_errors" not in df.columns:
            df = df.withColumn("enrich_errors", F.array().cast(ENRICH_ERRORS))
        columns = [c for c in df.columns if c != "enrich_errors"]
        kept = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        full = S.ensure_enrichment()
        called = df.withColumn("_call", call(kept)).withColumn(
            "_new", F.from_json("_call.fields", S.ENRICHMENT, {"mode": "PERMISSIVE"})
        )
        # a field that was given and came out null has the wrong form
        given = F.from_json("_call.fields", "map<string,string>")
        wrong = reduce(Column.__or__, [
            F.coalesce(given[f].isNotNull() & F.col("_new")[f].isNull(), F.lit(False))
            for f in S.ENRICHMENT.fieldNames()
        ])
        unknown = F.exists(F.map_keys(given), lambda k: ~k.isin(S.ENRICHMENT.fieldNames()))
        bad = wrong | F.coalesce(unknown, F.lit(False)) | (F.col("_call.error").isNull() & given.isNull())
        error = F.coalesce("_call.error", F.when(bad, F.concat(F.lit("no valid enrichment: "), F.col("_call.fields"))))
        merged = full
        for f in S.ENRICHMENT.fieldNames():
            merged = merged.withField(f, F.coalesce(F.col("_new")[f], full[f]))
        return called.withColumn("_error", error).withColumns({
            "enrichment": F.when(F.col("_error").isNull(), merged).otherwise(F.col("enrichment")),
            "enrich_errors": F.when(F.col("_error").isNull(), F.col("enrich_errors")).otherwise(F.concat(
                "enrich_errors", F.array(F.struct(F.lit(name).alias("enricher"), F.col("_error").alias("error")))
            )),
        }).drop("_call", "_new", "_error")

    return enrich


def enrich_all(df: DataFrame, enrichers: list[Enricher]) -> DataFrame:
    """Apply enrichers in order."""
    return reduce(lambda d, f: d.transform(f), enrichers, df)
