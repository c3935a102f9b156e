"""Listing extractors: declarative profiles over page nodes.

A profile names the card elements of a page and, per field, where inside the
card the value sits.  ``read_cards`` turns any profile into DataFrame
operations; the functions below map the raw fields to company records.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from leadframe import schema as S
from leadframe.functions.collections import null_to_empty
from leadframe.functions.dates import iso_timestamp
from leadframe.functions.text import (
    as_col,
    blank,
    clean_company_name,
    clean_text,
    digits_int,
    float_or_null,
    split_show_title,
    strip_show_prefix,
)
from leadframe.functions.urls import canonical_url, extract_domain, resolve_url
from leadframe.operators.union import page_position
from leadframe.sources.html import first_node, subtree, text_in, text_of, where, with_nodes

# --- fixed values: site roots of the profiles ----------------------------------
DIRECTORY_ROOT = "https://www.angellist.com"
LAUNCH_ROOT = "https://www.producthunt.com"
NEWS_ROOT = "https://news.ycombinator.com"


@dataclass(frozen=True)
class Selector:
    """An element test: tag, class token, class substring, attribute."""

    tag: str
    cls: str | None = None  # whole class token
    cls_has: str | None = None  # substring of a class token, any case
    attr: str | None = None  # attribute must exist
    value: str | None = None  # ... and equal this

    @property
    def test(self) -> str:
        """SQL predicate on a node ``n``."""
        parts = [f"n.tag = '{self.tag}'"]
        if self.cls is not None:
            parts.append(f"array_contains(n.classes, '{self.cls}')")
        if self.cls_has is not None:
            parts.append(f"exists(n.classes, c -> contains(lower(c), '{self.cls_has}'))")
        if self.value is not None:
            parts.append(f"coalesce(n.attrs['{self.attr}'] = '{self.value}', false)")
        elif self.attr is not None:
            parts.append(f"n.attrs['{self.attr}'] IS NOT NULL")
        return " AND ".join(parts)

    @property
    def literal(self) -> str | None:
        """Text every page with a match holds, unless it is entity-escaped."""
        return self.cls or self.cls_has or self.value


@dataclass(frozen=True)
class Field:
    """Value of the first element that matches any of the selectors in turn."""

    name: str
    selectors: tuple[Selector, ...]
    attr: str | None = None  # attribute to read; the text if None


@dataclass(frozen=True)
class Profile:
    cards: tuple[Selector, ...]  # the first one with any match on the page counts
    fields: tuple[Field, ...]
    max_cards: int | None = None  # per page

    @property
    def tags(self) -> frozenset[str]:
        used = [s.tag for s in self.cards]
        used += [s.tag for f in self.fields for s in f.selectors]
        return frozenset(used)


def page_guard(profile: Profile, html: str = "html") -> Column | None:
    """Cheap JVM test that a page can hold cards, before any Python runs."""
    literals = [c.literal for c in profile.cards]
    if any(x is None for x in literals):
        return None
    any_literal = "|".join(literals)
    return F.col(html).rlike(rf"(?i)(?:{any_literal})|(?:class|data-test)\s*=[^>]*&")


def read_cards(pages: DataFrame, profile: Profile, html: str = "html") -> DataFrame:
    """One row per card: page columns, ``card_pos``, card ``attrs``, raw fields.

    Each card carries only the slice of nodes below it, so the work per page
    grows with its size, not with cards times nodes.
    """
    guard = page_guard(profile, html)
    source = pages if guard is None else pages.filter(guard)
    keep = [c for c in pages.columns if c != html]
    nodes = F.col("nodes")
    chosen = None
    for selector in reversed(profile.cards):
        found = where(nodes, selector.test)
        chosen = found if chosen is None else F.when(F.size(found) > 0, found).otherwise(chosen)
    if profile.max_cards is not None:
        chosen = F.slice(chosen, 1, profile.max_cards)
    below = F.transform(
        chosen,
        lambda c: F.struct(
            c["pos"].alias("card_pos"),
            c["attrs"].alias("attrs"),
            subtree(nodes, c).alias("below"),
        ),
    )
    cards = with_nodes(source, profile.tags, html).select(*keep, F.explode(below).alias("c"))
    cards = cards.select(*keep, "c.card_pos", "c.attrs", "c.below")
    # one projection finds the elements, the next reads them
    hits = {f"_{f.name}": _pick(F.col("below"), f) for f in profile.fields}
    values = {}
    for f in profile.fields:
        hit = F.col(f"_{f.name}")
        if f.attr is not None:
            values[f.name] = hit["attrs"][f.attr]
        else:
            # 'below' starts one position after the card
            start = hit["pos"] - F.col("card_pos") + 1
            inner = F.slice("below", start, hit["end_pos"] - hit["pos"] + 1)
            values[f.name] = F.when(hit.isNotNull(), text_in(inner))
    return cards.withColumns(hits).select(
        *keep, "card_pos", "attrs", *[v.alias(n) for n, v in values.items()]
    )


def _pick(below: Column, f: Field) -> Column:
    return F.coalesce(*[first_node(below, s.test) for s in f.selectors])


# --- size bands ------------------------------------------------------------------

# fixed values: size bands (label, company size, employees), first match wins
STARTUP_BANDS = [
    ("1-10", "startup", 5),
    ("11-50", "small", 30),
    ("51-200", "medium", 125),
    ("201-1000", "large", 600),
    ("1000+", "enterprise", 2000),
]
AGENCY_BANDS = [
    ("10,000+", "enterprise", None),
    ("1,000 - 9,999", "enterprise", None),
    ("250 - 999", "large", None),
    ("50 - 249", "medium", None),
    ("10 - 49", "small", None),
    ("2 - 9", "startup", None),
]


def size_band(text: Column | str, bands: list, substring: bool = False) -> Column:
    """Struct (company_size, employee_count) of a size text.

    A label must stand on its own ('201-1000' is not '1-10').  ``substring``
    asks for plain containment in the cleaned text instead, where '201-1000'
    hits the first band and labels with '+' never match.
    """
    raw = as_col(text)
    size, count = None, None
    for label, name, employees in bands:
        if substring:
            hit = clean_text(raw).contains(label)
        else:
            quoted = "".join(f"\\{ch}" if ch in "+-.()" else ch for ch in label)
            hit = raw.rlike(rf"(?<![0-9,]){quoted}(?![0-9])")
        n = F.lit(employees).cast("bigint")
        size = F.when(hit, name) if size is None else size.when(hit, name)
        count = F.when(hit, n) if count is None else count.when(hit, n)
    return F.struct(
        size.otherwise("unknown").alias("company_size"), count.alias("employee_count")
    )


def location_parts(text: Column | str) -> Column:
    """Struct (city, country): first and last comma part; one part is a city."""
    loc = as_col(text)
    parts = F.split(loc, ",")
    return F.struct(
        F.when(~blank(loc), F.trim(F.get(parts, F.lit(0)))).alias("city"),
        F.when(~blank(loc) & (F.size(parts) >= 2), F.trim(F.element_at(parts, -1))).alias("country"),
    )


# --- profiles ----------------------------------------------------------------------

DIRECTORY_A = Profile(
    cards=(Selector("div", cls_has="company"),),
    fields=(
        Field("raw_name", (Selector("h2"), Selector("a", cls_has="name"))),
        Field("raw_description", (Selector("p"), Selector("div", cls_has="description"))),
        Field("link", (Selector("a", attr="href"),), attr="href"),
        Field("raw_location", (Selector("span", cls_has="location"),)),
        Field("raw_size", (Selector("span", cls_has="size"),)),
        Field("raw_jobs", (Selector("span", cls_has="job"),)),
    ),
)
DIRECTORY_B = Profile(
    cards=(Selector("li", cls="provider-row"),),
    fields=(
        Field("raw_name", (Selector("h3", cls="company_info"),)),
        Field("link", (Selector("a", cls="website-link"),), attr="href"),
        Field("raw_description", (Selector("p", cls="tagline"),)),
        Field("raw_location", (Selector("span", cls="locality"),)),
        Field("raw_rating", (Selector("span", cls="rating"),)),
        Field("raw_rate", (Selector("div", cls="hourly-rate"),)),
        Field("raw_size", (Selector("div", cls="employees"),)),
    ),
)
LAUNCH = Profile(
    cards=(
        Selector("div", attr="data-test", value="post-item"),
        Selector("article"),
        Selector("div", cls_has="post"),
    ),
    fields=(
        Field("raw_name", (Selector("h3"), Selector("a", cls_has="name"))),
        Field("raw_description", (Selector("p"), Selector("div", cls_has="tagline"))),
        Field("link", (Selector("a", attr="href"),), attr="href"),
        Field("raw_votes", (Selector("button", cls_has="vote"),)),
    ),
)


def _first(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def _clean_or_null(raw: str) -> Column:
    return F.when(F.col(raw).isNotNull(), clean_text(raw))


def _accept(df: DataFrame, name: Column, *urls: Column) -> DataFrame:
    """Rows a record can be built from: a name, and URLs that are URLs."""
    ok = F.length(name) >= 1
    for raw in urls:
        ok = ok & (raw.isNull() | canonical_url(raw).isNotNull())
    return df.filter(F.coalesce(ok, F.lit(False)))


def read_directory_a(
    pages: DataFrame,
    page_order: str = "page_id",
    max_companies: int | None = None,
    root: str = DIRECTORY_ROOT,
    substring_bands: bool = False,
) -> DataFrame:
    """Startup directory cards as company records."""
    raw = read_cards(pages, DIRECTORY_A).filter(clean_text("raw_name") != "")
    if max_companies is not None:
        pos = F.row_number().over(Window.partitionBy(page_order).orderBy("card_pos"))
        raw = raw.withColumn("_n", pos).filter(F.col("_n") <= max_companies)
    raw = raw.select(
        page_order, "card_pos",
        clean_company_name(clean_text("raw_name")).alias("name"),
        _clean_or_null("raw_description").alias("description"),
        resolve_url(F.lit(root), "link").alias("url"),
        location_parts(clean_text("raw_location")).alias("loc"),
        size_band(F.coalesce("raw_size", F.lit("")), STARTUP_BANDS, substring_bands).alias("size"),
        digits_int("raw_jobs").alias("jobs"),
    )
    return S.companies(
        _accept(raw, F.col("name"), F.col("url")),
        seq=page_position(page_order, "card_pos"),
        name=F.col("name"),
        description=F.col("description"),
        source="angellist",
        source_url=canonical_url("url"),
        enrichment=S.build(
            S.ENRICHMENT,
            company_size=F.col("size.company_size"),
            employee_count=F.col("size.employee_count"),
            geographic_info=S.build(
                S.GEOGRAPHIC_INFO, country=F.col("loc.country"), city=F.col("loc.city")
            ),
            hiring_intent=S.build(
                S.HIRING_INTENT,
                total_open_positions=F.col("jobs"),
                is_hiring=F.col("jobs") > 0,
            ),
            tags=F.array(F.lit("angellist"), F.lit("startup")),
        ),
    )


def read_directory_b(
    pages: DataFrame, page_order: str = "page_id", substring_bands: bool = False
) -> DataFrame:
    """Agency directory rows as company records."""
    raw = read_cards(pages, DIRECTORY_B).filter(clean_text("raw_name") != "")
    raw = raw.select(
        page_order, "card_pos",
        clean_company_name(clean_text("raw_name")).alias("name"),
        F.nullif("link", F.lit("")).alias("url"),
        _clean_or_null("raw_description").alias("description"),
        _clean_or_null("raw_location").alias("location"),
        float_or_null("raw_rating").alias("rating"),
        _clean_or_null("raw_rate").alias("rate"),
        size_band(F.coalesce("raw_size", F.lit("")), AGENCY_BANDS, substring_bands).alias("size"),
    )
    return S.companies(
        _accept(raw, F.col("name"), F.col("url")),
        seq=page_position(page_order, "card_pos"),
        name=F.col("name"),
        description=F.col("description"),
        source="clutch",
        source_url=canonical_url("url"),
        enrichment=S.build(
            S.ENRICHMENT,
            company_size=F.col("size.company_size"),
            geographic_info=S.build(S.GEOGRAPHIC_INFO, city=F.col("location")),
            tags=F.array(F.lit("agency"), F.lit("b2b-service")),
        ),
        extra_data=F.create_map(
            F.lit("rating"), F.col("rating").cast("string"), F.lit("hourly_rate"), F.col("rate")
        ),
    )


def read_launches(
    pages: DataFrame,
    page_order: str = "page_id",
    launch_date: str | None = None,
    max_products: int | None = None,
    root: str = LAUNCH_ROOT,
    max_cards: int | None = None,
) -> DataFrame:
    """Launch cards as company records; ``max_cards`` keeps the first cards of each page.

    ``max_products`` keeps the first rows over all pages in page order: a
    distributed top-n, not a global numbering.
    """
    raw = read_cards(pages, replace(LAUNCH, max_cards=max_cards)).withColumn("product_name", clean_text("raw_name"))
    link = F.col("link")
    day = F.lit(None).cast("string") if launch_date is None else iso_timestamp(launch_date)
    raw = raw.filter(F.col("product_name") != "").select(
        page_order, "card_pos", "product_name",
        clean_company_name("product_name").alias("name"),
        _clean_or_null("raw_description").alias("description"),
        F.when(link.startswith("/"), F.concat(F.lit(root), link)).otherwise(link).alias("url"),
        F.when(F.col("raw_votes").isNotNull(), digits_int("raw_votes"))
        .otherwise(F.lit(0)).alias("upvotes"),
        day.alias("launch_date"),
    )
    raw = _accept(raw, F.col("name"), F.col("url"))
    if max_products is not None:
        raw = raw.orderBy(page_order, "card_pos").limit(max_products)
    return S.companies(
        raw,
        seq=page_position(page_order, "card_pos"),
        name=F.col("name"),
        description=F.col("description"),
        source="product_hunt",
        source_url=canonical_url("url"),
        enrichment=S.build(
            S.ENRICHMENT,
            company_size="startup",
            tags=F.array(F.lit("product-hunt"), F.lit("new-launch")),
        ),
        extra_data=F.create_map(
            F.lit("launch_date"), F.col("launch_date"),
            F.lit("upvotes"), F.col("upvotes").cast("string"),
            F.lit("product_name"), F.col("product_name"),
        ),
    )


NEWS_ROW = Selector("tr", cls="athing")
TITLE_LINE = Selector("span", cls="titleline")
LINK = Selector("a")

NEWS = Profile(
    cards=(NEWS_ROW,),
    fields=(
        Field("title_line", (TITLE_LINE,)),
    ),
)


def read_news_board(
    pages: DataFrame, page_order: str = "page_id", root: str = NEWS_ROOT,
    split_titles: bool = False, max_rows: int | None = None,
) -> DataFrame:
    """News-board rows as company records; ``max_rows`` keeps the first rows of each page.

    ``split_titles`` reads name and description from 'Show HN: Name - Text'.
    """
    tags = NEWS.tags | {"a"}
    keep = [c for c in pages.columns if c != "html"]
    nodes = F.col("nodes")
    rows = F.transform(
        _first(where(nodes, NEWS_ROW.test), max_rows),
        lambda r: F.struct(
            r["pos"].alias("card_pos"), r["attrs"]["id"].alias("row_id"),
            subtree(nodes, r).alias("below"),
        ),
    )
    line = first_node(F.col("below"), TITLE_LINE.test)
    items = (
        with_nodes(pages.filter(page_guard(NEWS)), tags)
        .select(*keep, F.explode(rows).alias("r"))
        .select(*keep, "r.*")
        .withColumn("line", line)
        .filter(F.col("line").isNotNull())
        .withColumn("inner", _inside("line"))
        .withColumn("link", first_node(F.col("inner"), LINK.test))
        .filter(F.col("link").isNotNull())
    )
    link_text = text_in(
        F.slice("inner", F.col("link.pos") - F.col("line.pos") + 1,
                F.col("link.end_pos") - F.col("link.pos"))
    )
    items = items.select(
        page_order, "card_pos", "row_id",
        F.col("link.attrs")["href"].alias("url"),
        link_text.alias("raw_title"),
        F.coalesce(F.nullif(clean_text(link_text), F.lit("")), clean_text(text_in(F.col("inner"))))
        .alias("title"),
    )
    is_show = F.lower("title").contains("show hn")
    stripped = F.when(is_show, strip_show_prefix("title")).otherwise(F.col("title"))
    if split_titles:
        parts = split_show_title("raw_title")
        name = F.when(is_show, parts["name"]).otherwise(F.col("title"))
        description = F.when(is_show, parts["description"]).otherwise(F.lit(""))
    else:
        name, description = stripped, F.lit("")
    items = items.filter(F.col("row_id").isNotNull() & ~F.col("url").startswith("item?id="))
    items = items.withColumns({"name": name, "description": description})
    items = _accept(items, F.col("name"), F.col("url"))
    return S.companies(
        items,
        seq=page_position(page_order, "card_pos"),
        name=F.col("name"),
        domain=extract_domain("url"),
        website=canonical_url("url"),
        description=F.col("description"),
        source="job_boards",
        source_url=canonical_url(F.concat(F.lit(f"{root}/item?id="), F.col("row_id"))),
        enrichment=S.build(
            S.ENRICHMENT,
            tags=F.array(F.lit("hacker-news"), F.lit("show-hn")),
            hiring_intent=S.build(S.HIRING_INTENT, is_hiring=True),
        ),
    )


def _inside(node: str) -> Column:
    """Nodes below ``node`` where ``below`` starts one position after the card."""
    n = F.col(node)
    return F.slice("below", n["pos"] - F.col("card_pos") + 1, n["end_pos"] - n["pos"])


# --- generic listing -------------------------------------------------------------

# fixed values of the generic heuristics
HEADING_TAGS = ["h2", "h3", "h4"]
ITEM_WORDS = ["item", "card", "row", "listing"]
GENERIC_TAGS = frozenset(["h2", "h3", "h4", "a", "p", "div", "li", "tr"])


_ITEM_TEST = (
    "n.tag IN ('div', 'li') AND exists(n.classes, c -> c rlike '" + "|".join(ITEM_WORDS) + "')"
)


def _tagged(kind: int, elements: Column) -> Column:
    return F.call_function(
        "transform", elements, F.expr(f"e -> named_struct('kind', {kind}, 'e', e)")
    )


def _candidates(nodes: Column, elements: Column) -> Column:
    """Candidates (kind, name, href, description) of (kind, element) pairs.

    The name is the heading's text (kind 1) or the link's (2, 3); the description
    is the next paragraph after a heading or the first one inside an item.
    """
    with_link = F.transform(
        elements,
        lambda x: F.struct(
            x["kind"].alias("kind"), x["e"].alias("e"),
            first_node(subtree(nodes, x["e"]), LINK.test).alias("a"),
        ),
    )
    linked = F.call_function("filter", with_link, F.expr("x -> coalesce(x.a.attrs['href'], '') <> ''"))

    def candidate(x: Column) -> Column:
        named = F.when(x["kind"] == 1, x["e"]).otherwise(x["a"])
        told = F.when(x["kind"] == 1, F.get(nodes, x["e"]["next_p"])).when(
            x["kind"] == 2, first_node(subtree(nodes, x["e"]), "n.tag = 'p'")
        )
        return F.struct(
            x["kind"].alias("kind"),
            clean_text(text_in(subtree(nodes, named))).alias("name"),
            x["a"]["attrs"]["href"].alias("href"),
            text_of(nodes, told).alias("told"),
        )

    sizes = "CASE c.kind WHEN 1 THEN length(c.name) BETWEEN 3 AND 49 " \
            "WHEN 2 THEN length(c.name) > 0 ELSE length(c.name) > 5 END"
    return F.call_function("filter", F.transform(linked, candidate), F.expr(f"c -> {sizes}"))


def generic_candidates(
    pages: DataFrame, url: str = "url", html: str = "html",
    max_items: int | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Listing candidates of each page: headings, else items, else table rows.

    ``max_items`` and ``max_rows`` look at the first items and rows of a page only.
    """
    keep = [c for c in pages.columns if c != html]
    nodes = F.col("nodes")
    headings = F.concat(*[_tagged(1, where(nodes, Selector(t).test)) for t in HEADING_TAGS])
    others = F.concat(
        _tagged(2, _first(where(nodes, _ITEM_TEST), max_items)),
        _tagged(3, _first(where(nodes, "n.tag = 'tr'"), max_rows)),
    )
    first = with_nodes(pages, GENERIC_TAGS, html).withColumn("s1", _candidates(nodes, headings))
    # items and rows are only looked at where no heading qualified
    second = first.withColumn("s2", F.when(F.size("s1") == 0, _candidates(nodes, others)))
    found = second.select(*keep, F.when(F.size("s1") > 0, F.col("s1")).otherwise(F.col("s2")).alias("all"))
    best = F.call_function("transform", "all", F.expr("c -> c.kind"))
    found = found.withColumn("strategy", F.array_min(best))
    chosen = F.filter("all", lambda c: c["kind"] == F.col("strategy"))
    exploded = found.select(*keep, "strategy", F.posexplode(chosen).alias("ord", "c"))
    return exploded.select(
        *keep, "strategy", "ord", "c.name", resolve_url(url, "c.href").alias("link"),
        F.when(F.col("c.told").isNotNull(), clean_text("c.told")).alias("description"),
    )


def read_generic(
    pages: DataFrame, page_order: str = "page_id", url: str = "url",
    max_items: int | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Generic listing pages as company records; per page the first of a name.

    The winner per (page, name) is taken with an aggregation that combines on
    the map side, so a page that repeats one name costs nothing extra.
    """
    found = generic_candidates(
        pages.select(page_order, url, "html"), url, max_items=max_items, max_rows=max_rows
    )
    ok = _accept(found, F.col("name"), F.col("link"))
    first = ok.groupBy(page_order, "name").agg(
        F.min_by(F.struct("ord", "link", "description", url), "ord").alias("f")
    )
    flat = first.select(
        page_order, "name", F.col("f.ord").alias("card_pos"), F.col("f.link").alias("link"),
        F.col("f.description").alias("description"), F.col(f"f.{url}").alias("page_url"),
    )
    return S.companies(
        flat,
        seq=page_position(page_order, "card_pos"),
        name=F.col("name"),
        domain=extract_domain("link"),
        website=canonical_url("link"),
        description=F.col("description"),
        source="manual",
        source_url=canonical_url("page_url"),
        enrichment=S.build(S.ENRICHMENT, tags=F.array(F.lit("generic-scrape"))),
    )


# --- product detail pages -----------------------------------------------------------


def read_product_details(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Website, domain, makers and topics of product pages."""
    nodes = F.col("nodes")

    def marked(value: str) -> str:
        return Selector("a", attr="data-test", value=value).test

    def texts(value: str) -> Column:
        return F.transform(
            where(nodes, marked(value)), lambda n: clean_text(text_in(subtree(nodes, n)))
        )

    with_text = F.transform(
        where(nodes, "n.tag = 'a'"),
        lambda n: F.struct(n.alias("n"), F.lower(text_in(subtree(nodes, n))).alias("text")),
    )
    named = F.get(
        F.call_function("filter", with_text, F.expr("t -> contains(t.text, 'website')")), F.lit(0)
    )["n"]
    hit = F.coalesce(first_node(nodes, marked("website-link")), named)
    website = F.nullif(hit["attrs"]["href"], F.lit(""))
    keep = [c for c in pages.columns if c != html]
    return with_nodes(pages, ["a"], html).select(
        *keep,
        website.alias("website"),
        extract_domain(website).alias("domain"),
        texts("maker-link").alias("makers"),
        texts("topic-link").alias("topics"),
    )


def with_product_details(companies: DataFrame, details: DataFrame) -> DataFrame:
    """Fill website, domain and tags of launches from their detail pages."""
    d = details.select(
        canonical_url("url").alias("_u"), F.col("website").alias("_w"),
        F.col("domain").alias("_dom"), F.col("topics").alias("_topics"),
    )
    e = F.col("enrichment")
    joined = companies.join(d, companies.source_url == d["_u"], "left")
    tags = F.array_union(null_to_empty(e["tags"]), null_to_empty("_topics"))
    return joined.withColumns({
        "website": F.coalesce("website", canonical_url("_w")),
        "domain": F.coalesce("domain", "_dom"),
        "enrichment": F.when(e.isNotNull(), e.withField("tags", tags)),
    }).drop("_u", "_w", "_dom", "_topics")
