"""Registered queries: text, URL, date and collection functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadframe.functions import collections as C
from leadframe.functions import dates as D
from leadframe.functions import text as X
from leadframe.functions import urls as U
from leadframe.plans import sql as Q
from leadframe.plans.inputs import table

# names that exercise each suffix rule
_SUFFIXES = [" Inc", " Inc.", " LLC", " Ltd.", " Limited", " Corp", " Corporation", " Co.",
             " Company", " GmbH", " S.A.", " AG", " plc", " Inc Co", " Inc ", " Holding #1"]


def _named(spark, d):
    k = F.col("c_custkey")
    suffix = F.get(F.array(*[F.lit(s) for s in _SUFFIXES]), F.pmod(k, F.lit(16)).cast("int"))
    return table(spark, d, "customer").withColumn("name", F.concat("c_name", suffix))


_NAMED = f"(SELECT *, c_name || {Q.nth('c_custkey', [Q.lit(s) for s in _SUFFIXES])} AS name FROM customer)"


def x_domain(spark, d):
    bare = F.regexp_replace("url", "^https?://", "www.")
    return table(spark, d, "pages").select(
        "page_id", U.extract_domain("url").alias("domain"),
        U.extract_domain(bare).alias("domain_of_bare"),
        U.extract_domain(F.lit("")).alias("domain_of_empty"),
    )


def x_normalize_url(spark, d):
    slashed = F.concat(F.regexp_replace("url", "^https?://", ""), F.lit("//"))
    return table(spark, d, "pages").select(
        "page_id", U.normalize_url("url").alias("normalized"),
        U.normalize_url(slashed).alias("normalized_bare"),
    )


def x_validate_url(spark, d):
    k = F.pmod("page_id", F.lit(5))
    odd = (
        F.when(k == 0, F.replace("url", F.lit("://"), F.lit("://-")))
        .when(k == 1, F.concat("url", F.lit(" x")))
        .when(k == 2, F.regexp_replace("url", "^https?://", ""))
        .when(k == 3, F.lit("http://nodots/x"))
        .otherwise(F.lit(""))
    )
    return table(spark, d, "pages").select(
        "page_id", U.validate_url("url").alias("valid"), U.validate_url(odd).alias("valid_odd")
    )


def x_url_problem(spark, d):
    """What is wrong with forms of each address that a list of pages may hold."""
    k = F.col("page_id")
    bare = F.regexp_replace("url", "^https?://", "")
    forms = [
        F.col("url"),
        F.concat(F.lit("http://user:p%20w@"), bare),
        F.concat(F.lit("http://10.0."), (k % 300).cast("string"), F.lit(".1/x")),
        F.concat(F.lit("http://[2001:db8::"), F.lower(F.hex(k)), F.lit("]/")),
        F.concat(F.lit("http://example.com:"), (k * 977 % 90_000).cast("string"), F.lit("/a?b=c")),
        F.concat(F.lit("http://a@b@"), bare),
        F.concat(F.col("url"), F.lit("/{x}")),
        F.concat(F.lit("https://bücher"), k.cast("string"), F.lit(".example/é")),
        F.concat(F.lit("https://"), F.repeat(F.lit("x"), (k % 80).cast("int")), F.lit("y.com")),
    ]
    pages = table(spark, d, "pages").select("page_id", F.posexplode(F.array(*forms)).alias("form", "u"))
    return pages.select("page_id", "form", U.url_problem("u").alias("problem"))


def x_clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_text("text").alias("cleaned"))


def x_clean_company(spark, d):
    return _named(spark, d).select(
        F.col("c_custkey").alias("k"), X.clean_company_name("name").alias("company")
    )


def x_email_flag(spark, d):
    e = X.extract_email("text")
    return table(spark, d, "documents").select(
        "doc_id", e.isNotNull().alias("has_email"), X.mask_email(e).alias("masked")
    )


def x_phone_flag(spark, d):
    p = X.extract_phone("text")
    return table(spark, d, "documents").select(
        "doc_id", p.isNotNull().alias("has_phone"), X.mask_digits(p).alias("masked")
    )


def x_digits_int(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), X.digits_int("c_name").alias("from_name"),
        X.digits_int("c_mktsegment").alias("from_segment"),
        X.digits_int(F.concat(F.lit("1,"), F.col("c_acctbal").cast("bigint").cast("string"),
                              F.lit(" jobs"))).alias("from_jobs"),
    )


def x_float(spark, d):
    v = F.when(F.col("c_custkey") % 3 == 0, F.lit(" 4.5 ")).when(
        F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")
    ).otherwise(F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), X.float_or_null(v).alias("value")
    )


def x_url_canonical(spark, d):
    rest = F.regexp_extract("url", r"^https?://([\s\S]*)$", 1)
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    tail = F.regexp_extract(rest, r"^[^/?#]*([\s\S]*)$", 1)
    loud = F.concat(F.lit("HTTP://"), F.upper(host), F.lit(":80"), tail)
    return table(spark, d, "pages").select(
        "page_id", U.canonical_url("url").alias("canonical"),
        U.canonical_url(loud).alias("canonical_loud"),
        U.canonical_url(F.concat(F.lit("https://"), host, F.lit(":8443"))).alias("canonical_host"),
        U.canonical_url(F.concat(F.lit("ftp://"), host)).alias("not_http"),
    )


def x_url_resolve(spark, d):
    links = {
        "rooted": F.concat(F.lit("/c/"), F.col("page_id").cast("string")),
        "same_scheme": F.lit("//o.example.org/x"),
        "query": F.lit("?q=1"),
        "absolute": F.lit("https://o.example.org/a?b#c"),
        "mail": F.lit("mailto:a@example.org"),
        "sibling": F.concat(F.lit("x/y"), F.col("page_id").cast("string")),
        "parent": F.lit("/a/./b/../c"),
    }
    return table(spark, d, "pages").select(
        "page_id", *[U.resolve_url("url", v).alias(n) for n, v in links.items()]
    )


def x_search_url(spark, d):
    role = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment"))
    place = F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"),
        U.search_url(F.lit("https://d.example.com/companies"), role=role, location=place)
        .alias("address"),
    )


def x_title_case(spark, d):
    t = F.concat(F.lower("c_mktsegment"), F.lit("-cloud"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), X.title_name(t).alias("title")
    )


def x_show_prefix(spark, d):
    raw = F.concat(F.lit("Show HN: "), F.col("c_name"), F.lit(" - for "), F.lower("c_mktsegment"))
    parts = X.split_show_title(raw)
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), X.strip_show_prefix(X.clean_text(raw)).alias("stripped"),
        parts["name"].alias("split_name"), parts["description"].alias("split_description"),
    )


def x_chunk(spark, d):
    return C.chunk_rows(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k", 7)


def x_chunk_by(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id")
    return C.chunk_rows(events, "event_id", 5, by="user_id")


def x_chunk_array(spark, d):
    chunks = C.chunk_array(F.split("text", " "), 50)
    return table(spark, d, "documents").select(
        "doc_id", F.size(chunks).cast("bigint").alias("chunks"),
        F.array_join(F.element_at(chunks, -1), " ").alias("last_chunk"),
    )


def x_safe_get(spark, d):
    return table(spark, d, "events").select(
        "event_id", C.json_get("props", "k", default="none").alias("k"),
        C.json_get("props", "k", "deeper", default="none").alias("deeper"),
        C.json_get("props", "missing", default="0").alias("missing"),
    )


def x_format(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), D.iso_timestamp(at).alias("iso"),
        D.day_path(at).alias("day_path"), D.file_stamp(at).alias("stamp"),
        X.score_text("o_totalprice").alias("one_decimal"), X.round2("o_totalprice").alias("two"),
    )


def j_next_p(spark, d):
    """Per user, the value of the next purchase after each event."""
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    paid = F.when(F.col("event_type") == "purchase", F.col("value"))
    return C.next_value(events, "user_id", "event_id", paid, "next_paid").select(
        "event_id", "next_paid"
    )


QUERIES = {f.__name__: f for f in (
    x_domain, x_normalize_url, x_validate_url, x_url_problem, x_clean_text, x_clean_company, x_email_flag,
    x_phone_flag, x_digits_int, x_float, x_url_canonical, x_url_resolve, x_search_url,
    x_title_case, x_show_prefix, x_chunk, x_chunk_by, x_chunk_array, x_safe_get, x_format,
    j_next_p,
)}

_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
_TAIL = "regexp_extract(url, '^https?://[^/?#]*(.*)$', 1)"
_SCHEME = "regexp_extract(url, '^(https?)://', 1)"
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
_BARE = "regexp_replace(url, '^https?://', '')"
_ROOTED_TAIL = f"(CASE WHEN starts_with({_TAIL}, '/') THEN {_TAIL} ELSE '/' || {_TAIL} END)"
_VALID = (r"^https?://([a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+"
          r"[a-zA-Z][a-zA-Z0-9-]{1,62}([/?#]\S*)?$")
_ODD = f"""(CASE page_id % 5 WHEN 0 THEN replace(url, '://', '://-') WHEN 1 THEN url || ' x'
  WHEN 2 THEN {_BARE} WHEN 3 THEN 'http://nodots/x' ELSE '' END)"""
_RAW_SHOW = "('Show HN: ' || c_name || ' - for ' || lower(c_mktsegment))"

ORACLES = {
    "x_domain": f"""SELECT page_id, {Q.domain('url')} AS domain,
        {Q.domain("regexp_replace(url, '^https?://', 'www.')")} AS domain_of_bare,
        CAST(NULL AS VARCHAR) AS domain_of_empty FROM pages""",
    "x_normalize_url": f"""SELECT page_id, {Q.normalize('url')} AS normalized,
        {Q.normalize("(" + _BARE + " || '//')")} AS normalized_bare FROM pages""",
    "x_validate_url": f"""SELECT page_id, regexp_matches({Q.with_protocol('url')}, {Q.lit(_VALID)}) AS valid,
        CASE WHEN {_ODD} = '' THEN false
             ELSE regexp_matches({Q.with_protocol(_ODD)}, {Q.lit(_VALID)}) END AS valid_odd FROM pages""",
    "x_url_problem": """SELECT page_id, CAST(form AS INTEGER) AS form, CASE form
        WHEN 2 THEN CASE WHEN page_id % 300 > 255 THEN 'ipv4' END
        WHEN 3 THEN CASE WHEN page_id > 65535 THEN 'ipv6' END
        WHEN 4 THEN CASE WHEN page_id * 977 % 90000 NOT BETWEEN 1 AND 65535 THEN 'port' END
        WHEN 5 THEN 'user' WHEN 6 THEN 'path'
        WHEN 8 THEN CASE WHEN page_id % 80 + 1 > 63 THEN 'host' END END AS problem
        FROM pages, range(9) AS f(form)""",
    "x_clean_text": f"SELECT doc_id, {Q.clean('text')} AS cleaned FROM documents",
    "x_clean_company": f"SELECT c_custkey AS k, {Q.company('name')} AS company FROM {_NAMED}",
    "x_email_flag": f"""SELECT doc_id, {Q.email('text')} IS NOT NULL AS has_email,
        regexp_replace({Q.email('text')}, '^(.)[^@]*@', '\\1***@') AS masked FROM documents""",
    "x_phone_flag": f"""WITH p AS (SELECT doc_id, {Q.phone('text')} AS p FROM documents),
        cut AS (SELECT doc_id, p, length(regexp_extract(p, '[0-9][^0-9]*[0-9][^0-9]*$', 0)) AS tail FROM p)
        SELECT doc_id, p IS NOT NULL AS has_phone,
        regexp_replace(p[1:length(p) - tail], '[0-9]', '*', 'g') || p[length(p) - tail + 1:] AS masked
        FROM cut""",
    "x_digits_int": f"""SELECT c_custkey AS k, {Q.digits('c_name')} AS from_name,
        {Q.digits('c_mktsegment')} AS from_segment,
        {Q.digits("('1,' || CAST(trunc(c_acctbal) AS BIGINT) || ' jobs')")} AS from_jobs FROM customer""",
    "x_float": """SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 4.5::DOUBLE
        WHEN 1 THEN NULL ELSE c_nationkey::DOUBLE END AS value FROM customer""",
    "x_url_canonical": f"""SELECT page_id,
        {_SCHEME} || '://' || lower({_HOST}) || {_ROOTED_TAIL} AS canonical,
        'http://' || lower({_HOST}) || {_ROOTED_TAIL} AS canonical_loud,
        'https://' || lower({_HOST}) || ':8443/' AS canonical_host,
        CAST(NULL AS VARCHAR) AS not_http FROM pages""",
    "x_url_resolve": f"""SELECT page_id,
        {_SCHEME} || '://' || {_HOST} || '/c/' || page_id AS rooted,
        {_SCHEME} || '://o.example.org/x' AS same_scheme,
        {_SCHEME} || '://' || {_HOST} || {_PATH} || '?q=1' AS query,
        'https://o.example.org/a?b#c' AS absolute, 'mailto:a@example.org' AS mail,
        {_SCHEME} || '://' || {_HOST} || regexp_replace({_PATH}, '[^/]*$', '') || 'x/y' || page_id AS sibling,
        {_SCHEME} || '://' || {_HOST} || '/a/c' AS parent FROM pages""",
    "x_search_url": """SELECT c_custkey AS k, 'https://d.example.com/companies'
        || CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0
                THEN '?role=' || lower(c_mktsegment) || '&location=' || c_nationkey
                WHEN c_custkey % 2 = 0 THEN '?role=' || lower(c_mktsegment)
                WHEN c_custkey % 3 = 0 THEN '?location=' || c_nationkey ELSE '' END AS address
        FROM customer""",
    "x_title_case": """SELECT c_custkey AS k, c_mktsegment[1] || lower(c_mktsegment[2:]) || ' Cloud' AS title
        FROM customer""",
    "x_show_prefix": f"""SELECT c_custkey AS k,
        trim(regexp_replace({Q.clean(_RAW_SHOW)}, '(?i)show hn', '', 'g')) AS stripped,
        replace(c_name, '#', '') AS split_name, 'for ' || lower(c_mktsegment) AS split_description
        FROM customer""",
    "x_chunk": """SELECT c_custkey AS k,
        CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 7) AS BIGINT) AS batch_id FROM customer""",
    "x_chunk_by": """SELECT user_id, event_id, CAST(floor((row_number() OVER
        (PARTITION BY user_id ORDER BY event_id) - 1) / 5) AS BIGINT) AS batch_id FROM events""",
    "x_chunk_array": """WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents)
        SELECT doc_id, CAST(ceil(len(a) / 50.0) AS BIGINT) AS chunks,
        array_to_string(a[(CAST(ceil(len(a) / 50.0) AS BIGINT) - 1) * 50 + 1:], ' ') AS last_chunk FROM w""",
    "x_safe_get": """SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k,
        'none' AS deeper, '0' AS missing FROM events""",
    "x_format": f"""SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ||
        CASE WHEN microsecond(o_orderdate) % 1000000 = 0 THEN '' ELSE strftime(o_orderdate, '.%f') END AS iso,
        strftime(o_orderdate, '%Y/%m/%d') AS day_path, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp,
        CAST(round(CAST(o_totalprice AS DECIMAL(18,6)), 1) AS VARCHAR) AS one_decimal,
        {Q.round2('o_totalprice')} AS two FROM orders""",
    "j_next_p": """SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY event_id
              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_paid FROM events""",
}
