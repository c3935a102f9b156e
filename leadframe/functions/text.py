"""Text functions as Spark columns.

Every function takes a column (or its name) and returns a column, so that
Catalyst sees plain expressions and no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s is ASCII only; this class is the Unicode white space that a text
# split on blanks would use.
WHITESPACE = r"\s\p{Z}\x{85}\x1c-\x1f"

# --- fixed values: legal suffixes, removed once each, in this order ---------
LEGAL_SUFFIXES = [
    r"Inc\.?",
    r"LLC\.?",
    r"Ltd\.?",
    r"Limited",
    r"Corp\.?",
    r"Corporation",
    r"Co\.?",
    r"Company",
    r"GmbH",
    r"S\.A\.?",
    r"AG",
    r"PLC",
]

# --- fixed values: contact patterns -----------------------------------------
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERN = (
    r"[\+]?[(]?[0-9]{1,4}[)]?[-\s\.]?[(]?[0-9]{1,4}[)]?[-\s\.]?"
    r"[0-9]{1,4}[-\s\.]?[0-9]{1,9}"
)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """True for null and for the empty string."""
    c = as_col(c)
    return c.isNull() | (c == "")


def clean_text(c: Column | str) -> Column:
    """Collapse white space, drop special characters, trim; null gives ''."""
    collapsed = F.trim(F.regexp_replace(as_col(c), f"[{WHITESPACE}]+", " "))
    kept = F.regexp_replace(collapsed, r"[^\p{L}\p{N}_ \-.,!?()&]", "")
    return F.coalesce(F.trim(kept), F.lit(""))


def clean_company_name(c: Column | str) -> Column:
    """Remove each legal suffix at most once, in order, then clean the text."""
    name = as_col(c)
    for suffix in LEGAL_SUFFIXES:
        name = F.regexp_replace(name, rf"(?i)[{WHITESPACE}]+{suffix}(?=\n?\z)", "")
    return clean_text(name)


def _first_match(c: Column | str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(as_col(c), pattern, 0), F.lit(""))


def extract_email(c: Column | str) -> Column:
    """First e-mail address in the text, or null."""
    return _first_match(c, "(?U)" + EMAIL_PATTERN)


def extract_phone(c: Column | str) -> Column:
    """First phone-like number in the text, or null."""
    return _first_match(c, PHONE_PATTERN.replace(r"\s", WHITESPACE))


def mask_email(c: Column | str) -> Column:
    """``info@example.com`` becomes ``i***@example.com``: safe to store."""
    return F.regexp_replace(as_col(c), r"^(.)[^@]*@", "$1***@")


def mask_digits(c: Column | str) -> Column:
    """All digits but the last two become ``*``."""
    return F.regexp_replace(as_col(c), r"[0-9](?=(?:[^0-9]*[0-9]){2})", "*")


def digits_int(c: Column | str) -> Column:
    """The digits 0 to 9 of a text as one number: '1,234 jobs' is 1234, none is 0.

    A number beyond 64 bits is null, not a wrong number.
    """
    digits = F.coalesce(F.regexp_replace(as_col(c), "[^0-9]", ""), F.lit(""))
    return F.when(digits == "", F.lit(0).cast("bigint")).otherwise(digits.try_cast("bigint"))


def strip_space(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(as_col(c), f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def float_or_null(c: Column | str) -> Column:
    return strip_space(c).try_cast("double")


def title_name(c: Column | str) -> Column:
    """'google-cloud' becomes 'Google Cloud'."""
    return F.initcap(F.replace(as_col(c), F.lit("-"), F.lit(" ")))


def strip_show_prefix(c: Column | str) -> Column:
    """Remove the 'Show HN' marker of a news-board title, in any case."""
    return F.trim(F.regexp_replace(as_col(c), "(?i)show hn", ""))


def split_show_title(c: Column | str) -> Column:
    """Name and description of a raw title 'Show HN: Name - Description'.

    The cleaned title never holds a colon, so the default extraction only
    strips the marker; this variant reads the raw title instead.
    """
    raw = as_col(c)
    marked = F.lower(raw).contains("show hn")
    rest = F.regexp_extract(raw, r"^[^:]*:\s*([\s\S]*)$", 1)
    has_colon = marked & raw.contains(":")
    name = F.when(has_colon, F.trim(F.regexp_extract(rest, r"^([^-]*)", 1))).otherwise(
        strip_show_prefix(raw)
    )
    tail = F.when(has_colon, F.trim(F.regexp_extract(rest, r"^[^-]*-([\s\S]*)$", 1)))
    return F.struct(
        clean_text(name).alias("name"),
        clean_text(F.coalesce(tail, F.lit(""))).alias("description"),
    )


def round2(c: Column | str) -> Column:
    """Two decimals through a decimal, so that every engine rounds alike."""
    return F.round(as_col(c).cast("decimal(18,6)"), 2).cast("double")


def score_text(c: Column | str) -> Column:
    """One decimal, 'N/A' when there is no value."""
    return F.coalesce(
        F.round(as_col(c).cast("decimal(18,6)"), 1).cast("string"), F.lit("N/A")
    )
