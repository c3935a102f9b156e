"""Quality rules: one table of thresholds, compiled into one Spark projection.

Every measure is a count from built-in functions, every rule compares two counts as
integers, so the verdict needs no user function and no rounding.

Defined cases: a null text counts as empty (no words, fails the length rule); repeated
rows and equal texts get equal verdicts; an empty table gives an empty result; further
columns of the input stay out of ``judged`` and untouched in ``kept_documents``.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import text_of, words_of

#: Words of a window that counts as repeated when the text holds it again.
WINDOW = 8

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# --- fixed values: frequent function words of four languages --------------------
STOP_WORDS = {
    "en": "the of and to in is that it for on with as be by this are was or an at from not",
    "fr": "le la les de des du et un une que qui dans pour par sur est au aux ne pas plus",
    "de": "der die das und von zu mit den ist im auf für nicht ein eine dem als auch es",
    "es": "el los las del y que en un una por con no se su para al lo como más",
}


class Rule(NamedTuple):
    """A text passes if ``low <= 100 * measure / per <= high`` (either may be open)."""

    name: str
    measure: str
    per: str | None
    low: int | None
    high: int | None
    from_words: int = 0  # the rule holds for texts of so many words


#: The first two are the base; a text that fails them is out whatever else holds.
BASE = [
    Rule("length", "n_words", None, 20, None),
    Rule("repeated words", "n_repeat_words", "n_words", None, 30),
]
RULES = [
    Rule("mean word length", "word_chars", "n_words", 200, 1500, 20),
    Rule("symbols", "n_symbols", "n_words", None, 20),
    Rule("exclamation marks", "n_bangs", "n_words", None, 30),
    Rule("capitals", "n_capitals", "word_chars", None, 40),
    Rule("stop words", "n_stop", "n_words", 1, None, 100),
    Rule("equal lines", "n_dup_lines", "n_lines", None, 60),
]


def _how_many(text: Column, chars: str) -> Column:
    """How many of these characters a text holds."""
    return F.length(F.regexp_replace(text, f"[^{re.escape(chars)}]+", "")).cast("long")


def _repeated(words: Column, n: Column, windows: Column) -> Column:
    """Start positions of windows with their words, sorted by words; [] without copies."""
    starts = F.sequence(F.lit(0), n - WINDOW)
    pairs = F.transform(
        starts, lambda i: F.struct(F.slice(words, i + 1, WINDOW).alias("w"), i.alias("p"))
    )
    return F.when(F.size(windows) > F.size(F.array_distinct(windows)), F.sort_array(pairs))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """All measures of each row, beside the input's columns.

    Copies of windows are found by hash first; only texts with such a copy compare the
    words themselves.  The number of the partition, ``_part``, keeps filters above the measures:
    pushed below, one would hold a copy of each measure wherever the next one mentions it.
    """
    m = docs.withColumn("_text", text_of(text))
    m = m.withColumn("_words", words_of(F.col("_text"))).withColumn(
        "_lines",
        F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    )
    words, n = F.col("_words"), F.size("_words")
    stop = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    m = m.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": _how_many(F.col("_text"), SYMBOLS),
        "n_bangs": _how_many(F.col("_text"), "!"),
        "n_capitals": _how_many(F.col("_text"), CAPITALS),
        "n_stop": F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(0), n - WINDOW),
                        lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW))),
        ),
    })
    m = m.withColumn("_sorted", _repeated(words, n, F.col("_windows")))
    near = lambda k, x: F.coalesce(F.get(F.col("_sorted"), k)["w"] == x["w"], F.lit(False))
    copies = F.filter("_sorted", lambda x, k: near(k - 1, x) | near(k + 1, x))
    m = m.withColumn("_at", F.sort_array(F.transform(copies, lambda x: x["p"])))
    covered = F.transform(
        "_at",
        lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(WINDOW))),
    )
    repeat = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    m = m.withColumns({
        "n_repeat_words": F.coalesce(repeat, F.lit(0).cast("long")), "_part": F.spark_partition_id(),
    })
    return m.drop("_text", "_words", "_lines", "_windows", "_sorted", "_at")


def _fails(rule: Rule) -> Column:
    value, per = F.col(rule.measure), F.lit(1) if rule.per is None else F.col(rule.per)
    scale = 1 if rule.per is None else 100
    tests = []
    if rule.low is not None:
        tests.append(value * scale < per * rule.low)
    if rule.high is not None:
        tests.append(value * scale > per * rule.high)
    return reduce(Column.__or__, tests) & (F.col("n_words") >= rule.from_words)


def judged(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Measures and verdict of every row: doc_id, counts, base_failed, kept."""
    m = measured(docs.select("doc_id", F.col(text).alias("text")))
    failed = lambda rs: reduce(Column.__or__, [_fails(r) for r in rs], F.col("_part") < 0)
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed(BASE).alias("base_failed"), (~failed([*BASE, *rules])).alias("kept"),
    )


def kept_documents(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass base and rules, all columns as they were."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    m = measured(inner, names[docs.columns.index(text)])
    failed = reduce(Column.__or__, [_fails(r) for r in [*BASE, *rules]], F.col("_part") < 0)
    return m.filter(~failed).select(*names).toDF(*docs.columns)


def _sql_fails(rules: list[Rule]) -> str:
    tests = []
    for r in rules:
        per, scale = r.per or "1", 1 if r.per is None else 100
        bounds = [f"{r.measure} * {scale} < {per} * {r.low}"] * (r.low is not None)
        bounds += [f"{r.measure} * {scale} > {per} * {r.high}"] * (r.high is not None)
        tests.append(f"(n_words >= {r.from_words} AND ({' OR '.join(bounds)}))")
    return " OR ".join(tests)


def sql(rules: list[Rule] = RULES) -> str:
    """The same verdicts as one statement, by unnesting words and lines."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for s in STOP_WORDS.values() for w in s.split()}))
    grams = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER text" for k in range(1, WINDOW))])
    gone = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))"
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p
  FROM (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM texts)),
counts AS (
  SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars,
    count(*) FILTER (WHERE lower(w) IN ({stop})) AS n_stop FROM words GROUP BY r),
windows AS (
  SELECT r, p, {grams} AS s FROM words WINDOW text AS (PARTITION BY r ORDER BY p)),
twice AS (
  SELECT r, p FROM (
    SELECT r, p, count(*) OVER (PARTITION BY r, s) AS c FROM windows WHERE s IS NOT NULL)
  WHERE c > 1),
covered AS (
  SELECT r, sum(least({WINDOW}, coalesce(nxt - p, {WINDOW}))) AS n_repeat_words FROM (
    SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM twice) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM texts)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
measures AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words,
    CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, coalesce(n_stop, 0) AS n_stop,
    {gone(SYMBOLS)} AS n_symbols, {gone('!')} AS n_bangs, {gone(CAPITALS)} AS n_capitals,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM texts LEFT JOIN counts USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  {_sql_fails(BASE)} AS base_failed, NOT ({_sql_fails([*BASE, *rules])}) AS kept
FROM measures"""
