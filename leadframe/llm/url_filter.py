"""URL filter: a broadcast trie over reversed host labels and path segments.

The most specific rule that fits a URL decides: more host labels first, then more of the
path; between an allow and a block entry of the same host and path, block wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no
rule; an empty host label is a label like any other; repeated rows get equal verdicts;
an empty table or an empty rule list gives the default verdict for each row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadframe.llm.common import small_batches

#: Largest rule list that is broadcast; a longer one is refused, not cut.
MAX_RULES = 200_000


class Entry(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str  # begins with /, or is empty: the whole host

    @property
    def rule(self) -> str:
        return self.host + self.path


#: Rules of the registered query.
RULES = [
    Entry("block", "net", "/"),
    Entry("allow", "example.net", "/en/"),
    Entry("block", "example.com", "/de/"),
    Entry("allow", "org", "/fr/"),
]

_HOST = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class _Node:
    """A trie node: children by label, then by path segment, and what ends here."""

    __slots__ = ("labels", "segments", "tails")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}
        self.segments: dict[str, _Node] = {}
        self.tails: list[tuple[str, str, str]] = []  # (rest of a segment, rule, verdict)


def build(rules: Iterable[Entry]) -> _Node:
    """Trie of the rules; a path that stops inside a segment leaves that part as a tail."""
    root = _Node()
    for e in sorted(set(rules), key=lambda e: (e.host, e.path, e.verdict == "block")):
        node = root
        for label in reversed(e.host.translate(_LOWER).split(".")):
            node = node.labels.setdefault(label, _Node())
        parts = e.path.split("/")
        for part in parts[:-1]:
            node = node.segments.setdefault(part, _Node())
        node.tails = [t for t in node.tails if t[0] != parts[-1]]
        node.tails.append((parts[-1], e.rule, e.verdict))
        node.tails.sort(key=lambda t: -len(t[0]))
    return root


def split_url(url: str | None) -> tuple[str, str]:
    found = _HOST.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def longest(root: _Node, host: str, path: str) -> tuple[str, str] | None:
    """Rule and verdict of the longest match: deepest host node first, then deepest path."""
    node, hosts = root, []
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        hosts.append(node)
    parts = path.split("/")
    for node in reversed(hosts):
        best = None
        for part in parts:
            best = next((t[1:] for t in node.tails if part.startswith(t[0])), best)
            node = node.segments.get(part)
            if node is None:
                break
        if best:
            return best
    return None


def judged(
    pages: DataFrame, rules: Iterable[Entry] = RULES, default: str = "allow", url: str = "url"
) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every page."""
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the broadcast trie takes {MAX_RULES}")
    spark = pages.sparkSession
    small_batches(spark)
    entries = spark.sparkContext.broadcast([tuple(e) for e in rules])
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])

    @F.pandas_udf(kind)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        root = build(Entry(*e) for e in entries.value)
        for urls in batches:
            rows = []
            for u in urls:
                host, path = split_url(u)
                rows.append((host, path, *(longest(root, host, path) or (None, default))))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"], dtype=object)

    return pages.select("page_id", judge(F.col(url).cast("string")).alias("j")).select("page_id", "j.*")


def sql(rules: Iterable[Entry] = RULES, default: str = "allow") -> str:
    """The longest fitting rule by a join of all pages with the rule list."""
    values = ", ".join(f"('{e.host}', '{e.path}', '{e.rule}', '{e.verdict}')" for e in rules)
    return f"""
WITH cut AS (
  SELECT row_number() OVER () AS r, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT r, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT r, rule, verdict, row_number() OVER (
    PARTITION BY r ORDER BY length(h) DESC, length(p) DESC, verdict DESC) AS k
  FROM parts JOIN (VALUES {values}) AS rules(h, p, rule, verdict)
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (r)"""
