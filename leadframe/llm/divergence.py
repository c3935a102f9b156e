"""How far the sources of a language differ in their terms, from collapsed texts.

Equal texts of a language become one row with its number of copies per source; each is cut into
terms once, and its counts and document frequencies are added with these weights.  Partial sums
leave a task per language and term, so a hot text, source or term is few rows a task.

A pair of sources is the sum of ``(p - q)^2 / q`` over the terms its language keeps.  Only terms
that one of the two holds are visited; all others have the same two values and count as one
product.  Terms are dealt in buckets of about ``TERMS``, sources in tiles of ``TILE``, so no task
meets a whole language, and a task returns one sum a pair, not a row a term.  Sums are exact
integers: (p - q)^2 stays below 2^63 as p and q do not pass 10^9 + 1.

The result holds a row for each ordered pair of sources of a language, which bounds how many
sources a language may sensibly have.

Defined cases: null text, language and source count as empty strings; an empty or very long text
is one text like any other; repeated rows and equal texts count as often as they stand; a group
without terms still has its pairs; a language without kept terms has pairs of value 0 and no
terms; equal values rank by item in byte order; an empty table gives an empty result; ids and
further columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadframe.llm.common import small_batches, text_of
from leadframe.session import cut_lineage

#: Documents of its language that a kept term stands in; ranks of the term report.
MIN_DOCS, TOP_TERMS = 3, 200
#: Unit of the shares.
SCALE = 1_000_000_000
#: Terms of a bucket and sources of a tile, about.
TERMS, TILE = 2048, 256
#: Entries that a task gathers before it hands its partial sums on.
HELD = 500_000

#: Letters and all beyond ASCII, in lower-cased UTF-8.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def terms_of(text: str) -> list[bytes]:
    """Terms of a text in order; only A-Z are lower-cased."""
    return _TERM.findall(text.encode("utf-8", "surrogatepass").lower())


# --- collapse and counts -------------------------------------------------------------------------


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(text_of().alias("text"), text_of("lang").alias("lang"), text_of("source").alias("source"))


def collapsed(docs: DataFrame) -> DataFrame:
    """Each different text of a language once: (lang, hash, text, held: [(source, m)])."""
    rows = _rows(docs).withColumn("hash", F.unhex(F.sha2("text", 256)))
    copies = rows.groupBy("lang", "hash", "source").agg(F.count("*").alias("m"))
    held = copies.groupBy("lang", "hash").agg(F.collect_list(F.struct("source", "m")).alias("held"))
    return rows.groupBy("lang", "hash").agg(F.first("text").alias("text")).join(held, ["lang", "hash"])


_HELD = pa.struct([("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_SUMS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("held", pa.list_(_HELD))])


def _by_term(lang: str, sources: dict[str, tuple[dict, dict]]) -> pa.RecordBatch:
    """A row for each term of a language with the sums of all sources that hold it."""
    counts, docs = zip(*sources.values())
    terms = pa.array([t for c in counts for t in c], pa.binary()).dictionary_encode()
    order = np.argsort(terms.indices.to_numpy(), kind="stable")
    lengths = np.bincount(terms.indices.to_numpy(), minlength=len(terms.dictionary))
    source = np.repeat(np.arange(len(counts)), [len(c) for c in counts])[order]
    values = lambda dicts: pa.array([v for d in dicts for v in d.values()], pa.int64()).take(pa.array(order))
    held = pa.StructArray.from_arrays(
        [pa.array(list(sources), pa.string()).take(pa.array(source)), values(counts), values(docs)], fields=list(_HELD))
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    k = len(terms.dictionary)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * k, pa.string()), terms.dictionary.cast(pa.string()), pa.ListArray.from_arrays(offsets, held)],
        schema=_SUMS)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted counts and document frequencies of a task's texts, in bounded parts."""
    found: dict[str, dict[str, tuple[dict, dict]]] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for lang, sources in found.items():
            if sources:
                yield _by_term(lang, sources)
        found.clear()

    entries = 0
    for batch in batches:
        langs, texts, helds = (batch.column(c) for c in ("lang", "text", "held"))
        for k in range(batch.num_rows):
            inside = Counter(terms_of(texts[k].as_py()))
            sources = found.setdefault(langs[k].as_py(), {})
            for of in helds[k].as_py():
                m = of["m"]
                counts, docs = sources.setdefault(of["source"], ({}, {}))
                entries -= len(counts)
                for term, n in inside.items():
                    counts[term] = counts.get(term, 0) + n * m
                    docs[term] = docs.get(term, 0) + m
                entries += len(counts)
                if entries >= HELD:
                    yield from handed_on()
                    entries, sources = 0, found.setdefault(langs[k].as_py(), {})
    yield from handed_on()


def kept_terms(docs: DataFrame) -> DataFrame:
    """Kept terms of each language: (lang, term, total, held: [(source, n)])."""
    parts = collapsed(docs).select("lang", "text", "held").mapInArrow(
        _sums, "lang string, term string, held array<struct<source string, n long, docs long>>"
    )
    # all sums of a term meet once: the groupings below need no further shuffle
    rows = parts.repartition("lang", "term").select("lang", "term", F.inline("held"))
    sums = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return sums.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held")
    ).where(F.col("docs") >= MIN_DOCS).drop("docs")


# --- shares ----------------------------------------------------------------------------------------


def _share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + size)), without overflow or rounding."""
    big = lambda c: c.cast("decimal(19,0)")
    above = (big(count) + F.lit(1)) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", above, big(total) + big(size)) + F.lit(1)


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _groups(docs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Languages (lang, size, total) and groups (lang, source, id, total, zero, size, tiles).

    ``zero`` is the share of a term that the group lacks, null without kept terms.
    """
    langs = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("total").alias("lang_total"))
    totals = kept.select("lang", F.inline("held")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    found = _rows(docs).groupBy("lang", "source").agg(F.lit(0).alias("_")).drop("_")
    of_lang = Window.partitionBy("lang")
    groups = found.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.row_number().over(of_lang.orderBy("source")).alias("id"),
        F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("size", F.lit(0)).alias("size"), "lang_total",
        F.ceil(F.count("*").over(of_lang) / TILE).cast("int").alias("tiles"),
    )
    zero = F.when(F.col("size") > 0, _share(F.lit(0), F.col("total"), F.col("size")))
    return cut_lineage(langs), cut_lineage(groups.withColumn("zero", zero))


def _shares(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each source of a kept term: (lang, term, id, source, p, q), q of the language."""
    rows = kept.select("lang", "term", F.col("total").alias("in_lang"), F.inline("held"))
    return rows.join(groups, ["lang", "source"]).select(
        "lang", "term", "id", "source", "tiles", "size",
        _share(F.col("n"), F.col("total"), F.col("size")).alias("p"),
        _share(F.col("in_lang"), F.col("lang_total"), F.col("size")).alias("q"),
    )


# --- pairs -----------------------------------------------------------------------------------------

_PAIRS = pa.schema([("s", pa.int32()), ("t", pa.int32()), ("value", pa.int64()), ("seen", pa.int64())])


def _cell(rows: pa.Table, members: pa.Table) -> pa.Table:
    """Sums of a cell: terms of a bucket that a source of tile a holds, against tile b.

    For x of a and y of b: the pair (x, y) over the terms of x, and the pair (y, x) over the
    terms of x that y lacks; ``seen`` counts them.
    """
    ids = members.column("id").to_numpy()
    zero = members.column("zero").to_numpy()
    order = np.argsort(ids)
    ids, zero = ids[order], zero[order]
    first, second = (np.flatnonzero(members.column(c).to_numpy(zero_copy_only=False)[order]) for c in ("in_a", "in_b"))
    where = np.searchsorted(ids, rows.column("id").to_numpy())
    term = np.unique(rows.column("term").to_numpy(zero_copy_only=False), return_inverse=True)[1]
    width = int(term.max()) + 1 if len(term) else 0
    shares = np.repeat(zero[:, None], width, 1)
    shares[where, term] = rows.column("p").to_numpy()
    has = np.zeros(shares.shape, bool)
    has[where, term] = True
    out = []
    for x in first:
        at = np.flatnonzero(has[x])
        if not len(at):
            continue
        p, q, lacks = shares[x, at], shares[np.ix_(second, at)], ~has[np.ix_(second, at)]
        there = ((p - q) ** 2 // q).sum(1)
        back = np.where(lacks, (zero[second, None] - p) ** 2 // p, 0).sum(1)
        one, many = np.full(len(second), ids[x]), ids[second]
        out.append((one, many, there, np.full(len(second), len(at))))
        out.append((many, one, back, lacks.sum(1)))
    columns = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out) if out else [()] * 4)]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _PAIRS)], schema=_PAIRS)


def _pair_sums(shares: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, s, t, value, seen) over the terms that s or t holds."""
    buckets = langs.select("lang", F.ceil(F.col("size") / TERMS).cast("int").alias("buckets"))
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    rows = shares.join(buckets, "lang").withColumns({
        "bucket": F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"), "tile": F.col("id") % F.col("tiles"),
    })
    # a source goes to the cells (own tile, any) and (any, own tile)
    as_a = rows.select("lang", "bucket", F.col("tile").alias("a"), F.explode(others).alias("b"), "term", "id", "p")
    as_b = rows.select("lang", "bucket", F.explode(others).alias("a"), F.col("tile").alias("b"), "term", "id", "p")
    rows = as_a.unionByName(as_b.where("a <> b"))
    own = groups.where("size > 0").join(buckets, "lang").withColumns({
        "tile": F.col("id") % F.col("tiles"),
        "bucket": F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)),
    })
    own = own.withColumn("other", F.explode(others))
    as_a = own.select("lang", "bucket", F.col("tile").alias("a"), F.col("other").alias("b"), "id", "zero",
                      F.lit(True).alias("in_a"), (F.col("tile") == F.col("other")).alias("in_b"))
    as_b = own.where("tile <> other").select(
        "lang", "bucket", F.col("other").alias("a"), F.col("tile").alias("b"), "id", "zero",
        F.lit(False).alias("in_a"), F.lit(True).alias("in_b"))
    cell = ["lang", "bucket", "a", "b"]

    def sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = _cell(left, right)
        lang = pa.array([key[0].as_py()] * found.num_rows, pa.string())
        return found.add_column(0, "lang", lang)

    cells = rows.groupBy(*cell).cogroup(as_a.unionByName(as_b).groupBy(*cell)).applyInArrow(
        sums, "lang string, s int, t int, value long, seen long"
    )
    return cells.where("s <> t").groupBy("lang", "s", "t").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))


#: Parts in which the pairs of a language are made.
PARTS = 32


def _pairs(shares: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    one = groups.select("lang", "source", F.col("id").alias("s"), F.col("zero").alias("p"), "size",
                        (F.col("id") % PARTS).alias("part"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("id").alias("t"), F.col("zero").alias("q"),
                        F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    pairs = one.join(two, ["lang", "part"]).where("s <> t")
    sums = _pair_sums(shares, groups, langs)
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rest = (F.col("size") - none(F.col("seen"))) * _gap(F.col("p"), F.col("q"))
    value = none(F.col("value")) + none(rest)
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.join(sums, ["lang", "s", "t"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")
    ).withColumn("rank", ranked)


def audited(docs: DataFrame) -> DataFrame:
    """Pairs of sources and leading terms of each group: lang, source, part, item, value, rank."""
    small_batches(docs.sparkSession)
    kept = cut_lineage(kept_terms(docs))
    langs, groups = _groups(docs, kept)
    shares = cut_lineage(_shares(kept, groups))
    leading = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        _gap(F.col("p"), F.col("q")).alias("value"),
    ).withColumn("rank", leading).where(F.col("rank") <= TOP_TERMS)
    return _pairs(shares, groups, langs).unionByName(terms)


def sql() -> str:
    """The same report, each pair over all kept terms."""
    share = f"1 + (CAST({SCALE} AS HUGEINT) * (n + 1)) // (total + size)"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS size FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source
  GROUP BY ALL),
dense AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, total, size
  FROM groups JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (SELECT lang, source, term, n, {share} AS p FROM dense),
whole AS (
  SELECT lang, term, {share} AS q FROM (
    SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) JOIN (
    SELECT lang, sum(total) AS total FROM groups GROUP BY lang) USING (lang) JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q
  FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
