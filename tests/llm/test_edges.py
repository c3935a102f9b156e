"""Defined results for nulls, empty and long texts, repeats, empty tables, further columns."""

import pytest
from pyspark.sql import functions as F

from leadframe.llm import (
    fingerprint, main_text, mixing, ngram_join, packing, pii, quality_model, quality_rules, secrets, url_filter,
)

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as further columns of the input.
CLASH = ["rank", "length", "_words", "size", "node", "spans", "start", "kept", "n", "key", "cell", "_p", "c1"]
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
TEXTS = [None, "", "   \n\t ", "one two", "the of and " * 40, LONG, "mail me at a.b@c.org now", "é ü 日本語"]


def docs(spark, texts=TEXTS, clash=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({c: F.lit(1) for c in CLASH}) if clash else df


def labels(spark):
    return spark.createDataFrame([(4, 1), (5, 1), (6, 0)], "doc_id long, quality int")


OPERATORS = {
    "pii": lambda s, d: pii.found(d),
    "packing": lambda s, d: packing.packed(d),
    "fingerprint": lambda s, d: fingerprint.compared(d),
    "mixing": lambda s, d: mixing.rates(d, mixing.domains_of(d, labels(s))),
    "secrets": lambda s, d: secrets.scanned(d),
    "rules": lambda s, d: quality_rules.judged(d),
    "join": lambda s, d: ngram_join.joined(d),
    "model": lambda s, d: quality_model.scored(d),
}
STAGES = {
    "rules": lambda s, d: quality_rules.kept_documents(d),
    "join": lambda s, d: ngram_join.one_per_class(d),
    "pii": lambda s, d: pii.redacted(d),
    "mixing": lambda s, d: mixing.mixed(d, mixing.domains_of(d, labels(s))),
}


def keyed(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result_and_further_columns_do_not_matter(spark, name):
    plain = OPERATORS[name](spark, docs(spark))
    assert {r["doc_id"] for r in plain.select("doc_id").collect()} == set(range(len(TEXTS)))
    assert keyed(plain) == keyed(OPERATORS[name](spark, docs(spark, clash=True)))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["pii", "secrets", "rules", "model", "join", "packing", "fingerprint", "mixing"])
def test_null_ids_and_repeated_rows(spark, name):
    df = docs(spark, ["the same words here now and then again"] * 2 + ["x y", None])
    df = df.union(df).withColumn("doc_id", F.when(F.col("doc_id") > 1, F.col("doc_id")))
    got = OPERATORS[name](spark, df).collect()
    assert len(got) == 8
    assert sum(r["doc_id"] is None for r in got) == 4


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_and_take_empty_tables(spark, name):
    df = docs(spark, clash=True)
    out = STAGES[name](spark, df)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= set(range(len(TEXTS)))
    out.collect()
    assert STAGES[name](spark, docs(spark, [])).count() == 0


def test_pages_with_nulls(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://A.net/x", "<p>Hello there</p>"), (3, "no scheme", "<"), (3, "no scheme", "<")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("t"))
    got = main_text.extracted(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [
        (0, "Hello there", 11), (1, "", 0), (2, "", 0), (3, "<", 1), (3, "<", 1)]
    hosts = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages).collect()}
    assert hosts == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
                     (None, "a.net", "/x", "net/", "block")}
    none = pages.where("false")
    assert main_text.extracted(none).count() == url_filter.judged(none).count() == 0
