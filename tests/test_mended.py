"""Inputs on which results were once wrong, limits that must be asked for, and clean folders."""

import pytest
from pyspark.sql import functions as F

from leadframe import session
from leadframe.functions import dates, text
from leadframe.operators import enrich, robots, union, validate
from leadframe.sources import html, profiles, series


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("y")).first()["y"]


def allowed(spark, body, url, agent):
    urls = spark.createDataFrame([(url,)], "url string")
    texts = spark.createDataFrame([("x.com", body)], "host string, body string")
    return robots.allowed_urls(urls, texts, agent).first()["allowed"]


def test_robots_group_without_path_rules_is_a_group(spark):
    body = "User-agent: goodbot\nCrawl-delay: 1\n\nUser-agent: *\nDisallow: /"
    assert allowed(spark, body, "https://x.com/a", "goodbot")
    assert not allowed(spark, body, "https://x.com/a", "other")


@pytest.mark.parametrize("path", ["/caf%C3%A9/x", "/café/x"])
@pytest.mark.parametrize("rule", ["/caf%C3%A9", "/café"])
def test_robots_paths_compare_decoded(spark, rule, path):
    body = f"User-agent: *\nDisallow: {rule}"
    assert not allowed(spark, body, f"https://x.com{path}", "bot")
    assert allowed(spark, body, "https://x.com/caf", "bot")
    assert allowed(spark, "User-agent: *\nDisallow: /a%2Bb", "https://x.com/a b", "bot")


def test_white_space_of_any_kind_is_stripped(spark):
    assert one(spark, "\tAcme\xa0\n", text.strip_space) == "Acme"


def test_missing_pages_stop_a_series(spark):
    rows = [("a", 1, 5), ("a", 2, 5), ("a", 4, 5), ("b", 2, 5), ("c", 1, 5), ("c", 2, 0), ("c", 3, 5), ("d", 1, None), ("e", 1, 1)]
    df = spark.createDataFrame(rows, "s string, page int, n int")
    got = series.take_while_filled(df, "s", "page", "n").collect()
    assert sorted((r["s"], r["page"]) for r in got) == [("a", 1), ("a", 2), ("c", 1), ("e", 1)]


def test_iso_text_has_a_fraction_only_if_there_is_one(spark):
    iso = lambda c: dates.iso_timestamp(F.col(c).cast("timestamp"))
    assert one(spark, "2024-01-31 12:00:00", iso) == "2024-01-31T12:00:00"
    assert one(spark, "2024-01-31 12:00:00.5", iso) == "2024-01-31T12:00:00.500000"


def test_numbers_beyond_64_bits_are_null(spark):
    assert one(spark, "1" * 20, text.digits_int) is None
    assert one(spark, "none", text.digits_int) == 0


def test_titles_decode_all_references(spark):
    assert one(spark, "<title>A&ndash;B&#8211;&eacute;&amp;</title>", html.page_title) == "A–B–é&"


def test_a_company_stays_one_row_whatever_the_hiring_table(spark):
    rows = spark.createDataFrame([("a.com",)], "domain string")
    from leadframe import schema as S

    df = S.companies(rows, seq=F.lit(1), name=F.lit("A"), domain=F.col("domain"), source="manual")
    hiring = spark.createDataFrame([("a.com", 3), ("a.com", 7)], "domain string, n int").select(
        "domain", S.build(S.HIRING_INTENT, total_open_positions=F.col("n")).alias("hiring_intent"))
    got = enrich.hiring_enricher(hiring)(df).select("enrichment.hiring_intent.total_open_positions").collect()
    assert [r[0] for r in got] == [7]


def test_readers_limit_only_on_request(spark):
    cards = "".join(f'<div data-test="post-item"><h3>Name {i}</h3><a href="/posts/{i}"></a></div>' for i in range(30))
    news = "".join(f'<tr class="athing" id="{i}"><td><span class="titleline"><a href="https://h{i}.com/">T {i}</a></span></td></tr>' for i in range(30))
    table = "".join(f'<tr><td><a href="/r/{i}">Row number {i}</a></td></tr>' for i in range(80))
    page = lambda body: spark.createDataFrame([(1, "https://l.com/", body)], "page_id long, url string, html string")
    assert profiles.read_launches(page(cards)).count() == 30
    assert profiles.read_launches(page(cards), max_cards=20).count() == 20
    assert profiles.read_news_board(page(f"<table>{news}</table>")).count() == 30
    assert profiles.read_news_board(page(f"<table>{news}</table>"), max_rows=20).count() == 20
    assert profiles.read_generic(page(f"<table>{table}</table>")).count() == 80
    assert profiles.read_generic(page(f"<table>{table}</table>"), max_rows=50).count() == 50


def test_long_keys_do_not_travel(spark):
    df = spark.createDataFrame([(2, "x" * 50), (1, "x" * 50), (3, None), (4, None)], "seq long, name string")
    got = validate.first_per_key(df, "name").select("seq")
    assert sorted(r["seq"] for r in got.collect()) == [1, 3, 4]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "name" not in join


def test_no_folder_is_left_after_a_run(spark):
    import os

    session.cut_lineage(spark.range(3)).count()
    folder = session.work_dir(spark).removeprefix("file:")
    assert os.path.isdir(folder)
    session.release(spark)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("bad", [1 << 56, -1])
def test_positions_out_of_range_are_errors(spark, bad):
    whole = spark.createDataFrame([((1 << 56) - 1,)], "seq long")
    got = [r["seq"] for r in union.union_sources([whole, whole]).collect()]
    assert sorted(got) == [(1 << 56) - 1, (1 << 57) - 1]
    with pytest.raises(Exception, match="out of range"):
        union.union_sources([spark.createDataFrame([(bad,)], "seq long"), whole]).collect()
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(bad, 0)], "p long, k int").select(union.page_position("p", "k")).collect()
