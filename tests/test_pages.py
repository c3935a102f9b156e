from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from leadframe.operators.robots import allowed_urls
from leadframe.sources import payloads as J
from leadframe.sources import profiles as P
from leadframe.sources.html import html_nodes, page_title, read_page, text_in


def pages(spark, *htmls):
    rows = [(i, "https://site.example.com/dir/page", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def shape(nodes):
    return [(n[0], n[1], n[3]) for n in nodes]


def test_nodes_are_intervals_in_document_order():
    html = "<div class='a B'><p>one<p>two<br>x</div><ul><li>1<li>2</ul><script>var t='</p>';</script>"
    nodes = read_page(html)
    assert shape(nodes) == [
        (0, 6, "div"), (1, 2, "p"), (2, 2, "#text"), (3, 6, "p"), (4, 4, "#text"), (5, 5, "br"),
        (6, 6, "#text"), (7, 11, "ul"), (8, 9, "li"), (9, 9, "#text"), (10, 11, "li"),
        (11, 11, "#text"), (12, 12, "script"),
    ]
    assert nodes[0][4] == ["a", "B"] and nodes[0][7] == 1 and nodes[1][7] == 3
    assert read_page(None) == [] and read_page("") == []


def test_kept_tags_limit_the_nodes():
    nodes = read_page("<div>x<b>y<a href='/z?a=1&amp;b=2'>t&eacute;</a></b></div>", frozenset(["a"]))
    assert shape(nodes) == [(0, 1, "a"), (1, 1, "#text")]
    assert nodes[0][5] == {"href": "/z?a=1&b=2"} and nodes[1][6] == "té"


def test_broken_markup_keeps_all_text(spark):
    html = "<html><body><b>open<br><p>text &amp; more</i></p><table><tr><td>1<td>2<tr><td>3</table>"
    got = pages(spark, html).select(text_in(html_nodes("html")).alias("t")).first()["t"]
    assert got == "opentext & more123"
    assert pages(spark, "<TITLE>a &lt;b&gt;</TITLE>").select(page_title("html").alias("t")).first().t == "a <b>"


def test_generic_uses_one_strategy_per_page(spark):
    df = pages(
        spark,
        "<h3><a href='/three'>Third name</a></h3><p>c</p><h2><a href='two'>Second name</a></h2>"
        "<div><p>d &amp; e</p></div><h2><a href='/dup'>Second name</a></h2><h2>No link</h2>"
        "<li class='card'><a href='/x'>Not used</a></li>",
        "<div class='listing-row'><a href='../up'>Item one</a><p>text</p></div>"
        "<li class='big item'><a>no target</a></li><h2><a href='/s'>ab</a></h2>",
        "<table><tr><td><a href='//o.example.org/1'>Table row</a><tr><td><a href='/2'>tiny</a></table>",
        "<h2><a href='mailto:a@example.com'>Mail only</a></h2>",
    )
    got = {r["seq"]: (r["name"], r["website"], r["description"]) for r in P.read_generic(df).collect()}
    assert [got[k] for k in sorted(got)] == [
        ("Second name", "https://site.example.com/dir/two", "d & e"),
        ("Third name", "https://site.example.com/three", "c"),
        ("Item one", "https://site.example.com/up", "text"),
        ("Table row", "https://o.example.org/1", None),
    ]


def test_directory_a_fallbacks(spark):
    df = pages(
        spark,
        "<div class='big Company-card'><a class='Name-x' href='/c/1'>Acme Inc.</a>"
        "<div class='description'>Does things</div><span class='job-count'>no jobs</span></div>"
        "<div class='company'><p>nameless</p></div>",
    )
    r = P.read_directory_a(df).collect()
    assert len(r) == 1
    e = r[0]["enrichment"]
    assert (r[0]["name"], r[0]["description"]) == ("Acme", "Does things")
    assert r[0]["source_url"] == "https://www.angellist.com/c/1"
    assert (e.company_size, e.employee_count, e.hiring_intent.is_hiring) == ("unknown", None, False)


def test_directory_a_cap_counts_named_cards(spark):
    cards = "".join(f"<div class='company'><h2>N{i}</h2></div>" for i in range(5))
    df = pages(spark, cards, cards)
    assert P.read_directory_a(df, max_companies=3).count() == 6
    assert P.read_directory_a(df, max_companies=None).count() == 10


def test_news_board(spark):
    row = "<tr class='athing'{}><td><span class='titleline'>{}</span></td></tr>"
    df = pages(spark, "<table>" + "".join([
        row.format(" id='7'", "<a href='https://a.example.com/x'>Show HN: Tool - fast</a>"),
        row.format(" id='8'", "<a href='item?id=8'>Ask: internal</a>"),
        row.format(" id='9'", "no link"),
        row.format("", "<a href='https://b.example.com'>No id</a>"),
        row.format(" id='10'", "<a href='https://c.example.com'>show hn</a>"),
        row.format(" id='11'", "<a href='relative/x'>Relative</a>"),
    ]) + "</table>")
    r = P.read_news_board(df).collect()
    assert [(x["name"], x["domain"], x["description"]) for x in r] == [("Tool - fast", "a.example.com", "")]
    assert r[0]["source_url"].endswith("/item?id=7")
    r = P.read_news_board(df, split_titles=True).collect()
    assert [(x["name"], x["description"]) for x in r] == [("Tool", "fast")]


def test_launch_card_sets(spark):
    df = pages(
        spark,
        "<article><h3>Art</h3></article><div class='post'><h3>Div</h3></div>",
        "<div class='a-POST'><a class='Name' href='https://x.example.com/p'>Div</a>"
        "<button class='vote'>1,234</button></div>",
    )
    r = P.read_launches(df).orderBy("seq").collect()
    assert [(x["name"], x["source_url"], x["extra_data"]["upvotes"]) for x in r] == [
        ("Art", None, "0"), ("Div", "https://x.example.com/p", "1234")]


def test_payloads(spark):
    df = spark.createDataFrame(
        [(1, '{"data":{"items":[{"properties":{"name":"Acme Inc","homepage_url":"https://a.example.com"}},'
             '{"properties":{"name":null}},{"properties":{"name":"Bad","homepage_url":"x"}}]}}', "q"),
         (2, "not json", "q"), (3, "{}", ""), (4, '{"data":{"items":[{"properties":{"name":"Z"}}]}}', "")],
        "page_id long, payload string, query string")
    r = J.read_organisations(df).orderBy("seq").collect()
    assert [x["name"] for x in r] == ["Acme", "Z"]
    assert r[0]["enrichment"].funding_info.total_funding == 0.0 and r[0]["description"] == ""
    assert [x["name"] for x in J.read_organisations(df, query="query").collect()] == ["Acme"]


def test_robots_like_the_standard_library(spark):
    bodies = {
        "a.com": "User-agent: *\nDisallow: /p\nAllow: /p/x\n\nUser-agent: crawler\nuser-agent: other\nDisallow: /q # c",
        "b.com": "User-agent: *\n\nDisallow: /\n",
        "c.com": "Disallow: /x\nUser-agent: *\nAllow: /x/1\nDisallow: /x\nSitemap: z\nCrawl-delay: 1\nDisallow: /y",
        "d.com": "User-agent: crawler\nDisallow:\nUser-agent: *\nDisallow: /",
    }
    paths = ["", "/", "/p", "/p/x", "/q/1", "/x/1", "/x/2", "/y?a", "/z"]
    urls = [f"https://{h}{p}" for h in [*bodies, "none.com"] for p in paths]
    robots = spark.createDataFrame(list(bodies.items()), "host string, body string")
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for agent in ("*", "Crawler/1.0", "someone"):
        got = {r["url"]: r["allowed"] for r in allowed_urls(df, robots, agent).collect()}
        for h in [*bodies, "none.com"]:
            rp = RobotFileParser()
            rp.parse(bodies.get(h, "").splitlines())
            rp.modified()
            for p in paths:
                u = f"https://{h}{p}"
                assert got[u] == rp.can_fetch(agent, u), (agent, u)
    blocked = allowed_urls(spark.createDataFrame([("",)], "url string"), robots).first()
    assert blocked["allowed"] is False
    assert allowed_urls(df, robots, respect=False).filter("NOT allowed").count() == 0
