"""Main text of pages whose tags, ids or tables once cost parts of the article."""

from collections import Counter

import pytest

from leadframe.llm import main_text as M

PRIOR = {}


def text(page, weights=PRIOR):
    return M.main_text(page, weights)


WORDS = " ".join(f"word{k}" for k in range(40))


def counted(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    return M.fit(pages)


def test_a_stray_quote_ends_with_its_tag():
    page = f"""<article><p>One {WORDS} <a href=x title=don't>link</a> more.</p><p>it's two {WORDS}</p>
        <p data-x=5" class='a'>three "quoted" {WORDS}</p><p title="a > b">four</p></article>"""
    got = text(page).split("\n\n")
    assert [t.split()[0] for t in got] == ["One", "it's", "three", "four"]
    assert "link more." in got[0]


@pytest.mark.parametrize("element", [
    '<h2 id="related-work">Kept</h2>', '<h2 id="search">Kept</h2>', '<h3 id="share">Kept</h3>', '<p id="comments">Kept</p>',
    '<section id="social"><p>Kept</p></section>', '<div id="newsletter-study">Kept</div>', '<section id="header"><p>Kept</p></section>',
])
def test_ids_inside_an_article_name_its_parts(element):
    assert "Kept" in text(f"<body><article><p>{WORDS}</p>{element}<p>{WORDS}</p></article></body>")


@pytest.mark.parametrize("element", [
    '<div id="comments">Gone</div>', '<section class="related"><p>Gone</p></section>', '<div role="search">Gone</div>',
    '<p class="advert">Gone</p>', '<div class="share-buttons">Gone</div>',
])
def test_comments_and_adverts_inside_an_article_stay_out(element):
    assert "Gone" not in text(f"<body><article><p>{WORDS}</p>{element}<p>{WORDS}</p></article></body>")


def test_ids_outside_an_article_still_mark_the_side():
    assert text(f'<div id="sidebar"><p>Gone</p></div><div><p>{WORDS}</p></div><div id="footer">Gone</div>') == WORDS


@pytest.mark.parametrize("rows", [40, 80, 400])
def test_a_table_of_empty_cells_cuts_nothing_off(spark, rows):
    intro = " ".join(f"intro{k}" for k in range(120))
    cells = "<tr>" + "<td></td>" * 6 + "</tr>"
    page = f"""<body><nav><a>Menu</a></nav><article><h1>Title here</h1><p>{intro}</p><table>{cells * rows}</table>
        <p>{WORDS} {WORDS} {WORDS} {WORDS}</p></article><footer>Foot</footer></body>"""
    for weights in (PRIOR, counted(spark)):
        got = text(page, weights)
        assert got.startswith("Title here\n\nintro0 ") and got.endswith("word39")


def test_teasers_beside_the_text_do_not_replace_it():
    card = "<article><h3>Card</h3><p>short</p></article>"
    page = f"<main><p>{WORDS}</p><p>{WORDS}</p>{card}{card}<p>{WORDS}</p></main>"
    assert text(page).count("word0 ") == 3


def slow_run(scores):
    """Best contiguous run by trying all."""
    best, span = 0.0, (0, 0)
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            if sum(scores[a:b]) > best + 1e-9:
                best, span = sum(scores[a:b]), (a, b)
    return best, span


def test_pages_without_holders_keep_the_run_of_brute_force(spark):
    """The scan alone decides on pages that mark nothing."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40).collect()
    weights = counted(spark)
    checked = 0
    for r in rows:
        page = (r["html"] or "").replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div")
        seen = M.items(page)[:150]
        scores = [M.score(i, weights) for i in seen]
        a, b = M.best_run(scores)
        best, _ = slow_run(scores)
        assert abs(sum(scores[a:b]) - best) < 1e-6
        checked += b > a
    assert checked > 10


def test_unknown_elements_share_a_weight():
    page = "".join(f"<x-{k}>word</x-{k}>" for k in range(500)) + f"<article><p>{WORDS}</p></article>"
    counts = M.count(page)
    assert isinstance(counts, Counter) and len(counts) < 12


def test_a_very_long_page():
    page = "<article>" + f"<p>{WORDS}</p>" * 30_000 + "</article>"
    assert len(text(page).split("\n\n")) == 30_000


def test_a_very_long_url(spark):
    from leadframe.llm import url_filter

    host, path = ".".join(["x"] * 200_000) + ".example.net", "/en" + "/y" * 300_000
    rows = [(1, f"http://{host}{path}"), (2, "http://example.net/en/" + "z" * 10**6), (3, "http://" + "a" * 10**6)]
    got = {r["page_id"]: (r["rule"], r["verdict"], len(r["host"]), len(r["path"]))
           for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("example.net/en/", "allow", len(host), len(path)), 2: ("example.net/en/", "allow", 11, 10**6 + 4),
                   3: (None, "allow", 10**6, 0)}
