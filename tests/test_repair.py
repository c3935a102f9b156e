"""Trees of broken pages, written out by hand, and what every tree obeys."""

import random

import pytest

from leadframe.sources.html import TEXT, read_page


def tree(page):
    """Nested form of a page's nodes: ``p[b['x']]``."""
    nodes = read_page(page)

    def inner(lo, hi):
        out = []
        while lo <= hi:
            pos, end, _, tag, _, _, text, _ = nodes[lo]
            out.append(repr(text) if tag == TEXT else tag + (f"[{inner(lo + 1, end)}]" if end > lo else ""))
            lo = end + 1
        return " ".join(out)

    return inner(0, len(nodes) - 1)


@pytest.mark.parametrize("page,want", [
    # inline
    ("<p><b>x</p>y", "p[b['x']]"),
    ("<b><i>x</b>y</i>z", "b[i['x']]"),
    ("<p>a<b>b<i>c</b>d</i>e</p>", "p['a' b['b' i['c']] 'd' 'e']"),
    ("<a>x<a>y</a>", "a['x'] a['y']"),
    ("<b><div>x</b>y</div>", "b[div['x' 'y']]"),
    ("<div><span>x</div>y", "div[span['x']]"),
    ("x</b><i>y</i>", "i['y']"),
    # paragraphs
    ("<p>a<p>b", "p['a'] p['b']"),
    ("<p>a<div>b</div>c", "p['a'] div['b']"),
    ("<div><p>a</div><p>b", "div[p['a']] p['b']"),
    ("<div></p>a</div>", "div[p 'a']"),
    ("<p>a</br>b</p>", "p['a' br 'b']"),
    ("<p>a<h2>b</h2>c", "p['a'] h2['b']"),
    ("<h1>a</h2><p>b</p>", "h1['a'] p['b']"),
    ("<h1>a<h2>b</h2>", "h1['a'] h2['b']"),
    # lists
    ("<ul><li>a<li>b</ul>", "ul[li['a'] li['b']]"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "ul[li['a' ul[li['b'] li['c']]] li['d']]"),
    ("<ul><li><b>a<li>b</ul>", "ul[li[b['a']] li['b']]"),
    ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "dl[dt['a'] dd['b'] dt['c'] dd['d']]"),
    ("<ul><li>a</ul></li><p>b</p>", "ul[li['a']] p['b']"),
    ("<ol><li>a</b></li></ol>", "ol[li['a']]"),
    ("<select><optgroup><option>a<option>b<optgroup><option>c</select>",
     "select[optgroup[option['a'] option['b']] optgroup[option['c']]]"),
    # tables
    ("<table><tr><td>a<td>b<tr><td>c</table>", "table[tr[td['a'] td['b']] tr[td['c']]]"),
    ("<table><thead><tr><th>a<tbody><tr><td>b</table>", "table[thead[tr[th['a']]] tbody[tr[td['b']]]]"),
    ("<table><tr><td><table><tr><td>a<tr><td>b</table><td>c</table>",
     "table[tr[td[table[tr[td['a']] tr[td['b']]]] td['c']]]"),
    ("<b><table><tr><td>a</b><td>b</table></b>", "b[table[tr[td['a'] td['b']]]]"),
    ("<table><tr><td><p>a<td>b</table>", "table[tr[td[p['a']] td['b']]]"),
    ("<div><table><tr><td>a</div><td>b</table>c</div>", "div[table[tr[td['a'] td['b']]] 'c']"),
    ("<table><tr><td>a</tr><td>b</table>", "table[tr[td['a']] td['b']]"),
    ("<p><table><tr><td>a</p>b</table>", "p table[tr[td['a' p 'b']]]"),
    ("<table><caption>a<tr><td>b</table>", "table[caption['a'] tr[td['b']]]"),
    ("<table><tr><td>a</table></td></tr><p>b</p>", "table[tr[td['a']]] p['b']"),
    ("<table><tr><td><ul><li>a</td><td>b</table>", "table[tr[td[ul[li['a']]] td['b']]]"),
    # others
    ("<br/><img src=x><p>a", "br img p['a']"),
    ("<div>a<script>if (a<b) '</p>'</script>b</div>", "div['a' script 'b']"),
    ("<div>a<!-- <p>no</p> -->b</div>", "div['a' 'b']"),
    ("<button>a<button>b</button>", "button['a'] button['b']"),
    ("", ""),
    ("</div></p>", "p"),
])
def test_trees(page, want):
    assert tree(page) == want


def test_every_tree_is_nested():
    """Intervals of nodes never cross, and closed elements stay where they were opened."""
    rng = random.Random(12)
    tags = "p div b i a ul li table tr td th tbody h1 h2 dl dt dd span br form option select".split()
    for _ in range(500):
        page = "".join(rng.choice(["<{}>", "</{}>", "x"]).format(rng.choice(tags)) for _ in range(rng.randint(0, 60)))
        nodes = read_page(page)
        open_ends = []
        for k, (pos, end, *_rest) in enumerate(nodes):
            assert pos == k and end >= k
            while open_ends and open_ends[-1] < k:
                open_ends.pop()
            assert not open_ends or end <= open_ends[-1], page
            open_ends.append(end)


def test_well_formed_pages_keep_their_tree():
    rng = random.Random(13)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return "x", "'x'"
        tag = rng.choice(["div", "span", "em", "section"])
        parts = [make(depth - 1) for _ in range(rng.randint(1, 3))]
        seen = [p for k, (_, p) in enumerate(parts) if not (p == "'x'" and k and parts[k - 1][1] == "'x'")]
        if len(seen) < len(parts):
            return "x", "'x'"
        return f"<{tag}>" + "".join(h for h, _ in parts) + f"</{tag}>", f"{tag}[{' '.join(seen)}]"

    for _ in range(300):
        html, want = make(4)
        assert tree(f"<div>{html}</div>") == f"div[{want}]"
