"""HTML pages as arrays of nodes.

The only Python step of the readers: an Arrow UDF turns each page into its
element list in document order.  A node's subtree is the slice
``(pos, end_pos]`` of that list, so every selector is a higher-order function on
the page row: containment costs no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadframe.functions.text import as_col

TEXT = "#text"
#: Characters of the pages that one Arrow batch of nodes holds.
_SLICE = 1 << 20

NODES = T.ArrayType(
    T.StructType(
        [
            T.StructField("pos", T.IntegerType()),
            T.StructField("end_pos", T.IntegerType()),
            T.StructField("depth", T.IntegerType()),
            T.StructField("tag", T.StringType()),
            T.StructField("classes", T.ArrayType(T.StringType())),
            T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
            T.StructField("text", T.StringType()),
            T.StructField("next_p", T.IntegerType()),
        ]
    )
)

# --- fixed values: HTML element classes (HTML standard) -----------------------
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_RAW = frozenset(["script", "style", "template"])
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SECTIONS = frozenset("thead tbody tfoot".split())
# An opening tag on the left ends open elements of the middle set, up to the
# nearest element of the right set.
_ROW, _CELL = {"tr", "td", "th"}, {"td", "th"}
_IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": (_ROW | {"caption", "colgroup"}, {"table", *_SECTIONS}),
    "td": (_CELL, {"tr", "table"}),
    "th": (_CELL, {"tr", "table"}),
    **{t: (_ROW | _SECTIONS | {"caption", "colgroup"}, {"table"}) for t in _SECTIONS},
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "a": ({"a"}, {"table", "td", "th", "caption", "button", "object"}),
    "button": ({"button"}, {"table", "td", "th", "caption", "form"}),
}
# An end tag closes what it finds open up to an element of a higher rank: an inline end tag ends
# no block, a block's no table cell, a cell's no other row.
_RANK = {"div": 1, "section": 1, "article": 1, "main": 1, "ul": 1, "ol": 1, "dl": 1, "form": 1, "td": 2, "th": 2,
         "caption": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5, "body": 6, "head": 6, "html": 7}


class _PageReader(HTMLParser):
    """Collects the nodes of one page; ``tags`` limits which elements are kept."""

    def __init__(self, tags: frozenset[str] | None):
        super().__init__(convert_charrefs=True)
        self.tags = tags
        self.nodes: list[list] = []
        self.open: list[tuple[str, int]] = []  # (tag, node index or -1)
        self.kept_open = 0
        self.waiting: list[int] = []  # nodes that have no following <p> yet

    def _pop_to(self, depth: int) -> None:
        last = len(self.nodes) - 1
        while len(self.open) > depth:
            _, i = self.open.pop()
            if i >= 0:
                self.nodes[i][1] = last
                self.kept_open -= 1

    def _end_implied(self, ends: set[str] | frozenset[str], scope: set[str]) -> None:
        cut = None
        for d in range(len(self.open) - 1, -1, -1):
            tag = self.open[d][0]
            if tag in scope:
                break
            if tag in ends:
                cut = d
        if cut is not None:
            self._pop_to(cut)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES_P:
            self._end_implied({"p"}, {"table", "td", "th", "li", "button", "div", "body"})
        if tag in _HEADINGS and self.open and self.open[-1][0] in _HEADINGS:
            self._pop_to(len(self.open) - 1)
        if tag in _IMPLIED_END:
            self._end_implied(*_IMPLIED_END[tag])
        index = -1
        if self.tags is None or tag in self.tags:
            index = len(self.nodes)
            values: dict[str, str] = {}
            for k, v in attrs:
                values.setdefault(k, v or "")
            self.nodes.append(
                [index, index, len(self.open), tag, values.get("class", "").split(),
                 values, None, None]
            )
            if tag == "p":
                for w in self.waiting:
                    self.nodes[w][7] = index
                self.waiting.clear()
            self.waiting.append(index)
        if tag not in _VOID:
            self.open.append((tag, index))
            self.kept_open += index >= 0

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":  # as browsers read it
            self.handle_starttag(tag, [])
            return
        rank = _RANK.get(tag, 0)
        for d in range(len(self.open) - 1, -1, -1):
            name = self.open[d][0]
            if name == tag or (tag in _HEADINGS and name in _HEADINGS):
                self._pop_to(d)
                return
            if _RANK.get(name, 0) > rank:
                break
        if tag == "p":  # an end without a beginning is an empty paragraph
            self.handle_starttag(tag, [])
            self._pop_to(len(self.open) - 1)

    def handle_data(self, data: str) -> None:
        if self.kept_open and self.open[-1][0] not in _RAW:
            i = len(self.nodes)
            self.nodes.append([i, i, len(self.open), TEXT, [], {}, data, None])


def read_page(html: str | None, tags: frozenset[str] | None = None) -> list[list]:
    """Nodes of one page, in document order."""
    reader = _PageReader(tags)
    if html:
        reader.feed(html)
        reader.close()
    reader._pop_to(0)
    return reader.nodes


def _to_arrow(pages: list[list[list]]) -> pa.Array:
    """Nodes of a batch as one Arrow list array, built column by column."""
    offsets, flat = [0], []
    for nodes in pages:
        flat.extend(nodes)
        offsets.append(len(flat))
    cols = list(zip(*flat)) or [[]] * 8
    ints = lambda c: pa.array(c, pa.int32())
    fields = [
        ints(cols[0]), ints(cols[1]), ints(cols[2]), pa.array(cols[3], pa.string()),
        pa.array(cols[4], pa.list_(pa.string())),
        pa.array([list(d.items()) for d in cols[5]], pa.map_(pa.string(), pa.string())),
        pa.array(cols[6], pa.string()), ints(cols[7]),
    ]
    names = NODES.elementType.fieldNames()
    structs = pa.StructArray.from_arrays(fields, names=names)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def _in_slices(batches: Iterator[pa.Array], tags: frozenset[str] | None) -> Iterator[pa.Array]:
    """Nodes of all pages, a few pages at a time: only their nodes are Python objects at once."""
    for batch in batches:
        pages, length = [], 0
        for value in batch:
            html = value.as_py()
            pages.append(read_page(html, tags))
            length += len(html or "") + 1
            if length >= _SLICE:
                yield _to_arrow(pages)
                pages, length = [], 0
        if pages:
            yield _to_arrow(pages)


def html_nodes(html: Column | str, tags: Iterable[str] | None = None) -> Column:
    """Node array of an HTML column; only elements named in ``tags`` if given."""
    keep = None if tags is None else frozenset(tags)

    @F.arrow_udf(NODES)
    def shred(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _in_slices(batches, keep)

    return shred(html)


def with_nodes(pages: DataFrame, tags: Iterable[str] | None = None, html: str = "html") -> DataFrame:
    """Replace the HTML by its nodes: raw text does not travel any further."""
    return pages.withColumn("nodes", html_nodes(html, tags)).drop(html)


# --- selectors on node arrays --------------------------------------------------
# Tests are SQL predicates on a node ``n``.


def where(nodes: Column | str, test: str) -> Column:
    """Nodes that pass a test."""
    return F.call_function("filter", as_col(nodes), F.expr(f"n -> {test}"))


def first_node(nodes: Column | str, test: str) -> Column:
    return F.get(where(nodes, test), F.lit(0))


def subtree(nodes: Column, node: Column) -> Column:
    """Descendants of a node of the same array, in order."""
    return F.slice(nodes, node["pos"] + 2, node["end_pos"] - node["pos"])


def text_in(nodes: Column) -> Column:
    """All text of a node list, joined as it stands."""
    pieces = F.call_function("transform", where(nodes, f"n.tag = '{TEXT}'"), F.expr("n -> n.text"))
    return F.array_join(pieces, "")


def text_of(nodes: Column, node: Column) -> Column:
    """Text of a node's subtree; null if there is no such node."""
    return F.when(node.isNotNull(), text_in(subtree(nodes, node)))


def page_title(html: Column | str) -> Column:
    """Text of the title element, character references decoded, without shredding the page.

    Only the short titles travel to Python.
    """

    @F.arrow_udf("string")
    def decode(titles: pa.Array) -> pa.Array:
        return pa.array([t if t is None else unescape(t) for t in titles.to_pylist()], pa.string())

    return decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
