"""Main text of web pages: the maximum-scoring contiguous run of words and tags.

A page becomes a list of words and tags.  Words score by the element they stand in, tags by
their name; weights are log odds counted on labelled pages (those that mark their text with an
``article`` or ``main`` element), words positive and tags negative unless the labelled pages
say that an element never holds text.  One linear scan finds the run with the highest sum; its
blocks, without those in menus, forms and the like, are the text.  If most of its words stand in
one article, that whole article is.

Defined cases: a null or empty page, and one without a positive run, has an empty text; ties go
to the earliest and then shortest run; a very long page is read whole, one task holds its words
and tags; unknown elements weigh alike; repeated rows get equal results; an empty table trains
nothing (the prior holds) and gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import small_batches, text_of

#: Labelled pages that weights are counted on: those whose hashed id comes first.
TRAIN_PAGES = 4000
#: Strength of the prior, in words or tags, and bounds of a weight.
PRIOR_COUNT, MOST = 20.0, 8.0

# --- fixed values: HTML element classes (HTML standard) -----------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title svg iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html li summary tbody td tfoot th thead title tr".split())
#: Elements that end when the next of their kind opens.
SIBLINGS = {t: frozenset(g) for g in (["li"], ["dt", "dd"], ["tr"], ["td", "th"], ["option"]) for t in g}
_P, _LISTS = frozenset(["p"]), frozenset("ul ol dl table menu select".split())
HOLDERS = frozenset("article main".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big center cite code del dfn em font i ins kbd mark s samp small span strike strong sub "
    "sup time tt u var data slot ruby rp rt picture video audio canvas object map output progress meter "
    "button label select option optgroup datalist legend search hgroup tbody frame frameset".split()
)
#: Elements with a weight of their own; all others share one.
KNOWN = VOID | RAW | BLOCK | _INLINE
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Elements that never hold the main text.
SIDE = frozenset("nav aside footer form button select option dialog menu head label fieldset figcaption".split())
#: Of these, what belongs to the text that an article or main element holds.
HELD = frozenset("fieldset figcaption".split())
#: Names in class, id and role that mark the same.
SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer form header login masthead menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promoted promotion related reply replies "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "complementary contentinfo alert alertdialog toolbar".split()
)

# quotes count right after an equals sign only; elsewhere they are characters like others
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:[!?][^>]*|/?[a-zA-Z](?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>?", re.S
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


COMMENT_NAMES = frozenset(
    "ad ads advert adverts advertisement comment comments promo promoted related reply replies sponsored".split()
)
#: Words before such a name that make it say something else (``with-sidebar``, ``post-header``).
OTHER_SENSE = frozenset("with has no without post entry article story page content main".split())


def side_names(tag: str, name: str, inside: bool) -> set[str]:
    """Names in class, id and role that mark an element as beside the text.

    Inside an article or main element an id is mostly the target of a link: it counts there as a
    whole, for comments and adverts, and never on headings and paragraphs.
    """
    found = set()
    for m in _MARKS.finditer(tag):
        value = m[2] or m[3] or m[4] or ""
        if inside and m[1].lower() == "id":
            if name not in HEADINGS and value.lower() in COMMENT_NAMES:
                found.add(value.lower())
            continue
        for part in value.split():
            words = [w for w in _SPLIT.split(_CAMEL.sub(" ", part).lower()) if w]
            found |= {w for before, w in zip(["", *words], words)
                      if w in SIDE_NAMES and before not in OTHER_SENSE}
    return found


class Item:
    """A text piece or a tag of a page, in order."""

    __slots__ = ("text", "key", "words", "side", "inside", "block", "article")

    def __init__(self, text, key, words, side, inside, block, article):
        self.text, self.key, self.words = text, key, words
        self.side, self.inside, self.block, self.article = side, inside, block, article


class _Open:
    """Open elements of a page, and how many of them are beside or hold the text."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int]] = []  # name, beside the text, holds it
        self.names: Counter = Counter()
        self.side = self.blocks = 0
        self.holding = [0, 0, 0]  # open elements by what they hold
        self.articles = 0  # outermost articles so far

    @property
    def inside(self) -> int:
        return 2 if self.holding[2] else 1 if self.holding[1] else 0

    def push(self, name: str, side: bool, holds: int) -> None:
        self.stack.append((name, side, holds))
        self.names[name] += 1
        self.side += side
        self.articles += holds == 2 and not self.holding[2]
        self.holding[holds] += 1

    @property
    def article(self) -> int:
        """Number of the outermost open article, 0 if there is none."""
        return self.articles if self.holding[2] else 0

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            name, side, holds = self.stack.pop()
            self.names[name] -= 1
            self.side -= side
            self.holding[holds] -= 1
            self.blocks += name in BLOCK

    def close(self, names: frozenset[str], up_to: frozenset[str] = frozenset()) -> bool:
        """Close the innermost open element of these names, unless one of ``up_to`` is nearer."""
        if not any(self.names[n] for n in names):
            return False
        for d in range(len(self.stack) - 1, -1, -1):
            if self.stack[d][0] in names:
                self.pop_to(d)
                return True
            if self.stack[d][0] in up_to:
                return False
        return False


def items(page: str) -> list[Item]:
    """Words and tags in page order, with the element each stands in.

    ``inside`` is 2 in an article, else 1 in a main element, else 0; ``side`` tells whether an element
    beside the text holds it; ``block`` counts block borders, so pieces of one block share it.
    """
    out: list[Item] = []
    open_ = _Open()
    done, end = 0, len(page)

    def add_text(text: str) -> None:
        inner = open_.stack[-1][0] if open_.stack else ""
        key = "side" if open_.side else "text" if open_.inside else f"in {inner if inner in KNOWN else 'other'}"
        out.append(Item(text, key, len(text.split()), open_.side > 0, open_.inside, open_.blocks, open_.article))

    def add_tag(key: str) -> None:
        key = key if key in KNOWN or key == "side" else "other"
        out.append(Item(None, key, 0, open_.side > 0, open_.inside, open_.blocks, open_.article))

    while done < end:
        m = _TOKEN.search(page, done)
        start = m.start() if m else end
        if start > done:
            add_text(entities.unescape(page[done:start]))
        if not m:
            break
        done, tag = m.end(), m[0]
        named = _NAME.match(tag)
        if not named:
            continue  # comment or declaration
        name = named[1].lower()
        if tag[1] == "/":
            beside = bool(open_.stack) and open_.stack[-1][0] == name and open_.stack[-1][1]
            if not open_.close(frozenset([name])):
                open_.blocks += name in BLOCK
            add_tag("side" if beside else name)
            continue
        if name in CLOSES_P:
            open_.close(_P, BLOCK - _P)
        if name in SIBLINGS:
            open_.close(SIBLINGS[name], _LISTS)
        open_.blocks += name in BLOCK
        holds = 2 if name == "article" or "articleBody" in tag else int(name == "main" or 'role="main"' in tag)
        names = side_names(tag, name, open_.inside > 0)
        if name in HOLDERS:
            # an article of comments or adverts within or beside the one of the page
            side = bool(names & COMMENT_NAMES)
            holds = 0 if side else holds
        elif name in ("html", "body"):
            side = False
        else:
            # the page's header stands outside the text; a header in the text belongs to it
            names -= {"header"} if open_.inside else set()
            side = (name in SIDE and not (open_.inside and name in HELD)) or bool(names) or (name == "header" and not open_.inside)
        add_tag("side" if side else name)
        if name == "br":
            add_text(" ")
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, done)
            closing = page.find(">", close.start()) if close else -1
            done = end if closing < 0 else closing + 1
        elif name not in VOID:
            open_.push(name, side, holds)
    return out


Weights = dict[str, float]

#: Weights before counting: a word is worth 1, a tag costs little.
PRIOR_WORD, PRIOR_TAG, SIDE_TAG = 1.0, -0.3, -1.0


def count(page: str) -> Counter:
    """Of a labelled page: words and tags inside and outside its text, by key."""
    seen = items(page)
    out: Counter = Counter()
    if not any(i.inside for i in seen):
        return out
    for i in seen:
        inside = i.inside > 0
        if i.side or i.key == "side":
            continue
        if i.text is None:
            out["tag " + i.key, inside] += 1
        elif i.words:
            out["word " + i.key, inside] += i.words
    return out


def weights_from(counts: Counter) -> Weights:
    """Smoothed log odds; words that labelled pages have in the text are worth 1 at most,
    tags are never worth anything."""
    out: Weights = {}
    for key in sorted({k for k, _ in counts}):
        into, out_of = counts[key, True], counts[key, False]
        odds = math.log((into + 1) / (out_of + 1))
        share = (into + out_of) / (into + out_of + PRIOR_COUNT)
        if key.startswith("word "):
            out[key] = max(-MOST, min(1.0, share * odds + (1 - share) * PRIOR_WORD))
        else:
            out[key] = max(-MOST, min(-0.01, share * (min(odds, 0.0) - 0.01) + (1 - share) * PRIOR_TAG))
    return out


def score(item: Item, weights: Weights) -> float:
    """An element beside the text counts as its own tag, whatever it holds."""
    if item.side:
        return 0.0
    if item.text is None:
        return SIDE_TAG if item.key == "side" else weights.get("tag " + item.key, PRIOR_TAG)
    return item.words * weights.get("word " + item.key, PRIOR_WORD)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest positive sum, by one scan."""
    best, span = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the best run, without those beside the text, joined by an empty line.

    The run is widened to whole blocks, so a weak word at a block's border is not lost, and to the
    whole article if most of its words stand in one, so tags inside it cut nothing off.  Only
    what an article or main element holds is kept if most of the run's words stand in such.
    """
    seen = items(page)
    start, end = best_run([score(i, weights) for i in seen])
    if start == end:
        return ""
    first, last = seen[start].block, seen[end - 1].block
    words = [0, 0, 0]
    articles: Counter = Counter()
    for i in seen[start:end]:
        words[i.inside] += 0 if i.side else i.words
        articles[i.article] += 0 if i.side else i.words
    level = max(k for k in range(3) if 2 * sum(words[k:]) > sum(words))
    article = next((a for a, n in articles.items() if a and 2 * n > sum(words)), 0)
    blocks: dict[int, list[str]] = {}
    for i in seen:
        within = i.article == article if article else first <= i.block <= last and i.inside >= level
        if i.text is not None and within and not i.side:
            blocks.setdefault(i.block, []).append(i.text)
    texts = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n\n".join(t for t in texts if t)


# --- Spark ---------------------------------------------------------------------------------


def fit(pages: DataFrame, html: str = "html") -> Weights:
    """Weights from a bounded sample of the pages that label their own text."""
    small_batches(pages.sparkSession)
    ids = (
        pages.select("page_id").where("page_id IS NOT NULL").distinct()
        .orderBy(F.xxhash64("page_id"), "page_id").limit(TRAIN_PAGES)
    )

    @F.pandas_udf("array<struct<key:string,inside:boolean,n:long>>")
    def counted(batch: pd.Series) -> pd.Series:
        return pd.Series([
            [{"key": k, "inside": bool(i), "n": n} for (k, i), n in count(p).items()] for p in batch
        ], dtype=object)

    # at most TRAIN_PAGES ids are broadcast; one row per known element, word or tag, comes back
    sample = pages.select("page_id", text_of(html).alias("h")).join(F.broadcast(ids), "page_id", "left_semi")
    rows = sample.select(F.explode(counted("h")).alias("c")).groupBy("c.key", "c.inside").agg(F.sum("c.n").alias("n"))
    return weights_from(Counter({(r["key"], r["inside"]): r["n"] for r in rows.collect()}))


def extracted(pages: DataFrame, weights: Weights | None = None, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    weights = fit(pages, html) if weights is None else weights
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(batch: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, weights) for p in batch], dtype=object)

    return pages.select("page_id", "url", extract(text_of(html)).alias("text")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
