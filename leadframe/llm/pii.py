"""Personal data: a semi-Markov conditional random field over candidate segments.

A text falls into regions, the longest runs of neighbouring words that hold a digit or ``@``;
everything between them is outside any entity.  Within a region every run of at most
``MAX_WORDS`` words is a candidate segment, scored as a whole by features of its entire span.
Dynamic programming over segment ends chooses boundaries and types together; training
maximises the likelihood of segmentations by the same recursion (forward and backward sums).

Training rows are regions of ``TRAIN_DOCS`` documents at most, ``TRAIN_REGIONS`` regions at
most, labelled by the base patterns; the features leave out what only the patterns ask for
(such as the leading ``+``), so that the model also finds other spellings.  Shapes of ordinary
numbers (years, dates, decimals, thousands, series, book numbers) are features too, which the
labels hardly show: their weights before training keep them from being taken for phones.

Defined cases: a null text counts as empty (no spans); a very long text is cut into its regions one by
one, and memory holds the longest of them; of equally good segmentations the first found stays, by
word and then in the order of kinds; repeated rows get equal results; an empty table trains nothing
(the prior weights hold) and gives an empty result; further columns do not matter and ``redacted``
keeps them.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
#: Words of the longest grouping: a phone of 15 digits in pairs, one digit before them apart or none.
MAX_WORDS = 9
TRAIN_DOCS, TRAIN_REGIONS, TRAIN_REGION_CHARS = 20_000, 600, 400
EPOCHS, RATE, PULL = 12, 0.3, 0.01

Span = tuple[str, int, int]

# --- base patterns ---------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain; looks around each @ only, so long words cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns that pass their checks, by kind and start."""
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# --- candidate segments and their features -----------------------------------------
_MARK = re.compile(r"[0-9@]")
_GROUP = re.compile(r"[+(]*[0-9]{1,5}\)?(?![^.,;:!?)])")
_WORD_END = re.compile(r"[\x20\x09-\x0D]|\Z")


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring words with a digit or @, as word spans."""
    words: list[tuple[int, int]] = []
    for m in _active_words(text):
        if words and text[words[-1][1] : m[0]].strip(" \t\n\x0b\x0c\r"):
            yield words
            words = []
        words.append(m)
    if words:
        yield words


def _active_words(text: str) -> Iterator[tuple[int, int]]:
    """Words that hold a digit or @, each found from its first such character."""
    done = 0
    while m := _MARK.search(text, done):
        start = m.start()
        while start > done and text[start - 1] not in " \t\n\x0b\x0c\r":
            start -= 1
        done = _WORD_END.search(text, m.end()).start()
        yield start, done


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A candidate without punctuation around it."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


# --- fixed values: words before a phone number --------------------------------------
_CUE = re.compile(
    r"(?i)\b(?:tel|tél|telefon|telephone|téléphone|teléfono|phone|call|mobile|mobil|móvil|portable|fax|cell|whatsapp|"
    r"ruf|rufen|appel|appeler|appelez|llamar|llame|hotline|contact|ring|dial|sms)\b[^0-9\n]{0,12}\Z"
)
_NUMBER = re.compile(r"[0-9]+")
_DATE = re.compile(
    r"(?<![0-9])(?:(?:1[5-9]|20|21)[0-9]{2}([-./ ])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])"
    r"|(?:0?[1-9]|[12][0-9]|3[01])([-./])(?:0?[1-9]|1[0-2])\2(?:(?:1[5-9]|20|21)[0-9]{2}|[0-9]{2}))(?![0-9])"
)


def _book_number(digits: str) -> bool:
    """ISBN of 13 or 10 digits, by its check digit."""
    if len(digits) == 13 and digits[:3] in ("978", "979"):
        return sum(int(d) * (1, 3)[k % 2] for k, d in enumerate(digits)) % 10 == 0
    return False


def shapes(span: str) -> list[str]:
    """Shapes of numbers that are no phones."""
    groups = _NUMBER.findall(span)
    widths = [len(g) for g in groups]
    out = []
    if _DATE.search(span):
        out.append("date")
    if len(groups) > 1 and all(len(g) == 4 and g[:2] in ("15", "16", "17", "18", "19", "20", "21") for g in groups):
        out.append("years")
    if any(w.strip(".()-").count(".") == 1 and w.replace(".", "").strip("()-").isdigit() for w in span.split()):
        out.append("decimal")
    if span[:1] not in "+(0" and len(groups) > 2 and widths[0] <= 3 and set(widths[1:]) == {3}:
        out.append("thousands")
    if len(groups) > 2 and len(set(widths)) == 1 and (widths[0] == 1 or span[:1] not in "+(0"):
        out.append("series")
    if _book_number("".join(groups)):
        out.append("book number")
    return out


def features(span: str, words: int) -> list[str]:
    """What a whole candidate span looks like."""
    digits = _digits(span)
    n = len(digits)
    bare = span.lstrip("+")
    marks = set(re.sub("[A-Za-z0-9]", "", bare))
    out = ["bias", f"words={words}" if words < 5 else "words=5+", "digits=" + (
        "0" if not n else "1-7" if n < 8 else "8-9" if n < 10 else "10-15" if n < 16 else
        "16-19" if n < 20 else "20+")]
    if re.search("[A-Za-z]", span):
        out.append("letters")
    if span.count("@") == 1 and _DOMAIN.fullmatch(span.rpartition("@")[2]):
        out.append("at and domain")
    elif "@" in span:
        out.append("at")
    parts = bare.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        out.append("four parts" if all(map(_small, parts)) else "large parts")
    if 16 <= n <= 19 and not marks - {" ", "-"} and "letters" not in out:
        out.append("luhn" if luhn(digits) else "not luhn")
    if n >= 8 and marks and not marks - set(" ().-") and "letters" not in out:
        out.append("grouped digits")
        out += shapes(span)
    if "(" in marks or ")" in marks:
        out.append("brackets")
    if marks - set(" ().-@_%"):
        out.append("other marks")
    return out


Weights = dict[str, dict[str, float]]

#: Weights before training; training moves them and is pulled back to them.
PRIOR: Weights = {
    "email": {"bias": -3.0, "at and domain": 6.0, "words=1": 1.0},
    "ip": {"bias": -3.0, "four parts": 6.0, "large parts": -3.0},
    "card": {"bias": -3.0, "luhn": 6.0, "not luhn": -3.0},
    "phone": {"bias": -3.0, "grouped digits": 3.0, "digits=10-15": 2.0, "brackets": 1.0, "goes on": -1.5,
              "cue": 4.0, "date": -12.0, "years": -12.0, "decimal": -12.0, "book number": -12.0,
              "thousands": -8.0, "series": -8.0},
}


class _Candidate:
    __slots__ = ("first", "after", "start", "end", "features")

    def __init__(self, first, after, start, end, feats):
        self.first, self.after, self.start, self.end, self.features = first, after, start, end, feats


def _goes_on(text: str, words: list[tuple[int, int]], i: int, j: int, start: int, end: int) -> bool:
    """Whether the word before or after is one more group of the candidate's digits.

    Groups of one number stand one space apart; a group after another that starts with 0 or +
    may as well start the next number.
    """
    def joint(left: int, right: int) -> bool:
        return words[right][0] - words[left][1] == 1 and text[words[left][1]] == " " and text[words[right][0]] not in "0+"

    before = i > 0 and start == words[i][0] and joint(i - 1, i) and _GROUP.fullmatch(text, *words[i - 1])
    return bool(before) or (
        j < len(words) and end == words[j - 1][1] and joint(j - 1, j) and _GROUP.match(text, *words[j]) is not None
    )


def _candidates_from(text: str, words: list[tuple[int, int]], i: int) -> Iterator[_Candidate]:
    for j in range(i + 1, min(i + MAX_WORDS, len(words)) + 1):
        start, end = _trimmed(text, words[i][0], words[j - 1][1])
        if start < end and start < words[i][1] and end > words[j - 1][0]:
            feats = features(text[start:end], j - i)
            if _goes_on(text, words, i, j, start, end):
                feats.append("goes on")
            if "grouped digits" in feats and _CUE.search(text, max(0, start - 32), start):
                feats.append("cue")
            yield _Candidate(i, j, start, end, feats)


def candidates(text: str, words: list[tuple[int, int]]) -> list[_Candidate]:
    return [c for i in range(len(words)) for c in _candidates_from(text, words, i)]


def _score(weights: Weights, kind: str, feats: list[str]) -> float:
    w = weights[kind]
    return sum(w.get(f, 0.0) for f in feats)


def decode(text: str, words: list[tuple[int, int]], weights: Weights) -> list[Span]:
    """Best segmentation of a region: words outside score 0, segments their features."""
    n = len(words)
    best: list[float] = [0.0] + [-math.inf] * n
    back: list[tuple | None] = [None] * (n + 1)
    for i in range(n):
        if best[i] > best[i + 1]:
            best[i + 1], back[i + 1] = best[i], (i, None, None)
        for c in _candidates_from(text, words, i):
            for kind in KINDS:
                s = best[i] + _score(weights, kind, c.features)
                if s > best[c.after]:
                    best[c.after], back[c.after] = s, (i, kind, c)
    out, at = [], n
    while at:
        at, kind, c = back[at]
        if c:
            out.append((kind, c.start, c.end))
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _expectations(n: int, cands: list[_Candidate], weights: Weights) -> list[tuple[_Candidate, str, float]]:
    """Probability of each candidate and kind, from forward and backward sums."""
    scored = [(c, k, _score(weights, k, c.features)) for c in cands for k in KINDS]
    ahead = [0.0] + [-math.inf] * n
    by_first: list[list] = [[] for _ in range(n)]
    for x in scored:
        by_first[x[0].first].append(x)
    for i in range(n):
        ahead[i + 1] = _log_add(ahead[i + 1], ahead[i])
        for c, _, s in by_first[i]:
            ahead[c.after] = _log_add(ahead[c.after], ahead[i] + s)
    behind = [-math.inf] * n + [0.0]
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        for c, _, s in by_first[i]:
            behind[i] = _log_add(behind[i], s + behind[c.after])
    total = ahead[n]
    return [(c, k, math.exp(ahead[c.first] + s + behind[c.after] - total)) for c, k, s in scored]


def train(samples: list[str]) -> Weights:
    """Weights that make the base segmentations of the sample regions likely.

    Plain stochastic gradient on the log likelihood, in the order of the (sorted) samples; a
    pull towards the prior keeps features the samples do not show where they were.  Regions
    whose base spans are no candidates teach nothing and are left out.
    """
    weights = {k: dict(PRIOR[k]) for k in KINDS}
    ready = []
    for text in sorted(samples):
        gold = {(k, a, b) for k, a, b in base_spans(text)}
        for words in regions(text):
            cands = candidates(text, words)
            inside = {s for s in gold if words[0][0] <= s[1] and s[2] <= words[-1][1]}
            hits = {(k, c.start, c.end) for c in cands for k in KINDS} & inside
            if hits == inside:
                ready.append((len(words), cands, inside))
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for n, cands, gold in ready:
            for c, kind, p in _expectations(n, cands, weights):
                step = rate * (((kind, c.start, c.end) in gold) - p)
                if abs(step) > 1e-4:
                    w = weights[kind]
                    for f in c.features:
                        v, prior = w.get(f, 0.0), PRIOR[kind].get(f, 0.0)
                        w[f] = v + step - rate * PULL * (v - prior)
    return weights


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches the spans cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def all_spans(text: str, weights: Weights) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with decoded ones that touch none of them."""
    base = base_spans(text)
    found = list(base)
    starts, ends = _merged(base)
    for words in regions(text):
        for k, a, b in decode(text, words, weights):
            i = bisect_right(ends, a)  # the first taken stretch that ends after a
            if i == len(starts) or starts[i] >= b:
                found.append((k, a, b))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(found, key=lambda s: (order[s[0]], s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- Spark -----------------------------------------------------------------------------


def fit(docs: DataFrame, text: str = "text") -> Weights:
    """Train on regions of a bounded sample: the documents whose hashed id comes first."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = (
        docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    )

    @F.pandas_udf("array<string>")
    def snippets(texts: pd.Series) -> pd.Series:
        return pd.Series([
            [t[w[0][0] : w[-1][1]] for w in regions(t) if w[-1][1] - w[0][0] <= TRAIN_REGION_CHARS]
            for t in texts
        ], dtype=object)

    # at most TRAIN_DOCS ids are broadcast
    sample = docs.select("doc_id", text_of(text).alias("t")).join(F.broadcast(ids), "doc_id", "left_semi")
    found = sample.select(F.explode(snippets("t")).alias("s")).distinct()
    rows = found.orderBy(F.xxhash64("s"), "s").limit(TRAIN_REGIONS).collect()
    return train([r["s"] for r in rows])


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def found(docs: DataFrame, weights: Weights | None = None, text: str = "text") -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every row."""
    weights = fit(docs, text) if weights is None else weights
    small_batches(docs.sparkSession)

    @F.pandas_udf(RESULT)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, spans = all_spans(t, weights)
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]
        return pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", find(text_of(text)).alias("r")).select("doc_id", "r.*")


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, weights: Weights | None = None, text: str = "text") -> DataFrame:
    """``docs`` with all spans masked in the text; a null text stays null."""
    weights = fit(docs, text) if weights is None else weights
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mask(t, all_spans(t, weights)[1]) for t in texts], dtype=object)

    return docs.withColumn(text, clean(F.col(text).cast("string")))
