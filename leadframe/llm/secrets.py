"""Secret scan: a worklist of decoded layers, each rescanned, spans mapped to the source.

The text itself is the first layer.  A layer with escapes (percent, ``\\u``, ``\\x``, HTML
character references) yields its unescaped form; a run of base64, also one wrapped over lines or
standing behind ``-``, ``/``, ``+`` or ``_``, yields its bytes, as does a run of escapes that begins like a zlib
or gzip stream.  Bytes are unpacked if they are such a stream, else read as UTF-8 or UTF-16; they
are text unless they hold NUL or many control characters (``CONTROLS``).  The newest layer is decoded first,
a layer seen before from the same place of the source is not visited again, and the list runs
empty because only unseen layers enter and every decoding is shorter than what it came from,
unpacked streams aside, and these are finite.

A packed stream is read twice, in chunks: once to see that all of it is text, once for its
layers, which are cut only where nothing that is looked for, in it or in what it decodes to, can
lie across.  So memory holds a chunk or the longest stretch without such a place, not the stream.

Defined cases: a null text counts as empty (no spans); a very long text, or one of very many
matches, takes time in proportion to its content; of equal spans from several layers one stays, spans
of different layers may overlap, and one that overlaps a base span of its kind is left out;
repeated rows get equal results; an empty table gives an empty result; further columns of the input
do not matter.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import html
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import small_batches, text_of

KINDS = ("assign", "access", "hex")
#: Bytes of a packed stream that are unpacked at once.
CHUNK = 1 << 20
#: Shortest base64 run that is tried, without padding: that of ``token=12345678``, and that of a
#: zlib stream of one repeated character.
MIN_BASE64, MIN_PACKED = 19, 14
#: Share of control characters (white space aside) above which decoded bytes are no text.
CONTROLS = 0.1

_ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ESCAPE = re.compile(
    r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+"
    r"|&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});"
)
_BASE64 = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{%d}|e[A-P][A-Za-z0-9+/_-]{%d})[A-Za-z0-9+/_-]++={0,2}"
    % (MIN_BASE64, MIN_PACKED - 2)
)
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[A-Za-z0-9+/_-]++)++={0,2}")
#: Places inside a run where another one may begin or end, and letters that tell if one does.
_BORDER = re.compile(r"[+/_-]")
PROBE = 24
_CONTROL = re.compile(r"[\x00-\x08\x0E-\x1F\x7F-\x9F]")
#: Percent-encoded and ``\\x``-encoded bytes that begin like a zlib or gzip stream.
_PACKED = re.compile(
    r"(?:(?:x|%78)(?:%01|\^|%5[Ee]|%9[Cc]|%[Dd][Aa])|%1[Ff]%8[Bb])(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~*!'()/^-])+"
    r"|(?:\\x78\\x(?:01|5[Ee]|9[Cc]|[Dd][Aa])|\\x1[Ff]\\x8[Bb])(?:\\x[0-9A-Fa-f]{2})+"
)
_LINE = re.compile(r"[^\r\n]+")
#: Ends where no match, escape or base64 run goes on, whatever is decoded on either side: after a
#: character that none of them has, an empty line, a line that ends in none of base64 or an
#: escape, and a bare word between spaces.
_CUT = re.compile(
    r"[^A-Za-z0-9+/_.=\-\"':%\\&#;\x20\r\n]|\n\r?\n|[.\x20\"':]\r?\n|\x20[A-Za-z]+\x20(?=[A-Za-z0-9])"
)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the three patterns in one layer, by start and then kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class _Layer:
    """A decoded text and where its characters stand in the source.

    Piece ``i`` covers the layer from ``at[i]`` on; its characters stand one by one from
    ``source[i]`` on if ``plain[i]``, else each of them stands for all of
    ``source[i]`` to ``stop[i]``.
    """

    __slots__ = ("text", "at", "source", "stop", "plain")

    def __init__(self, text, at, source, stop, plain):
        self.text, self.at, self.source, self.stop, self.plain = text, at, source, stop, plain

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source that a span of the layer comes from."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first = self.source[i] + (start - self.at[i]) * self.plain[i]
        last = self.source[j] + end - self.at[j] if self.plain[j] else self.stop[j]
        return first, last


def _unescape(run: str) -> str:
    """What one escape sequence or a run of one kind stands for; itself if it is no text."""
    try:
        if run[0] == "%":
            return bytes.fromhex(run.replace("%", "")).decode()
        if run[0] == "&":
            return html.unescape(run)
        if run[1] == "x":
            return bytes.fromhex(run.replace("\\x", "")).decode()
        return bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be")
    except UnicodeDecodeError:
        return run


def _unescaped(layer: _Layer) -> _Layer | None:
    """The layer with its escapes decoded; None if nothing changes."""
    out, at, source, stop, plain = [], [], [], [], []
    done = size = 0

    def add(piece: str, start: int, end: int, same: bool) -> None:
        nonlocal size
        if not piece:
            return
        first, last = layer.origin(start, end)
        # a plain piece maps one by one only if the layer below does so as well
        if same and last - first == end - start:
            at.append(size), source.append(first), stop.append(last), plain.append(1)
        elif same:
            for k in range(start, end):
                a, b = layer.origin(k, k + 1)
                at.append(size + k - start), source.append(a), stop.append(b), plain.append(0)
        else:
            at.append(size), source.append(first), stop.append(last), plain.append(0)
        out.append(piece)
        size += len(piece)

    for m in _ESCAPE.finditer(layer.text):
        value = _unescape(m[0])
        if value != m[0]:
            add(layer.text[done : m.start()], done, m.start(), True)
            add(value, m.start(), m.end(), False)
            done = m.end()
    if not done:
        return None
    add(layer.text[done:], done, len(layer.text), True)
    return _Layer("".join(out), at, source, stop, plain)


def _readable(text: str) -> bool:
    return text.isprintable() or ("\0" not in text and len(_CONTROL.findall(text)) <= CONTROLS * len(text))


def _pieces(data: bytes, wbits: int) -> Iterator[str]:
    """Content of a packed stream in order; ``ValueError`` or ``zlib.error`` if it is no text."""
    stream, decoder = zlib.decompressobj(wbits), codecs.getincrementaldecoder("utf-8")()
    while not stream.eof:
        part = stream.decompress(data, CHUNK)
        data = stream.unconsumed_tail
        if not part and not data:
            break
        piece = decoder.decode(part)
        if not _readable(piece):
            raise ValueError("not readable")
        yield piece
    decoder.decode(b"", True)


def _last_cut(piece: str) -> int:
    """The last place of a piece where a layer may be cut; 0 if there is none."""
    for start in (max(0, len(piece) - 4096), 0):
        cut = 0
        for m in _CUT.finditer(piece, start):
            cut = m.end()
        if cut:
            return cut
    return 0


def _sections(pieces: Iterator[str]) -> Iterator[str]:
    """The pieces joined and cut again at places that nothing lies across."""
    held: list[str] = []
    for piece in pieces:
        cut = _last_cut(piece)
        if cut:
            yield "".join([*held, piece[:cut]])
            held = []
        held.append(piece[cut:])
    yield "".join(held)


def _texts(data: bytes) -> Iterator[str]:
    """What bytes say: the content of a zlib or gzip stream, else themselves if they are text."""
    wbits = 31 if data[:2] == b"\x1f\x8b" else 15 if data[:1] == b"\x78" else 0
    if wbits:
        try:
            for _ in _pieces(data, wbits):
                pass
        except (ValueError, zlib.error):
            pass
        else:
            yield from _sections(_pieces(data, wbits))
            return
    zeros = (data[::2].count(0), data[1::2].count(0))
    kind = "utf-8"
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        kind = "utf-16"
    elif 4 * max(zeros) > len(data):  # every other byte of UTF-16 is mostly 0 in Latin text
        kind = "utf-16-le" if zeros[1] > zeros[0] else "utf-16-be"
    try:
        text = data.decode(kind)
    except UnicodeDecodeError:
        return
    if _readable(text):
        yield text


def _lines(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of the lines of a wrapped run that may be one encoding.

    An encoder wraps at one width: all lines but the last, which is not longer, and the first,
    which may stand behind something else.  Lines of words before and after do not belong to it.
    """
    lines = [m.span() for m in _LINE.finditer(text, start, end)]
    width = [len(text[a:b].rstrip("=")) for a, b in lines]
    spans = {(0, len(lines))}
    first = 0
    while first < len(lines):
        after = first + 1
        while after < len(lines) and width[after] == width[first]:
            after += 1
        starts = [first, first - 1] if first else [first]
        ends = [after, after + 1] if after < len(lines) and width[after] < width[first] else [after]
        spans |= {(i, j) for i in starts for j in ends if j - i > 1}
        first = after
    for i, j in sorted(spans):
        if sum(width[i:j]) >= MIN_PACKED:
            yield lines[i][0], lines[j - 1][1]


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Spans of base64, on one line or wrapped."""
    for m in _BASE64.finditer(text):
        yield m.span()
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            yield from _lines(text, *m.span())


def _bytes_of(run: str) -> bytes:
    run = run.replace("\r", "").replace("\n", "").rstrip("=").replace("-", "+").replace("_", "/")
    run = run[: len(run) - (len(run) % 4 == 1)]
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except binascii.Error:
        return b""


def _begins(data: bytes) -> bool:
    """May these be the first bytes of a packed stream or a text?"""
    if data[:2] in (b"\x1f\x8b", b"\xff\xfe", b"\xfe\xff") or data[:1] == b"\x78":
        return True
    text = data.decode("utf-8", "ignore")
    return len(text.encode()) >= len(data) - 3 and (_readable(text) or b"\0" in data[:2])


def _inner(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans inside a run that is no encoding as a whole: between borders, where they begin like one.

    Each begins behind a border (or at the start) and ends where its text does: at the end, or at the
    last border before the first byte that is no text.
    """
    borders = [m.start() for m in _BORDER.finditer(text, start, end)]
    for a in [start, *(b + 1 for b in borders)]:
        if end - a < MIN_PACKED or not _begins(_bytes_of(text[a : min(a + PROBE, end)])):
            continue
        if a > start:
            yield a, end
        try:
            codecs.getincrementaldecoder("utf-8")().decode(_bytes_of(text[a:end]))
        except UnicodeDecodeError as e:
            k = bisect_right(borders, a + e.start * 4 // 3 + 2) - 1
            if k >= 0 and borders[k] - a >= MIN_PACKED:
                yield a, borders[k]


def _base64_layers(layer: _Layer, seen: set) -> Iterator[_Layer]:
    for start, end in _runs(layer.text):
        whole = False
        for new in _of_bytes(layer, start, end, _bytes_of(layer.text[start:end]), seen):
            whole = True
            yield new
        if not whole and "\n" not in layer.text[start:end]:
            for a, b in _inner(layer.text, start, end):
                yield from _of_bytes(layer, a, b, _bytes_of(layer.text[a:b]), seen)


def _of_bytes(layer: _Layer, start: int, end: int, data: bytes, seen: set) -> Iterator[_Layer]:
    """Layers of the bytes that a span of a layer stands for."""
    first, last = layer.origin(start, end)
    key = (hashlib.blake2b(data, digest_size=16).digest(), "bytes", first, last)
    if data and key not in seen:
        seen.add(key)
        for text in _texts(data):
            if text:
                yield _Layer(text, [0], [first], [last], [0])


def _packed_layers(layer: _Layer, seen: set) -> Iterator[_Layer]:
    for m in _PACKED.finditer(layer.text):
        run = m[0]
        data = bytes.fromhex(run.replace("\\x", "")) if run[0] == "\\" else unquote_to_bytes(run)
        yield from _of_bytes(layer, m.start(), m.end(), data, seen)


def _decoded(layer: _Layer, seen: set) -> Iterator[_Layer]:
    """Layers that a layer decodes to, one at a time."""
    if re.search(r"[%&\\]", layer.text) and (new := _unescaped(layer)):
        yield new
    if "%" in layer.text or "\\x" in layer.text:
        yield from _packed_layers(layer, seen)
    yield from _base64_layers(layer, seen)


def _key(layer: _Layer) -> tuple:
    """Equal texts from two places are two layers."""
    data = layer.text.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(data, digest_size=16).digest(), "text", layer.source[0], layer.stop[-1]


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans of the text, and these with what the decoded layers add."""
    base = base_spans(text)
    found = list(base)
    known = set(base)
    # base spans of a kind do not overlap, so their ends are in order as well
    of_kind = {k: ([s for kind, s, _ in base if kind == k], [e for kind, _, e in base if kind == k]) for k in KINDS}

    def taken(kind: str, first: int, last: int) -> bool:
        starts, ends = of_kind[kind]
        at = bisect_left(starts, last) - 1
        return at >= 0 and first < ends[at]

    if not text:
        return base, found
    source = _Layer(text, [0], [0], [len(text)], [1])
    seen = {_key(source)}
    todo = [_decoded(source, seen)]
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
        elif (key := _key(layer)) not in seen:
            seen.add(key)
            for kind, a, b in base_spans(layer.text):
                first, last = layer.origin(a, b)
                span = (kind, first, last)
                if span not in known and not taken(*span):
                    known.add(span)
                    found.append(span)
            todo.append(_decoded(layer, seen))
    return base, sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(RESULT)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, spans = scan(t)
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]
        return pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", find(text_of(text)).alias("r")).select("doc_id", "r.*")
