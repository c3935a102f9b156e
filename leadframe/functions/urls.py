"""URL functions as Spark columns (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadframe.functions.text import as_col, blank

# RFC 3986, appendix B: scheme, authority, path, query, fragment.
_PARTS = (
    r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
    r"(?:\?([^#]*))?(?:#([\s\S]*))?$"
)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
_LETTER = r"a-zA-Z0-9\x{a1}-\x{ffff}"
# A label of a host name; two hyphens in its third and fourth place belong to encoded names.
_LABEL = rf"^(?![{_LETTER}]{{2}}--)[{_LETTER}](?:[{_LETTER}\-]{{0,61}}[{_LETTER}])?$|^(?i:xn--)[a-zA-Z0-9\-]{{0,58}}[a-zA-Z0-9]$"
_TOP = rf"^[a-zA-Z\x{{a1}}-\x{{ffff}}][{_LETTER}\-]{{1,62}}$"
_USER = r"^(?:[A-Za-z0-9._~!$&()*+,;=\-]|%[0-9A-Fa-f]{2})+(?::(?:[A-Za-z0-9._~!$&()*+,;=:\-]|%[0-9A-Fa-f]{2})*)?$"
_REST = r'^(?:[^\s<>"{}|\\^`%]|%[0-9A-Fa-f]{2})*$'


def with_protocol(c: Column | str) -> Column:
    url = as_col(c)
    has = url.startswith("http://") | url.startswith("https://")
    return F.when(has, url).otherwise(F.concat(F.lit("https://"), url))


def extract_domain(c: Column | str) -> Column:
    """Authority of the URL without one leading 'www.'; port and case stay."""
    cleaned = F.regexp_replace(with_protocol(c), r"[\t\r\n]", "")
    host = F.regexp_extract(cleaned, r"^https?://([^/?#]*)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    broken = host.contains("[") != host.contains("]")
    return F.when(~broken, F.nullif(host, F.lit("")))


def normalize_url(c: Column | str) -> Column:
    """Add the protocol and remove all trailing slashes; empty gives ''."""
    return F.when(blank(c), F.lit("")).otherwise(
        F.regexp_replace(with_protocol(c), "/+$", "")
    )


# The functions below need many parts of a URL at once.  Their bodies are SQL
# lambdas: one expression to parse instead of hundreds of column calls, and
# values that are bound once per row by ``_let``.


def _let(value: Column, body: str) -> Column:
    """``body`` (SQL) with ``value`` bound to ``x``; evaluated once per row."""
    bound = F.call_function("transform", F.array(value), F.expr(f"x -> {body}"))
    return F.get(bound, F.lit(0))


def _sql_let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _sql_ipv6(host: str) -> str:
    """Is this the text of an IPv6 address (RFC 4291), maybe with an IPv4 address at its end?"""
    groups = f"filter(split({host}, ':'), g -> g <> '')"
    last = "coalesce(try_element_at(g, -1), '')"
    facts = f"named_struct('g', g, 'tail', {last}, 'v4', contains({last}, '.'), 'gap', contains({host}, '::'))"
    test = (
        f"(CASE WHEN NOT contains({host}, ':') OR contains({host}, ':::') OR {host} rlike r'^:[^:]' "
        f"OR {host} rlike r'[^:]:$' OR length({host}) - length(replace({host}, '::', '')) > 2 THEN false "
        f"WHEN s.v4 AND (NOT s.tail rlike r'{_IPV4}' OR endswith({host}, ':')) THEN false "
        "WHEN exists(slice(s.g, 1, size(s.g) - int(s.v4)), g -> NOT g rlike r'^[0-9A-Fa-f]{1,4}$') THEN false "
        "WHEN s.gap THEN size(s.g) + int(s.v4) <= 7 ELSE size(s.g) + int(s.v4) = 8 END)"
    )
    return _sql_let("g", groups, _sql_let("s", facts, test))


def url_problem(c: Column | str) -> Column:
    """What makes a URL invalid; null if it is valid.

    ``empty``, ``space`` (or a control character), ``user`` (user name and password, RFC 3986),
    ``ipv6`` and ``ipv4`` (literals), ``port`` (1 to 65535), ``host`` (labels of letters, digits and
    inner hyphens, international ones plain or encoded, with a top level) or ``path`` (path, query
    or fragment with a character that must be escaped, or a broken escape).  A protocol other than
    http and https counts as part of the rest, as everywhere here.
    """
    url = as_col(c)
    parts = (
        "named_struct('auth', regexp_extract(x, r'^https?://([^/?#]*)', 1), "
        "'rest', regexp_extract(x, r'(?s)^https?://[^/?#]*(.*)$', 1), 'whole', x)"
    )
    sides = (
        "named_struct('whole', p.whole, 'rest', p.rest, 'ats', length(p.auth) - length(replace(p.auth, '@', '')), "
        "'user', if(contains(p.auth, '@'), substring_index(p.auth, '@', 1), null), "
        "'host', substring_index(p.auth, '@', -1))"
    )
    halves = (
        "named_struct('v6', startswith(q.host, '['), 'name', if(startswith(q.host, '['), "
        r"regexp_extract(q.host, r'^\[([^\[\]]*)\](?::[^\[\]]*)?$', 1), substring_index(q.host, ':', 1)), "
        r"'port', if(startswith(q.host, '['), regexp_extract(q.host, r'^\[[^\[\]]*\](:.*)?$', 1), "
        "substring(q.host, length(substring_index(q.host, ':', 1)) + 1)))"
    )
    labels = r"split(h.name, r'\.', -1)"
    name = (
        "(CASE WHEN length(h.name) > 253 THEN 'host' "
        f"WHEN h.name rlike r'^[0-9.]+$' THEN if(h.name rlike r'{_IPV4}', null, 'ipv4') "
        f"WHEN size({labels}) < 2 OR exists({labels}, l -> NOT l rlike r'{_LABEL}') "
        f"OR NOT element_at({labels}, -1) rlike r'{_TOP}' THEN 'host' END)"
    )
    host = (
        f"(CASE WHEN h.v6 AND NOT {_sql_ipv6('h.name')} THEN 'ipv6' "
        r"WHEN NOT h.v6 AND q.host rlike r'[\[\]]' THEN 'ipv6' "
        "WHEN h.port <> '' AND NOT coalesce(h.port rlike r'^:[0-9]{1,5}$' "
        "AND try_cast(substring(h.port, 2) AS int) BETWEEN 1 AND 65535, false) THEN 'port' "
        f"WHEN h.v6 THEN null ELSE {name} END)"
    )
    whole = (
        r"(CASE WHEN q.whole rlike r'[\s\x00-\x1F\x7F]' THEN 'space' "
        f"WHEN q.ats > 1 OR (q.user IS NOT NULL AND NOT q.user rlike r'{_USER}') THEN 'user' "
        f"ELSE coalesce({_sql_let('h', halves, host)}, if(q.rest rlike r'{_REST}', null, 'path')) END)"
    )
    body = _sql_let("p", parts, _sql_let("q", sides, whole))
    return F.when(blank(url), F.lit("empty")).otherwise(_let(with_protocol(url), body))


def validate_url(c: Column | str) -> Column:
    return url_problem(c).isNull()


def _sql_parts(url: str) -> str:
    """Parts of a URL as a struct; missing parts are ''."""
    part = lambda i: f"regexp_extract({url}, r'{_PARTS}', {i})"
    return (
        f"named_struct('scheme', lower({part(1)}), 'host', {part(2)}, 'path', {part(3)}, "
        f"'query', {part(4)}, 'frag', {part(5)})"
    )


_HAS_DOTS = r"rlike r'(^|/)\.\.?(/|$)'"


def _sql_fold(segments: str) -> str:
    """Path of a segment array with '.' and '..' resolved."""
    folded = (
        f"aggregate({segments}, cast(array() AS array<string>), (acc, s) -> CASE "
        "WHEN s = '..' THEN if(size(acc) > 0, slice(acc, 1, size(acc) - 1), acc) "
        "WHEN s = '.' THEN acc ELSE concat(acc, array(s)) END)"
    )
    tail = f"if(element_at({segments}, -1) IN ('.', '..'), array(''), cast(array() AS array<string>))"
    return f"coalesce(nullif(array_join(concat({folded}, {tail}), '/'), ''), '/')"


def _sql_prefixed(mark: str, part: str) -> str:
    return f"if({part} <> '', concat('{mark}', {part}), '')"


def _sql_percent(text: str, unsafe: str) -> str:
    """Percent-encode the characters of a class, as UTF-8 bytes."""
    return (
        f"if({text} rlike r'[{unsafe}]', array_join(transform(split({text}, ''), ch -> "
        f"if(ch rlike r'[{unsafe}]', regexp_replace(hex(encode(ch, 'UTF-8')), '(..)', '%$1'), ch)), ''), "
        f"{text})"
    )


# merge of a base path and a relative path; empty inner segments vanish
_MERGED = _sql_let(
    "folder",
    "if(b.path rlike '[^/]$', slice(split(regexp_replace(b.path, '[^/]*$', ''), '/'), 1, "
    "size(split(regexp_replace(b.path, '[^/]*$', ''), '/')) - 1), "
    "split(regexp_replace(b.path, '[^/]*$', ''), '/'))",
    _sql_let(
        "raw",
        "concat(folder, split(u.path, '/'))",
        _sql_let(
            "segs",
            "concat(slice(raw, 1, 1), filter(slice(raw, 2, size(raw) - 2), g -> g <> ''), "
            "slice(raw, -1, 1))",
            _sql_fold("segs"),
        ),
    ),
)
_U_SEGMENTS = "split(u.path, '/')"
_NEW_PATH = (
    "CASE WHEN u.host <> '' THEN u.path WHEN u.path = '' THEN b.path "
    f"WHEN startswith(u.path, '/') AND NOT u.path {_HAS_DOTS} THEN u.path "
    f"WHEN startswith(u.path, '/') THEN {_sql_fold(_U_SEGMENTS)} "
    f"ELSE {_MERGED} END"
)
_RESOLVE = _sql_let(
    "b", _sql_parts("x.base"),
    _sql_let(
        "u", _sql_parts("x.link"),
        "if(u.scheme <> '' AND u.scheme <> b.scheme, x.link, "
        + _sql_let(
            "p", _NEW_PATH,
            "concat(b.scheme, '://', if(u.host <> '', u.host, b.host), "
            "if(p = '' OR startswith(p, '/'), '', '/'), p, "
            + _sql_let(
                "q", "if(u.host = '' AND u.path = '' AND u.query = '', b.query, u.query)",
                _sql_prefixed("?", "q"),
            )
            + f", {_sql_prefixed('#', 'u.frag')})",
        )
        + ")",
    ),
)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of a link found on the page ``base`` (http or https)."""
    link = F.regexp_replace(as_col(href), r"^[\x00-\x20]+|[\t\r\n]", "")
    absolute = link.rlike(r"^https?://[^/?#]+(?:[^?#]*|[^?#]*\?[^#]+)$")
    return (
        F.when(absolute, link)
        .when(link == "", as_col(base))
        .otherwise(_let(F.struct(as_col(base).alias("base"), link.alias("link")), _RESOLVE))
    )


_PATH_UNSAFE = r"\x00-\x20\x22<>`{}\x7f-\x{10ffff}"
_QUERY_UNSAFE = r"\x00-\x20\x22\x27<>\x7f-\x{10ffff}"
_FRAGMENT_UNSAFE = r"\x00-\x20\x22<>`\x7f-\x{10ffff}"


# A URL that already is in canonical form.
_CANONICAL = (
    r"^https?://[a-z0-9](?:[a-z0-9.\-]*[a-z0-9])?/"
    r"(?:[A-Za-z0-9_~%!$&()*+,;=:@\-]+(?:\.[A-Za-z0-9_~%!$&()*+,;=:@\-]+)*/?)*"
    r"(?:\?[A-Za-z0-9_~%!$&()*+,;=:@./?\-]+)?(?:#[A-Za-z0-9_~%!$&()*+,;=:@./?\-]+)?$"
)

_HOST_OK = r"r'^[^\s\x00-\x20<>^|%\[\]\\]+$|^\[[0-9a-f:.]+\]$'"
_CANONICAL_PATH = (
    "if(u.path = '', '/', "
    + _sql_let(
        "p",
        f"if(u.path {_HAS_DOTS}, {_sql_fold(_U_SEGMENTS)}, u.path)",
        _sql_percent("p", _PATH_UNSAFE),
    )
    + ")"
)
_CANONICALIZE = _sql_let(
    "u", _sql_parts("x"),
    _sql_let(
        "h",
        "named_struct('user', regexp_extract(u.host, '^([^@]*@)', 1), "
        "'port', regexp_extract(u.host, ':([0-9]+)$', 1), "
        "'raw', lower(regexp_replace(regexp_replace(u.host, '^[^@]*@', ''), ':[0-9]*$', '')))",
        _sql_let(
            "host",
            r"if(h.raw rlike r'[^\x00-\x7f]', try_reflect('java.net.IDN', 'toASCII', h.raw), h.raw)",
            f"if(u.scheme IN ('http', 'https') AND coalesce(host rlike {_HOST_OK}, false) "
            "AND length(x) <= 2083 "
            "AND (h.port = '' OR coalesce(try_cast(h.port AS int), 99999) <= 65535), "
            "concat(u.scheme, '://', h.user, host, "
            "if(h.port = if(u.scheme = 'http', '80', '443'), '', "
            f"{_sql_prefixed(':', 'h.port')}), {_CANONICAL_PATH}, "
            f"{_sql_prefixed('?', _sql_percent('u.query', _QUERY_UNSAFE))}, "
            f"{_sql_prefixed('#', _sql_percent('u.frag', _FRAGMENT_UNSAFE))}), NULL)",
        ),
    ),
)


def canonical_url(c: Column | str) -> Column:
    """Canonical absolute http(s) URL, or null when the value is not one.

    Lower-case scheme and host, default port dropped, '/' for an empty path,
    dot segments resolved, unsafe characters percent-encoded, international
    hosts in their ASCII form.
    """
    url = as_col(c)
    done = url.rlike(_CANONICAL) & (F.length(url) <= 2083)
    return F.when(done, url).otherwise(
        _let(F.regexp_replace(F.trim(url), r"[\t\r\n]", ""), _CANONICALIZE)
    )


def search_url(base: Column, **filters: Column | str | None) -> Column:
    """Listing address with the given optional filters, joined by '&'."""
    parts = []
    for name, value in filters.items():
        if value is None:
            continue
        v = as_col(value) if isinstance(value, Column) else F.lit(value)
        parts.append(F.when(~blank(v), F.concat(F.lit(f"{name}="), v)))
    if not parts:
        return base
    joined = F.concat_ws("&", *parts)
    return F.when(joined != "", F.concat(base, F.lit("?"), joined)).otherwise(base)
