from urllib.parse import urljoin

from pyspark.sql import functions as F

from leadframe.functions import urls as U


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_extract_domain(spark):
    cases = {
        "https://www.example.com/path": "example.com",
        "http://subdomain.example.co.uk": "subdomain.example.co.uk",
        "example.com?x=1": "example.com",
        "https://user:pw@Example.com:8080/#a": "user:pw@Example.com:8080",
        "HTTP://x.com/": "HTTP:",
        "": None,
        None: None,
        "https:///path": None,
        "http://[::1/x": None,
    }
    assert run(spark, cases, U.extract_domain) == list(cases.values())


def test_normalize_url(spark):
    cases = {"example.com/": "https://example.com", "http://a//": "http://a", "": "", None: ""}
    assert run(spark, cases, U.normalize_url) == list(cases.values())


def test_validate_url(spark):
    cases = {
        "https://example.com": True, "example.com/a b": False, "": False, None: False,
        "http://a": False, "http://127.0.0.1:80/x": True, "http://300.0.0.1": False,
        "http://-a.com": False, "https://bücher.de/x": True, "http://a..b.com": False,
    }
    assert run(spark, cases, U.validate_url) == list(cases.values())


def test_canonical_url(spark):
    cases = {
        "https://example.com": "https://example.com/",
        "HTTP://EXAMPLE.com:80/a/../b": "http://example.com/b",
        "https://x.com:8443/": "https://x.com:8443/",
        "https://x.com/ü?q=a b#ç": "https://x.com/%C3%BC?q=a%20b#%C3%A7",
        "https://bücher.de/": "https://xn--bcher-kva.de/",
        "https://x.com/a.b/c?d=e": "https://x.com/a.b/c?d=e",
        "/relative": None, "ftp://x.com": None, "mailto:a@b.c": None, "": None, None: None,
        "https://": None,
    }
    assert run(spark, cases, U.canonical_url) == list(cases.values())


def test_resolve_url_like_the_standard_library(spark):
    bases = ["http://h.com", "http://h.com/", "http://h.com/a/b", "https://h.com/a/b/?q=1#f",
             "http://h.com/a//b/c"]
    links = ["", "x", "/x", "//o.com/p", "?q=2", "#top", "../x", "../../../x/", "./y/.", "a/../b",
             "https://z.org", "http://z.org/p?x#y", "mailto:a@b.c", "javascript:void(0)", "/a/../b",
             "x//y", "..", ".", "/..", "a?b=../c", "x;y=1", "https://z.org/?"]
    for base in bases:
        got = run(spark, links, lambda c, b=base: U.resolve_url(F.lit(b), c))
        assert dict(zip(links, got)) == {x: urljoin(base, x) for x in links}


def test_search_url(spark):
    got = run(spark, ["x"], lambda c: U.search_url(F.lit("u"), role="dev", location=None))
    assert got == ["u?role=dev"]
    got = run(spark, ["x", None], lambda c: U.search_url(F.lit("u"), role=c, location=c))
    assert got == ["u?role=x&location=x", "u"]


LONG = "a" * 63
PROBLEMS = {
    None: "empty", "": "empty",
    "https://example.com": None, "example.com": None, "http://example.com/": None, "https://sub.example.co.uk/a/b?c=d#e": None,
    "https://EXAMPLE.com": None, "https://a-b.example.com": None, "https://1a.example.com": None,
    "https://example.com?x=1": None, "https://example.com#top": None, "https://example.com/a%20b": None,
    "https://example.com/~user/(x),;=:@&!$'*+": None, "https://example.com/é": None,
    "https://example.com:1": None, "https://example.com:65535/x": None, "https://user@example.com": None,
    "https://user:pass@example.com:8080/x": None, "https://u%40ser:p%3Aw@example.com": None, "https://user:@example.com": None,
    "https://bücher.de": None, "https://例え.テスト": None, "https://xn--bcher-kva.de": None, "https://пример.рф/путь": None,
    f"https://{LONG}.com": None, "http://127.0.0.1": None, "http://127.0.0.1:80/x": None, "http://255.255.255.255": None,
    "http://[::1]": None, "http://[::]": None, "http://[2001:db8::ff00:42:8329]/x": None, "http://[1:2:3:4:5:6:7:8]:443": None,
    "http://[::ffff:192.0.2.1]": None, "http://[1:2:3:4:5:6:192.0.2.1]": None, "http://user@[::1]:99/": None,
    "https://example.com/a b": "space", "https://exam ple.com": "space", "https://example.com/\t": "space",
    "https://a@b@example.com": "user", "https://@example.com": "user", "https://us er@example.com": "space",
    "https://us%zz@example.com": "user", "https://<x>@example.com": "user",
    "http://a": "host", "http://localhost:80": "host", "http://-a.com": "host", "http://a-.com": "host", "http://a..com": "host",
    "http://.com": "host", "http://example.com.": "host", "http://a_b.com": "host", "http://example.c": "host",
    f"http://{LONG}a.com": "host", "http://ab--cd.com": "host", "http://xn--.com": "host", "http://": "host",
    "http://" + ".".join([LONG] * 4) + ".com": "host", "ftp://example.com": "port",
    "http://300.0.0.1": "ipv4", "http://1.2.3": "ipv4", "http://01.2.3.4": "ipv4", "http://1.2.3.4.5": "ipv4",
    "http://example.com:0": "port", "http://example.com:65536": "port", "http://example.com:": "port", "http://example.com:8a": "port",
    "http://[::1]:": "port", "http://[::1]x": "ipv6", "http://[1::2::3]": "ipv6", "http://[:::]": "ipv6", "http://[1:2:3]": "ipv6",
    "http://[1:2:3:4:5:6:7:8:9]": "ipv6", "http://[12345::]": "ipv6", "http://[g::1]": "ipv6", "http://[::1": "ipv6", "http://::1": "port",
    "http://[:1:2:3:4:5:6:7]": "ipv6", "http://[::1.2.3.256]": "ipv6", "http://[1.2.3.4]": "ipv6", "http://[]": "ipv6",
    "http://[1:2:3:4:5:6:7:1.2.3.4]": "ipv6",
    "https://example.com/a|b": "path", "https://example.com/<x>": "path", "https://example.com/%zz": "path",
    "https://example.com?q={}": "path", "https://example.com/%": "path", 'https://example.com/"': "path",
}


def test_url_problems(spark):
    got = dict(zip(PROBLEMS, run(spark, PROBLEMS, U.url_problem)))
    assert {u: (got[u], p) for u, p in PROBLEMS.items() if got[u] != p} == {}
    assert run(spark, PROBLEMS, U.validate_url) == [p is None for p in PROBLEMS.values()]


def test_ipv6_is_what_the_address_parser_says(spark):
    import ipaddress
    import random

    rng = random.Random(7)
    hosts = set()
    for _ in range(3000):
        some = ["0", "1", "ff", "abcd"] * rng.choice([1, 8]) + ["", "12345", "g", "1.2.3.4"]
        groups = [rng.choice(some) for _ in range(rng.randint(2, 9))]
        if rng.random() < 0.5:
            groups.insert(rng.randrange(len(groups)), "")
        hosts.add(":".join(groups))

    def valid(h):
        try:
            return bool(ipaddress.IPv6Address(h))
        except ValueError:
            return False

    urls = {f"http://[{h}]/": valid(h) for h in sorted(hosts)}
    got = dict(zip(urls, run(spark, urls, U.validate_url)))
    assert sum(urls.values()) > 200 and {u for u in urls if got[u] != urls[u]} == set()
