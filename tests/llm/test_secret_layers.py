"""Secrets in layers that are easy to lose, against brute force, and very many matches."""

import base64
import gzip
import random
import time
import urllib.parse
import zlib

import pytest

from leadframe.llm import secrets

SECRET = "token=abcdefgh1234"


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def kinds(text):
    return [k for k, _, _ in secrets.scan(text)[1]]


@pytest.mark.parametrize("mark", [" ", "\u000c", "﻿", "​", "­", "\x1b"])
def test_one_odd_character_does_not_hide_a_layer(mark):
    for text in (b64(f"{SECRET}{mark}and more text"), b64(f"{mark}{SECRET}"), b64(zlib.compress(f"{SECRET} {mark} {'x' * 50}".encode()))):
        assert kinds(f"see {text} end") == ["assign"]


def test_bytes_that_are_no_text_stay_unread():
    noise = bytes(range(32)) + SECRET.encode() + bytes(range(32))
    assert kinds(b64(noise)) == [] and kinds(b64(SECRET.encode() + b"\0")) == []


@pytest.mark.parametrize("text", [
    "x-{}", "id/{}", "a_{}", "path/to/{}/more/parts", "{}-tail", "one-two-{}-three", "/{}/",
])
def test_base64_beside_the_characters_of_base64(text):
    run = b64(SECRET + "!")
    found = secrets.scan(text.format(run))[1]
    at = text.index("{")
    assert len(found) == 1 and found[0][0] == "assign"
    assert found[0][1] <= at and at + len(run.rstrip("=")) - 3 <= found[0][2]


def test_percent_and_escape_encoded_streams():
    long = f"{SECRET} " + "with a long text behind it, " * 5
    for data in (zlib.compress(long.encode()), gzip.compress(SECRET.encode()), zlib.compress(SECRET.encode(), 9)):
        for text in (urllib.parse.quote(data), urllib.parse.quote(data, safe=""), "".join(f"%{x:02X}" for x in data),
                     "".join(f"\\x{x:02x}" for x in data)):
            found = secrets.scan(f"q={text} end")[1]
            assert [f[0] for f in found] == ["assign"] and found[0][1] <= 3 and found[0][2] >= len(text) - 10


@pytest.mark.parametrize("kind", ["utf-16", "utf-16-le", "utf-16-be"])
def test_utf_16_in_base64(kind):
    assert kinds(b64(f"{SECRET} été".encode(kind))) == ["assign"]


def test_time_follows_the_matches():
    for text in ("token=abcdefgh1234 " * 200_000 + "%41", "%74oken=abcdefgh1234 " * 20_000):
        start = time.perf_counter()
        base, found = secrets.scan(text)
        assert len(found) in (200_000, 20_000)
        assert time.perf_counter() - start < 30


WRAPS = {
    "base64": b64,
    "percent": lambda t: "".join(f"%{x:02x}" for x in t.encode()),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "zlib": lambda t: b64(zlib.compress(t.encode())),
    "gzip": lambda t: b64(gzip.compress(t.encode(), mtime=0)),
    "quoted zlib": lambda t: urllib.parse.quote(zlib.compress(t.encode()), safe=""),
}


def test_any_nesting_is_found_where_it_stands():
    """Brute force: every encoding of a secret in every other, up to three deep, between words."""
    rng = random.Random(6)
    for _ in range(300):
        secret = rng.choice([SECRET, "AKIA" + "Q7" * 8, "0123456789abcdef" * 2])
        names = [rng.choice(list(WRAPS)) for _ in range(rng.randint(1, 3))]
        run = f"say {secret} now"
        for name in names:
            run = WRAPS[name](run)
        left = "words before, " * rng.randint(0, 3)
        text = f"{left}{run}, words after"
        base, found = secrets.scan(text)
        hits = [(a, b) for k, a, b in found if k == {"t": "assign", "A": "access", "0": "hex"}[secret[0]]]
        assert any(len(left) <= a and b <= len(left) + len(run) for a, b in hits), (names, text)
