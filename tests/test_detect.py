"""Signatures by one pass against one search per pattern."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from leadframe.operators import enrich as E
from leadframe.operators.detect import Detector, required_literal, technologies_in


def plain(signatures, text):
    return [n for n, patterns in signatures.items() if any(re.search(p, text) for p in patterns)]


@pytest.mark.parametrize("pattern,literal,whole", [
    (r"react\.js", "react.js", True), (r"jquery-[0-9]", "jquery-", False), (r"x-powered-by.*express", "x-powered-by", False),
    (r"(?:abc|abd)x", "ab", False), (r"(?:abc|xyz)d", "d", False), (r"(abcd)+e", "abcd", False), (r"(abcd)*e", "e", False), (r"[a-z]+", "", False),
    (r"a?bc", "bc", False), (r"^start", "start", False), (r"(?i)ABC", "", False), (r"(?i:ABC)d", "d", False), ("", "", True),
])
def test_required_literals(pattern, literal, whole):
    assert required_literal(pattern) == (literal, whole)


def test_the_signature_table_on_random_texts():
    rng = random.Random(2)
    detector = Detector(E.SIGNATURES)
    parts = [p.replace("\\", "").replace("[0-9]", "7").replace(".*", " ") for ps in E.SIGNATURES.values() for p in ps]
    for _ in range(400):
        text = "".join(rng.choice([rng.choice(parts)[: rng.randint(1, 30)], " ", "\n", "xy"]) for _ in range(rng.randint(0, 25)))
        assert detector(text) == plain(E.SIGNATURES, text)


def test_random_patterns():
    rng = random.Random(3)
    pieces = ["a", "b", "ab", "c?", "(ab)+", "(c|d)", "[ab]", ".*", "(?:ba)*", r"\.", "$", "^a"]
    for _ in range(300):
        table = {f"t{k}": ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))] for k in range(6)}
        detector = Detector(table)
        for _ in range(5):
            text = "".join(rng.choice("abcd.") for _ in range(rng.randint(0, 12)))
            assert detector(text) == plain(table, text), (table, text)


def test_columns_agree_with_the_probes_and_take_nulls(spark):
    rows = [(1, "<script src=jquery-3>WP-CONTENT redis"), (2, None), (3, ""), (4, "x-powered-by: php, express")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    probes = E.detect_technologies(df)
    many = E.detect_technologies(df, signatures=E.SIGNATURES | {f"t{k}": [f"zz{k}z"] for k in range(300)})
    assert sorted(probes.collect()) == sorted(many.collect())
    got = df.select(technologies_in("html", {"r": ["redis"]}).alias("t")).collect()
    assert [r["t"] for r in got] == [["r"], None, [], []]
    assert technologies_in(F.col("html"), {}) is not None


def test_time_does_not_grow_with_the_table():
    text = "some page text with words and <tags class='x'> " * 4000
    seconds = []
    for n in (33, 3000):
        detector = Detector({f"tool{k}": [rf"tool{k}\.js", f"data-tool{k}=[a-z]+"] for k in range(n)})
        best = 9.0
        for _ in range(5):
            start = time.perf_counter()
            detector(text)
            best = min(best, time.perf_counter() - start)
        seconds.append(best)
    assert seconds[1] < 4 * seconds[0]
