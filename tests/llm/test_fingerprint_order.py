"""Which document follows which, whatever ids the rows have."""

import random

import pytest
from pyspark.sql import functions as F

from leadframe.llm import fingerprint

SCHEMA = "doc_id long, text string"


def plain(rows, hashes):
    """Rows in order, each with the text after it."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    out = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        own, half = fingerprint.fingerprint(t), len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        out.append((d, len(t), own, fingerprint.fingerprint(edited), fingerprint.likeness(own, fingerprint.fingerprint(n))))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    shifted = F.shiftrightunsigned(F.xxhash64("text"), 64 - fingerprint._HASH_BITS)
    hashes = dict(df.select("text", shifted).distinct().collect())
    got = fingerprint.compared(df).select("doc_id", "n_chars", "fingerprint", "edited_fingerprint", "near_next").collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, hashes)


@pytest.mark.parametrize("size", [3, 10, 2000])
@pytest.mark.parametrize("kind", ["distinct", "one", "null", "mixed", "far"])
def test_every_row_is_followed_by_the_next(spark, monkeypatch, kind, size):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", size)
    rng = random.Random(9)
    ids = {"distinct": lambda k: k, "one": lambda k: 5, "null": lambda k: None,
           "mixed": lambda k: rng.choice([None, 1, 1, 1, 2, k]), "far": lambda k: rng.choice([-(2**63), 2**63 - 1, 0, k])}[kind]
    texts = ["".join(rng.choice("abc de") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    check(spark, [(ids(k), rng.choice(texts) if kind != "null" else texts[k] + str(k)) for k in range(60)])


def test_rows_of_one_id_spread_over_ranges(spark):
    df = spark.range(200_000).select(F.lit(7).cast("long").alias("key"), F.shiftrightunsigned(F.xxhash64("id"), 18).alias("hash"))
    cuts = fingerprint._cuts(df)
    sizes = df.groupBy(fingerprint._index(cuts)("key", "hash").alias("part")).count().collect()
    assert len(sizes) == 100 and max(r["count"] for r in sizes) < 3000
