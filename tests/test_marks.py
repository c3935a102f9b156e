import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from leadframe.operators import dedup as D
from leadframe.operators.similarity import Bounds, marks, may_share


def long_names(n, seed):
    """Unlike names that share their common syllables, some with near copies."""
    rng = random.Random(seed)
    parts = [a + b for a in "bdfglmnprst" for b in ("a", "e", "en", "er", "ie", "on")]
    names = ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(26))[:60] for _ in range(n)]
    return names + [x[:20] + x[20 + rng.choice([0, 1]) :] + rng.choice("qz") for x in rng.sample(names, n // 4)]


@pytest.mark.parametrize("t", [0.6, 0.7, 0.85, 0.95])
def test_matching_names_pass_and_most_others_do_not(spark, t):
    names = long_names(60, 3) + ["", "x", "xy", "aaaaaaaa", "aaaaaaab", "\U0001f600 café", "\U0001f600 cafe"]
    bounds = Bounds(t)
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    rows = D.cut_lineage(rows.select("id", "name", F.length("name").alias("len"), marks("name", bounds).alias("m")).select("id", "name", "len", "m.*"))
    found = rows.alias("e").join(rows.alias("l"), (F.col("e.id") != F.col("l.id")) & may_share("e", "l", bounds))
    passed = {(r[0], r[1]) for r in found.select("e.id", "l.id").collect()}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if a != b and a and b and SequenceMatcher(None, a, b).ratio() >= t:
                assert (i, j) in passed, (a, b)
    if t >= 0.85:
        assert len(passed) < 0.3 * len(names) ** 2


def test_unlike_long_names_are_not_paired(spark, monkeypatch):
    names = long_names(120, 4)
    known = []
    add = D._Known.add_names
    monkeypatch.setattr(D._Known, "add_names", lambda self, active: known.append(self) or add(self, active))
    rows = spark.createDataFrame([(i, n, None, None) for i, n in enumerate(names)], "seq long, name string, domain string, website string")
    kept = sorted(r["seq"] for r in D.kept_positions(rows).collect())
    clean = {r["seq"]: r["name"] for r in D.records_of(rows).collect()}
    want = []
    for i in sorted(clean):
        if all(SequenceMatcher(None, clean[i], clean[j]).ratio() < 0.85 for j in want):
            want.append(i)
    assert kept == want
    assert known[-1].seen.count() < 0.3 * len(names) ** 2 / 2
