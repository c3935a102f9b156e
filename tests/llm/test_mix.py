"""The mix that keeps all documents: its size, its shares and what it does not lose."""

import random

import pytest
from pyspark.sql import functions as F

from leadframe.llm import mixing

WORDS = {"de": "der die das und", "en": "the of and to", "es": "el los las del", "fr": "le la les des"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, sizes, junk=0, seed=3):
    """Documents of some languages, and of no known word for junk."""
    rng = random.Random(seed)
    rows = []
    for lang, n in [*sizes.items(), ("junk", junk)]:
        for _ in range(n):
            words = WORDS.get(lang, "zz1 zz2 zz3 zz4").split()
            rows.append((len(rows), " ".join(rng.choice(words) for _ in range(rng.randint(40, 60))),
                         lang if lang != "junk" else "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    bad = [r[0] for r in rows if "zz" in r[1]]
    labels = spark.createDataFrame([(r[0], 0 if r[0] in bad else 1) for r in rows], "doc_id long, quality int")
    return docs, mixing.domains_of(docs, labels)


def tokens(df):
    rows = df.groupBy(F.when(F.col("text").contains("zz"), "junk").otherwise(F.col("lang")).alias("d")).agg(
        F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    return {r["d"]: r["n"] for r in rows}


def test_a_mix_within_reach_has_the_target_shares(spark):
    docs, labelled = corpus(spark, {"de": 120, "en": 300, "es": 100, "fr": 120})
    targets = {"de": 0.25, "en": 0.25, "es": 0.25, "fr": 0.25}
    out = mixing.mixed(docs, labelled, targets)
    before, after = tokens(docs), tokens(out)
    total = sum(after.values())
    assert total <= mixing.GROWTH * sum(before.values()) * 1.02
    assert {d: round(n / total, 1) for d, n in after.items()} == dict.fromkeys(targets, 0.2) or all(
        abs(n / total - 0.25) < 0.03 for n in after.values())
    assert out.select("doc_id").distinct().count() == docs.count() and out.columns == docs.columns


@pytest.mark.parametrize("target", [0.01, 0.001])
def test_a_mix_out_of_reach_stays_within_its_growth(spark, target):
    """Junk far above its share: the others grow in proportion, but not without bound."""
    docs, labelled = corpus(spark, {"de": 60, "en": 300, "es": 60, "fr": 60}, junk=90)
    rest = (1 - target) / 4
    targets = {"de": rest, "en": rest, "es": rest, "fr": rest, "junk": target}
    out = mixing.mixed(docs, labelled, targets)
    before, after = tokens(docs), tokens(out)
    assert 1.9 * sum(before.values()) < sum(after.values()) <= 2.05 * sum(before.values())
    assert after["junk"] <= 1.05 * before["junk"]
    for d in ("de", "es", "fr"):
        assert abs(after[d] / after["fr"] - 1) < 0.1 and after[d] > 2 * before[d]
    assert out.select("doc_id").distinct().count() == docs.count()


def test_grown_totals_against_a_search():
    rng = random.Random(4)
    for _ in range(200):
        have = [rng.choice([0.0, 1, 1]) * rng.uniform(1, 100) for _ in range(4)]
        share = [rng.random() if h else 0.0 for h in have]
        if not any(share):
            continue
        goal = [sum(have) * x / sum(share) for x in share]
        got = mixing.grown(have, goal, 2.0)
        full = max(h / g for h, g in zip(have, goal) if g)
        assert all(g >= h - 1e-9 for g, h in zip(got, have)) and sum(got) <= 2 * sum(have) + 1e-6
        steps = [full * k / 2000 for k in range(2001)]
        sums = [sum(max(h, x * g) for h, g in zip(have, goal)) for x in steps]
        best = max(s for s in sums if s <= 2 * sum(have) + 1e-9)
        assert sum(got) >= best - 1e-6


def test_documents_without_words_stay_once(spark):
    docs, labelled = corpus(spark, {"de": 20, "en": 20})
    more = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(900).cast("long"))
    out = mixing.mixed(docs.union(more), labelled)
    assert 3 <= out.where("doc_id = 900").count() <= 30


def test_the_plan_of_a_step_does_not_grow(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for _ in range(60):
        p = [rng.random() ** 3 for _ in range(3)]
        rows.append(([x / sum(p) for x in p], rng.randint(1, 90)))
    soft = spark.createDataFrame(rows, "_p array<double>, _tokens long")
    sizes, rate = [], mixing._rate
    monkeypatch.setattr(mixing, "_rate", lambda steps, *more: sizes.append(len(steps)) or rate(steps, *more))
    for targets, keep_all in (([0.8, 0.15, 0.05], False), ([0.1, 0.1, 0.8], True)):
        steps = mixing.fitted_steps(soft, targets, keep_all)
        assert len(steps) > 12 and max(sizes) <= 8
        have = [sum(p[d] * t for p, t in rows) for d in range(3)]
        goal = [sum(have) * x for x in targets]
        goal = mixing.grown(have, goal) if keep_all else goal
        rates = [1.0] * len(rows)
        for errors in steps:
            now = [sum(p[d] * t * r for (p, t), r in zip(rows, rates)) for d in range(3)]
            assert errors == pytest.approx([(n - g) / m for n, g, m in zip(now, goal, have)], abs=1e-9)
            moves = [sum(x * e for x, e in zip(p, errors)) for p, _ in rows]
            rates = [max(float(keep_all), r - m) for r, m in zip(rates, moves)]
