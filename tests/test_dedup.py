import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadframe.operators import dedup as D
from leadframe.operators.similarity import Bounds, possible, signature_keys
from sequential import greedy_keep

SCHEMA = "seq long, name string, domain string, website string"


def companies(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(rng, n, words, keys):
    rows = []
    for seq in range(n):
        base = rng.choice(words)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.randrange(len(base) + 1)
            base = base[:p] + rng.choice("abcd ") + base[p + rng.choice([0, 1]):]
        key = rng.choice(keys)
        rows.append((seq, base or "x", key, None))
    return rows


def expected(spark, rows, t):
    clean = D.records_of(companies(spark, rows)).collect()
    records = [(r.seq, r.key, r.name) for r in sorted(clean, key=lambda r: r.seq)]
    return greedy_keep(records, t)


def test_demo(spark):
    rows = [
        (0, "Example Inc", "example.com", None),
        (1, "Example Inc.", "example.com", None),
        (2, "Example Corporation", "example.com", None),
        (3, "Different Corp", "different.com", None),
    ]
    out = D.deduplicate(companies(spark, rows)).orderBy("seq").collect()
    assert [r["name"] for r in out] == ["Example Inc", "Different Corp"]


@pytest.mark.parametrize("seed,head", [(1, 256), (2, 2), (4, 1)])
def test_equals_the_sequential_loop(spark, seed, head):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg ") for _ in range(rng.randrange(1, 30))) for _ in range(12)]
    keys = [None, None] + [f"h{i}.com" for i in range(8)]
    rows = random_rows(rng, 60 if head < 9 else 200, words, keys)
    kept, _ = expected(spark, rows, 0.85)
    got = D.kept_positions(companies(spark, rows), 0.85, head).collect()
    assert sorted(r["seq"] for r in got) == kept


def test_hot_key_and_hot_name(spark):
    # a third of the rows in one domain, a third with one name, a family of near copies
    rows = [(i, f"title number {i:04d} of the host", "hot.com", None) for i in range(30)]
    rows += [(100 + i, "Welcome page", f"d{i}.com", None) for i in range(30)]
    rows += [(200 + i, f"Customer 00000{i:04d}", None, None) for i in range(30)]
    rng = random.Random(5)
    rng.shuffle(rows)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    kept, reps = expected(spark, rows, 0.85)
    got = D.kept_positions(companies(spark, rows), 0.85, 8).collect()
    assert sorted(r["seq"] for r in got) == kept


@pytest.mark.parametrize("t", [0.6, 0.95])
def test_other_thresholds(spark, t):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(10)]
    rows = random_rows(rng, 80, words, [None, "a.com", "b.com", "c.com"])
    kept, _ = expected(spark, rows, t)
    got = D.kept_positions(companies(spark, rows), t).collect()
    assert sorted(r["seq"] for r in got) == kept


def test_representatives_and_merge(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(2, 20))) for _ in range(8)]
    rows = random_rows(rng, 90, words, [None, None] + [f"h{i}.com" for i in range(12)])
    kept, reps = expected(spark, rows, 0.85)
    got = {r["seq"]: r["rep_seq"] for r in D.representatives(companies(spark, rows)).collect()}
    assert got == reps
    merged = D.merge_duplicates(companies(spark, rows))
    assert sorted(r["seq"] for r in merged.select("seq").collect()) == kept
    assert merged.columns == ["seq", "name", "domain", "website"]
    first_domain = {}
    for seq, _, dom, _ in rows:
        if dom is not None:
            first_domain.setdefault(reps[seq], dom)
    for r in merged.collect():
        assert r["domain"] == first_domain.get(r["seq"])


def hot_names(n, seed):
    """Unlike names that share their common words, some with near copies."""
    rng = random.Random(seed)
    part = lambda k: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(k))
    names = [f"{part(7)} holding {part(2)}" for _ in range(n)]
    return names + [x[:-1] + "q" for x in rng.sample(names, n // 5)]


def test_large_blocks_are_dealt_in_parts(spark):
    names = hot_names(160, 8) + [f"Welcome holding page {k:04d}" for k in range(60)]
    rows = [(i, n, f"d{i % 150}.com" if i % 3 else None, None) for i, n in enumerate(names)]
    kept, reps = expected(spark, rows, 0.85)
    got = D.kept_positions(companies(spark, rows), 0.85, 8, 16).collect()
    assert sorted(r["seq"] for r in got) == kept


def test_unlike_names_of_a_large_block_are_not_compared_one_by_one():
    names = pd.Series([n.lower() for n in hot_names(300, 9)])
    left, right = (pd.Series([names[k] for pair in zip(range(len(names)), range(1, len(names))) for k in (pair[s],)])
                   for s in (0, 1))
    assert possible(left, right, 0.85).mean() < 0.05


def test_in_order_and_rounds_agree(spark, monkeypatch):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefg ") for _ in range(rng.randrange(4, 24))) for _ in range(12)]
    rows = random_rows(rng, 70, words, [None, None] + [f"h{i}.com" for i in range(8)])
    kept, _ = expected(spark, rows, 0.85)
    for few in (0, 10):
        monkeypatch.setattr(D, "_FEW", few)
        got = D.kept_positions(companies(spark, rows), 0.85, 6).collect()
        assert sorted(r["seq"] for r in got) == kept


def test_idempotent(spark, sf_small):
    from leadframe.plans.inputs import page_companies

    once = D.deduplicate(page_companies(spark, sf_small)).cache()
    assert once.count() == 27
    assert D.deduplicate(once).count() == 27


@pytest.mark.parametrize("t", [0.7, 0.8, 0.85, 0.9, 1.0])
def test_matching_names_share_a_key(t):
    from difflib import SequenceMatcher

    rng = random.Random(3)
    bounds = Bounds(t)
    checked = 0
    for _ in range(4000):
        n = rng.choice([2, 3, 5, 7, 8, 9, 12, 20, 31, 33, 45, 60, 230])
        a = "".join(rng.choice("abcdefgh ") for _ in range(n))
        b = list(a)
        for _ in range(rng.randrange(1, max(2, int(n * (1 - t)) + 2))):
            p = rng.randrange(len(b)) if b else 0
            b[p : p + rng.choice([0, 1])] = rng.choice(["", "x", "a"])
        b = "".join(b)
        if a != b and SequenceMatcher(None, a, b).ratio() >= t:
            checked += 1
            rank = {"ab": 3, "cd": 9}
            assert set(signature_keys(a, bounds, rank)) & set(signature_keys(b, bounds, rank)), (a, b)
            assert possible(pd.Series([a, "xx"]), pd.Series([b, "yy"]), t)[0]
    assert checked > 100 or t == 1.0


def test_ranked_tokens_do_not_change_the_result(spark, monkeypatch):
    from leadframe.plans.inputs import page_companies

    monkeypatch.setattr(D, "token_ranks", lambda names, bounds: {})
    pages = page_companies(spark, "/root/testdata/sf0.001")
    none = F.lit(None).cast("string")
    assert D.kept_positions(pages.withColumns({"domain": none, "website": none})).count() == 37


def test_intermediate_tables_go_to_the_shared_folder(spark):
    from leadframe import session

    folder = session.shared_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or folder == configured.rstrip("/")
    df = session.cut_lineage(spark.range(3))
    assert df.count() == 3
    assert all(folder in f for f in df.inputFiles())
