"""Names meet the kept ones only, as products of tiles; no pair that matches is lost."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from leadframe.operators import dedup as D
from leadframe.operators import similarity as S
from leadframe.operators.similarity import Bounds, Names, Pairs, near
from test_dedup import companies, expected, random_rows
from test_marks import long_names


def changed(rng, name, t):
    out = list(name)
    for _ in range(rng.randrange(1, max(2, int(len(out) * (1 - t)) + 2))):
        p = rng.randrange(len(out)) if out else 0
        out[p : p + rng.choice([0, 1])] = rng.choice(["", "x", "é", "a"])
    return "".join(out)


@pytest.mark.parametrize("t", [0.3, 0.6, 0.7, 0.85, 0.95, 1.0])
def test_no_matching_pair_is_lost(t, monkeypatch):
    monkeypatch.setattr(S, "_ROWS", 32)
    monkeypatch.setattr(S, "_COLUMNS", 48)
    monkeypatch.setattr(S, "_OWN", 40)  # many characters share columns
    rng = random.Random(7)
    letters = "abcdefgh éüñ中\U0001f600"
    sizes = [0, 1, 2, 3, 5, 8, 12, 20, 31, 45, 60, 63, 64, 65, 66, 90, 127, 128, 129, 230]
    one = ["".join(rng.choice(letters) for _ in range(n)) for n in sizes * 4]
    two = [changed(rng, x, t) for x in one] + ["", "a", "b" * 64, "b" * 65]
    bounds = Bounds(t)
    earlier = Names(one)
    later = Names(two, earlier)
    found = {(int(a), int(b)) for i, j in near(later, earlier, bounds) for a, b in zip(i, j)}
    pairs, matching = Pairs(bounds), 0
    for i, a in enumerate(two):
        for j, b in enumerate(one):
            if a != b and SequenceMatcher(None, a, b).ratio() >= t:
                matching += 1
                assert (i, j) in found and pairs.alike(a, b), (a, b)
            elif a != b:
                assert not pairs.alike(a, b)
    assert matching > 20 or t == 1.0


def test_unlike_long_names_are_hardly_compared():
    names = Names(long_names(500, 4)[:500])
    left = sum(int((j < i).sum()) for i, j in near(names, names, Bounds(0.85)))
    assert left < 0.001 * 500 * 500 / 2


def test_no_names():
    none, some = Names([]), Names(["a firm", ""])
    assert not list(near(none, some, Bounds(0.85))) and not list(near(Names(["b"], none), none, Bounds(0.85)))
    assert some.take(np.array([], np.int64)).names.tolist() == []


def test_near_copies_meet_the_kept_names_only(spark, monkeypatch):
    rows = [(i, f"Customer {i * 7919 % 10000:09d} {('building', 'machinery')[i % 2]}", f"h{i}.com", None) for i in range(400)]
    known = []
    add = D._Known.add_names
    monkeypatch.setattr(D._Known, "add_names", lambda self, batch: known.append(self) or add(self, batch))
    kept, _ = expected(spark, rows, 0.85)
    assert sorted(r["seq"] for r in D.kept_positions(companies(spark, rows)).collect()) == kept
    assert known[-1].seen.count() < 8 * len(rows)


@pytest.fixture
def small_parts(monkeypatch):
    for name, value in (("_FEW", 0), ("_PART", 16), ("_BLOCK", 8), ("_LARGE", 24)):
        monkeypatch.setattr(D, name, value)


def mixed_rows(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg ") for _ in range(rng.randrange(2, 70))) for _ in range(14)]
    rows = random_rows(rng, n, words, [None, None, None] + [f"h{i}.com" for i in range(40)])
    rows += [(n + i, f"Customer 00000{i:04d}", f"c{i % 30}.com" if i % 4 else None, None) for i in range(n // 4)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(order[k], *r[1:]) for k, r in enumerate(rows)]


def test_batches_equal_the_sequential_loop(spark, small_parts, monkeypatch):
    rows = mixed_rows(12, 140)
    batches = []
    add = D._Known.add_names
    monkeypatch.setattr(D._Known, "add_names", lambda self, batch: batches.append(batch.count()) or add(self, batch))
    kept, _ = expected(spark, rows, 0.85)
    got = D.kept_positions(companies(spark, rows), 0.85, 10, 24).collect()
    assert sorted(r["seq"] for r in got) == kept
    assert len(batches) >= 3 and batches[0] == 10 and max(batches) <= 24


def test_representatives_of_many_kept_names(spark, small_parts):
    rows = mixed_rows(13, 110)
    _, reps = expected(spark, rows, 0.85)
    got = {r["seq"]: r["rep_seq"] for r in D.representatives(companies(spark, rows)).collect()}
    assert got == reps
