"""The quality query against a slow version: EM document by document, features and scorer in loops."""

import math
import re

import pytest

from leadframe.llm import quality_model as Q
from leadframe.llm.queries import QUERIES
from leadframe.llm.quality_rules import STOP_WORDS

SF = "/root/testdata/sf0.001"
STOP = {w for line in STOP_WORDS.values() for w in line.split()}


def kind(byte):
    c = chr(byte)
    if byte >= 128 or "a" <= c <= "z":
        return 1
    for number, some in ((2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, "0123456789"), (4, " \t"), (5, "\n\r\x0b\x0c"), (6, ".,;:"),
                         (7, "!?"), (8, "#*$%&"), (9, "|<>"), (10, "\"'()-")):
        if c in some:
            return number
    return 11


def facts(text):
    words = text.split()
    return {
        "words": words, "n": len(words), "kinds": [kind(b) for b in text.encode("utf-8", "replace")],
        "symbols": sum(c in "#*$%&<>" for c in text), "shouts": sum(c in "!?" for c in text), "bars": text.count("|"),
        "capitals": len(re.findall("[A-Z]", text)), "letters": sum(kind(b) in (1, 2) for b in text.encode("utf-8", "replace")),
        "stops": sum(w.lower() in STOP for w in words), "repeats": sum(a == b for a, b in zip(words, words[1:])),
        "distinct": len(set(words)), "chars": len(text),
    }


def votes(f):
    n = f["n"]
    if not n:
        return (0,) * 8
    no = lambda bad: -1 if bad else 0
    stop = 0 if n < 30 else -1 if f["stops"] < 0.05 * n else 1 if f["stops"] > 0.12 * n else 0
    size = -1 if not 2.5 * n < f["chars"] < 16 * n else 1 if 4.5 * n < f["chars"] < 7.5 * n else 0
    return (no(f["symbols"] > 0.25 * n), no(f["shouts"] > 0.25 * n), no(f["bars"] > 0.2 * n),
            no(f["capitals"] > 0.5 * f["letters"]), stop, no(n >= 30 and f["repeats"] > 0.2 * n),
            no(n >= 30 and f["distinct"] < 0.15 * min(n, 5000)), size)


def slow_em(all_votes):
    """Posterior of each document, by rounds over documents and labellers."""
    total = len(all_votes)
    good = [1 / (1 + math.exp(4 * v.count(-1) - v.count(1) - 1)) for v in all_votes]
    belief = [[1, 1, 0], [0, 1, 1]]
    for _ in range(Q.EM_ROUNDS):
        mass = [sum(1 - g for g in good), sum(good)]
        prior = [(m + 1) / (total + 2) for m in mass]
        tables = []
        for j in range(8):
            table = []
            for c in (0, 1):
                row = [1 + Q.BELIEF * total * belief[c][v] for v in range(3)]
                for vote, g in zip(all_votes, good):
                    row[vote[j] + 1] += g if c else 1 - g
                table.append([x / sum(row) for x in row])
            tables.append(table)
        logs = [[math.log(prior[c]) + sum(math.log(tables[j][c][v[j] + 1]) for j in range(8)) for c in (0, 1)] for v in all_votes]
        good = [1 / (1 + math.exp(max(-50, min(50, a - b)))) for a, b in logs]
    return good


def slot(code):
    return (code * 0x9E3779B97F4A7C15 % 2**64) >> 54


def vector(f):
    x, kinds = {}, f["kinds"]
    runs = {}
    for a, b, c in zip(kinds, kinds[1:], kinds[2:]):
        runs[a * 144 + b * 12 + c] = runs.get(a * 144 + b * 12 + c, 0) + 1
    for code, k in runs.items():
        x[slot(code)] = x.get(slot(code), 0) + math.sqrt(k / len(kinds))
    if f["n"] >= 30:
        shares = [f["stops"] / f["n"], f["repeats"] / f["n"], f["distinct"] / f["n"], f["capitals"] / max(f["letters"], 1)]
        for k, s in enumerate(shares):
            step = sum(s > edge for edge in (0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9))
            code = slot(10_000 + 100 * k + step)
            x[code] = x.get(code, 0) + 0.5
    return x


def slow_scorer(vectors, labels):
    weights, speed = [0.0] * (Q.DIMENSIONS + 1), [0.0] * (Q.DIMENSIONS + 1)
    share = min(max(sum(labels) / len(labels), 0.01), 0.99)
    each = [y / share + (1 - y) / (1 - share) for y in labels]
    each = [e / sum(each) for e in each]
    for _ in range(Q.ROUNDS):
        slope = [Q.PULL * w for w in weights]
        for x, y, e in zip(vectors, labels, each):
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(weights[k] * v for k, v in x.items()) + weights[-1]))))
            for k, v in x.items():
                slope[k] += v * e * (p - y)
            slope[-1] += e * (p - y)
        speed = [0.9 * s - Q.RATE * g for s, g in zip(speed, slope)]
        weights = [w + s for w, s in zip(weights, speed)]
    return weights


def test_the_query_is_the_slow_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    every = {r["doc_id"]: facts(r["text"] or "") for r in rows}
    assert len(every) == len(rows) <= Q.TRAIN_DOCS
    ids = sorted(every)
    posterior = dict(zip(ids, slow_em([votes(every[d]) for d in ids])))
    vectors = {d: vector(every[d]) for d in ids}
    weights = slow_scorer([vectors[d] for d in ids], [posterior[d] for d in ids])
    got = {r["doc_id"]: r for r in QUERIES["op10_quality_model"](spark, SF).collect()}
    assert set(got) == set(ids)
    for d in ids:
        score = 1 / (1 + math.exp(-max(-30, min(30, sum(weights[k] * v for k, v in vectors[d].items()) + weights[-1]))))
        assert got[d]["weak_label"] == pytest.approx(posterior[d], abs=1e-6)
        assert got[d]["score"] == pytest.approx(score, abs=5e-3)
        if abs(score - Q.KEEP) > 5e-3:
            assert got[d]["kept"] == (score >= Q.KEEP or every[d]["n"] == 0)


def test_votes_and_features_of_odd_texts():
    import random

    rng = random.Random(8)
    texts = ["", " ", "é" * 50, "A B C " * 20, "word " * 40, "!? " * 30, "| a " * 40, "\x00\x01 tab\tnew\nline"]
    texts += ["".join(rng.choice("abAB12 .,!?#$|<>\"'()-\n\té") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    for t in texts:
        f, plain = Q.Facts(t), facts(t)
        assert Q.votes(f) == votes(plain), t
        slots, values = Q.features(f)
        x = {}
        for k, v in zip(slots.tolist(), values.tolist()):
            x[k] = x.get(k, 0) + v
        assert x == pytest.approx(vector(plain)), t
