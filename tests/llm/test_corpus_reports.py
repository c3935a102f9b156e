"""License scan, spelling variants and source divergence against brute force and in edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadframe.llm import divergence, licenses, variants
from leadframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LOW = {i: i + 32 for i in range(65, 91)}
DOC = "doc_id long, text string, lang string, source string"
CLASH = ["n", "word", "term", "held", "hash", "key", "c", "lo", "id", "p", "q", "part", "tile", "labels", "score"]


def docs(spark, texts, lang="en", clash=False):
    df = spark.createDataFrame([(i, t, lang, f"s{i % 3}") for i, t in enumerate(texts)], DOC)
    return df.withColumns({c: F.lit(1) for c in CLASH}) if clash else df


def keyed(df):
    return sorted(map(repr, df.collect()))


EDGES = [None, "", "  \n", "Hello", "word " * 30_000, "x" * 50_000, "Released under the MIT License.",
         "cc by nc cc by nc", "é ü 日本語 ABC", "Hello", "wörter Wörter worter wortern"] * 2


# --- 11 licenses -----------------------------------------------------------------------------------


def plain_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain_base(text):
    words, starts, labels = plain_words(text), [], set()
    for t in licenses.BASE:
        phrase = t.notice.split()
        hits = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        starts += hits
        labels |= {t.label} if hits else set()
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


BASE_COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels"]


def test_license_base_is_the_plain_scan(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_licenses"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in BASE_COLUMNS) == plain_base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
        if "GNU General Public License, version 3" in (texts[r["doc_id"]] or ""):
            assert r["labels"] == "gpl-3"


def index(weight=lambda w: 1.0 + len(w) % 5):
    words = licenses.vocabulary([*licenses.BASE, *licenses.TEMPLATES])
    return licenses.Index(licenses.BASE, licenses.TEMPLATES, {w: weight(w) for w in words})


def test_license_base_on_random_words():
    rng, found = random.Random(3), index()
    some = "under the mit license apache version 2 cc by nc MIT x é".split()
    for _ in range(3000):
        text = "".join(rng.choice(some) + rng.choice([" ", "-", "\n", ""]) for _ in range(rng.randint(0, 40)))
        assert found.scan(text)[:5] == plain_base(text)


def every_band(found, codes):
    """Labels by trying every band of every template."""
    out = {}
    for e in found.entries:
        last = len(codes) // licenses.SLACK + 1
        for b in range(-(len(e.notice) // licenses.SLACK) - 3, last):
            start = b * licenses.SLACK
            if e.holds_keys(codes, start) and e.share(codes, start) >= licenses.MATCH - 1e-9:
                out[e.label] = max(out.get(e.label, 0), min(e.share(codes, start), 1.0))
    return out


def edited(rng, words, rate):
    out = []
    for w in words:
        kind = rng.random()
        out += [] if kind < rate else ["other"] if kind < 2 * rate else [w, "more"] if kind < 3 * rate else [w]
    return out


def test_license_index_finds_what_trying_every_place_finds():
    rng, found, seen = random.Random(4), index(), 0
    for _ in range(150):
        words = ["filler"] * rng.randint(0, 30)
        for t in rng.sample(licenses.TEMPLATES, 2):
            words += edited(rng, t.notice.split(), rng.choice([0, 0.02, 0.06])) + ["gap"] * rng.randint(0, 12)
        codes = licenses.coded(" ".join(words), found.ids)
        assert found.labels(codes) == every_band(found, codes)
        seen += len(found.labels(codes))
    assert seen > 150


def test_license_notices_need_their_key_phrases():
    found = index()
    scan = lambda t: found.scan(t)[5]
    assert scan("This work is licensed under the GNU General Public License, version 3.") == "gpl-3"
    assert scan("This work is licensed under the GNU General Public License, version 2.") == "gpl-2"
    assert scan("the GNU project and a general remark on public license version numbers") == ""
    mit = licenses.TEMPLATES[1].notice
    assert scan(mit.replace("associated documentation files", "docs")) == "mit"
    assert scan(mit.replace("free of charge", "at no cost")) == ""


def test_license_in_a_long_text_over_stretches(monkeypatch):
    monkeypatch.setattr(licenses, "STRETCH", 50)
    monkeypatch.setattr(licenses, "CHUNK", 64)
    found = index()
    for k in range(0, 120, 7):
        text = "some words " * k + licenses.TEMPLATES[10].notice + " and more" * 40 + " under the MIT license"
        got = found.scan(text)
        assert got[5] == "bsd,mit" and got[:5] == plain_base(text)


def test_license_edges(spark):
    got = {r["doc_id"]: r for r in licenses.scanned(docs(spark, EDGES)).collect()}
    assert len(got) == len(EDGES)
    for i, t in enumerate(EDGES):
        assert tuple(got[i][c] for c in BASE_COLUMNS) == plain_base(t)
    assert keyed(licenses.scanned(docs(spark, EDGES))) == keyed(licenses.scanned(docs(spark, EDGES, clash=True)))
    assert licenses.scanned(docs(spark, [])).count() == 0
    none = docs(spark, EDGES).withColumn("doc_id", F.lit(None).cast("long"))
    assert licenses.scanned(none.union(none)).count() == 2 * len(EDGES)


# --- 12 spelling variants --------------------------------------------------------------------------


def plain_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    return {w: n for w, n in counts.items() if n >= 3}


def plain_variants(words):
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("limit,pack", [(variants.LIMIT, variants.PACK), (5, 20)])
def test_variants_are_those_of_brute_force(spark, limit, pack):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_variants(plain_vocabulary(df.select("doc_id", "text").collect()))
    got = [tuple(r) for r in variants.grouped_variants(df, limit, pack).collect()]
    assert set(got) == want and len(got) == len(want)


def test_variants_query_is_the_operator(spark):
    assert QUERIES["op12_variants"](spark, SF).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_of_one_letter_words_in_every_span(spark):
    """Runs of equal letters, where a letter more fits at several places, in groups of all sizes."""
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))): 3 + rng.randint(0, 40) for _ in range(400)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for limit in (3, 40, 5000):
        found = variants._packed(variants.grouped(df, limit), 64)
        found = found.groupBy("c", "lo", "hi", "pack").applyInPandas(variants._of_pack, variants.NEAR)
        got = {r["word"]: r["k"] for r in found.groupBy("word").agg(F.sum("n_near").alias("k")).collect()}
        assert got == {w: k for w, _, _, _, k, _ in plain_variants(words) if k}


def test_hot_groups_are_split(spark):
    """Thousands of words with the same beginning end in small groups, without their pairs."""
    words = [(f"common{a}{b}{c}", 3) for a in "abcdefghijklmnop" for b in "abcdefghijklmnop" for c in "abcdefghijkl"]
    groups = variants.grouped(spark.createDataFrame(words, "word string, n long"), 256)
    assert groups.groupBy("key").count().agg(F.max("count")).first()[0] <= 256
    assert groups.count() < 12 * len(words)


def test_near_words_one_by_one():
    words = [w.encode() for w in ("abcde", "abcdx", "xbcde", "abcdef", "aabcde", "abde", "abxcde", "abcdexy")]
    pairs = set()
    for lo, hi in ((0, 2), (2, 5)):
        one, two = variants.near_pairs([w for w in words if len(w) in (5, 6)], 5, lo, hi)
        kept = [w for w in words if len(w) in (5, 6)]
        found = [(kept[a].decode(), kept[b].decode()) for a, b in zip(one, two)]
        assert not pairs & set(found)
        pairs |= set(found)
    assert {b for a, b in pairs if a == "abcde"} == {"abcdx", "xbcde", "abcdef", "aabcde", "abxcde"}


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(37)]
    got = dict(variants._roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {w: "w37" for w, _ in chain}


def test_variant_edges(spark):
    rows = list(enumerate(EDGES))
    want = plain_variants(plain_vocabulary(rows))
    got = [tuple(r) for r in variants.grouped_variants(docs(spark, EDGES)).collect()]
    assert sorted(got) == sorted(want) and any(r[0] == "wörter" for r in want)
    assert keyed(variants.grouped_variants(docs(spark, EDGES, clash=True))) == sorted(
        map(repr, variants.grouped_variants(docs(spark, EDGES)).collect()))
    assert variants.grouped_variants(docs(spark, [])).count() == 0
    none = docs(spark, EDGES).withColumn("doc_id", F.lit(None).cast("long"))
    want = plain_variants(plain_vocabulary([(None, t) for t in EDGES]))
    assert sorted(tuple(r) for r in variants.grouped_variants(none).collect()) == sorted(want)


# --- 13 divergence ---------------------------------------------------------------------------------


def plain_divergence(rows):
    share = lambda n, total, size: 1 + 10**9 * (n + 1) // (total + size)
    out = set()
    rows = [tuple(x or "" for x in r) for r in rows]
    for lang in {r[1] for r in rows}:
        here = [(re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOW)), s) for t, x, s in rows if x == lang]
        in_docs = Counter(w for ws, _ in here for w in set(ws))
        kept = sorted(w for w, k in in_docs.items() if k >= 3)
        counts = {s: Counter() for _, s in here}
        for ws, s in here:
            counts[s].update(w for w in ws if in_docs[w] >= 3)
        size, whole = len(kept), sum(counts.values(), Counter())
        p = {s: {w: share(c[w], c.total(), size) for w in kept} for s, c in counts.items()}
        q = {w: share(whole[w], whole.total(), size) for w in kept}
        gap = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(-sum(gap(p[s][w], p[t][w]) for w in kept), t.encode(), t) for t in counts if t != s]
            out |= {(lang, s, "pair", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(pairs))}
            terms = [(-gap(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            out |= {(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(sorted(terms)[:200])}
    return out


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def audited(df):
    got = [tuple(r) for r in divergence.audited(df).select(COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(n, sources, seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "été", "x", "ñu", "delta", "日本"]
    texts = [" ".join(rng.choice(words) + str(rng.randint(0, 3)) * rng.randint(0, 1) for _ in range(rng.randint(0, 12)))
             for _ in range(n // 2)]
    pick = lambda some: rng.choice(some)
    return [(pick([*texts, None]), pick(["en", "fr", None]), pick([*(f"s{k}" for k in range(sources)), None, "é"]))
            for _ in range(n)]


@pytest.mark.parametrize("tile,terms,held", [(256, 2048, 500_000), (3, 2, 5)])
def test_divergence_is_the_dense_sum(spark, monkeypatch, tile, terms, held):
    """Also over several tiles and buckets, and with partial sums handed on all the time."""
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = corpus(300, 9, 6)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert audited(df) == plain_divergence(rows)


def test_divergence_tokenizes_equal_texts_once(spark):
    df = docs(spark, ["one two three"] * 50 + ["four"] * 7)
    got = divergence.collapsed(df).collect()
    assert sorted((r["text"], sum(h["m"] for h in r["held"]), len(r["held"])) for r in got) == [
        ("four", 7, 3), ("one two three", 50, 3)]


def test_divergence_edges(spark):
    rows = [(t, "en", f"s{i % 3}") for i, t in enumerate(EDGES)]
    assert audited(docs(spark, EDGES)) == plain_divergence(rows)
    assert audited(docs(spark, EDGES, clash=True)) == plain_divergence(rows)
    assert audited(docs(spark, [])) == set()
    few = [("only one", "en", "a"), ("and two", "en", "b"), (None, None, None)]  # no term in three documents
    df = spark.createDataFrame(few, "text string, lang string, source string")
    assert audited(df) == plain_divergence(few) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_shares_do_not_overflow(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**14, 10**9)], "n long, total long, size long")
    got = df.select(divergence._share(F.col("n"), F.col("total"), F.col("size"))).first()[0]
    assert got == 1 + 10**9 * (10**13 + 1) // (3 * 10**14 + 10**9)
    assert isinstance(got, int) and not isinstance(got, np.integer)
