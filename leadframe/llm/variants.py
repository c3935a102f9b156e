"""Spelling variants of the corpus' vocabulary, by a bit-sliced position index.

The vocabulary is compared in packs of about ``PACK`` words.  A pack holds, per position and
letter, the set of its words with that letter there, as bits.  All words of a pack run through
these sets at once: one recurrence tracks the words equal so far, two more those with one
replaced letter and, on shifted positions, those with one more letter, 64 words an operation.

Packs lose no pair.  Two near words agree left of their first difference and, behind the
differing letter, on the right.  Class ``c`` holds the words of ``c`` and ``c + 1`` letters; in it,
a span ``[lo, hi)`` says where the first difference lies, so the words of a pair share their
first ``lo`` and last ``c - hi`` letters.  Words that share them form a group; groups above
``LIMIT`` are split by halving their span, which lengthens what must be shared, down to one
position.  Each pair has one first difference, hence one group, and is counted once.  A group
returns a count and the best partner of each word, never its pairs.

Defined cases: null and empty texts have no words; very long texts and runs count whole; ties of
``n`` go to the smaller word in code-point order; repeated rows and equal texts count as often as
they stand; a null id is the empty string in the hash; an empty table gives an empty result;
further columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import small_batches, text_of
from leadframe.session import cut_lineage

#: Code points and occurrences of a word; a form has so many times the word's occurrences.
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: One run in so many loses a letter.
CUT = 97
#: Words of a pack, about; words of a group above which it is split.
PACK, LIMIT = 1024, 1024
#: Words that a task counts before it hands its counts on.
HELD = 500_000

#: Letters of a lower-cased text in Latin-1, where a byte is a code point.
_RUN = re.compile(rb"[a-z\xc0-\xff]+")


def words_in(doc_id: int | None, text: str) -> Counter:
    """Words of a text in Latin-1 with their number; letters beyond it end a run."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for run, n in Counter(_RUN.findall(text.encode("latin-1", "replace").lower())).items():
        if len(run) >= MIN_LENGTH:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % CUT == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= MIN_LENGTH:
                found[run] += n
    return found


_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task's texts with their number, in bounded parts."""
    total: Counter = Counter()

    def handed_on() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in total], pa.string())
        out = pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], schema=_COUNTS)
        total.clear()
        return out

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = batch.column("text")
        for k, doc_id in enumerate(ids):
            total.update(words_in(doc_id, texts[k].as_py()))
            if len(total) >= HELD:
                yield handed_on()
    yield handed_on()


def vocabulary(docs: DataFrame) -> DataFrame:
    """Words of the corpus with their number: (word, n)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    counts = rows.mapInArrow(_counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# --- groups ----------------------------------------------------------------------------------------


def _keyed(rows: DataFrame) -> DataFrame:
    """``key`` of what the words of a group share; equal hashes only join groups."""
    return rows.withColumn("key", F.expr(
        "xxhash64(c, lo, hi, substring(word, 1, lo), substring(word, length(word) - (c - hi) + 1))"
    ))


def _halves(rows: DataFrame, lo: str, hi: str) -> DataFrame:
    """Each row twice, its span cut in halves."""
    middle = f"int(({lo} + {hi}) div 2)"
    spans = F.expr(f"array(struct({lo} AS lo, {middle} AS hi), struct({middle} AS lo, {hi} AS hi))")
    return _keyed(rows.select("word", "n", "c", F.inline(spans)))


def grouped(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Words with the groups they are compared in: (word, n, c, lo, hi, key)."""
    classes = F.explode(F.array(F.length("word"), F.length("word") - 1))
    rows = words.select("word", "n", classes.alias("c")).where(F.col("c") >= MIN_LENGTH)
    level = cut_lineage(_halves(rows, "0", "c"))
    done = None
    while True:
        sizes = level.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("k"))
        hot = cut_lineage(sizes.where(F.col("k") > limit).select("key"))
        if hot.isEmpty():
            return done.unionByName(level) if done else level
        small = level.join(hot, "key", "left_anti")
        done = done.unionByName(small) if done else small
        level = cut_lineage(_halves(level.join(hot, "key", "left_semi"), "lo", "hi"))


def _packed(groups: DataFrame, pack: int = PACK) -> DataFrame:
    """Groups of a class and span together in packs of about ``pack`` words."""
    sizes = groups.groupBy("c", "lo", "hi").agg(F.ceil(F.count("*") / pack).alias("packs"))
    rows = groups.join(cut_lineage(sizes), ["c", "lo", "hi"])
    return rows.withColumn("pack", F.pmod(F.xxhash64("key"), F.col("packs")))


# --- one pack --------------------------------------------------------------------------------------


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as 64-bit words."""
    packed = np.packbits(flags, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def near_pairs(words: list[bytes], c: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words at one error whose first difference lies in the span.

    The first word of a pair has ``c`` letters, the second ``c`` or ``c + 1``.
    """
    lengths = np.array([len(w) for w in words])
    letters = np.zeros((len(words), c + 2), np.uint8)
    for k, w in enumerate(words):
        letters[k, : len(w)] = np.frombuffer(w, np.uint8)
    alphabet = np.unique(letters)
    code = np.searchsorted(alphabet, letters)
    short = np.flatnonzero(lengths == c)
    slices = lambda at: _bits(code[None, :, at] == np.arange(len(alphabet))[:, None])
    equal = np.full((len(short), len(_bits(np.ones((1, len(words)), bool))[0])), ~np.uint64(0))
    replaced, longer = np.zeros_like(equal), np.zeros_like(equal)
    here = slices(0)
    for j in range(c):
        there = slices(j + 1)
        same, shifted = here[code[short, j]], there[code[short, j]]
        replaced &= same
        longer &= shifted
        if lo <= j < hi:
            differs = equal & ~same
            replaced |= differs
            longer |= differs & shifted
        equal &= same
        here = there
    if hi == c:
        longer |= equal
    of_length = lambda n: _bits((lengths == n)[None])
    near = (replaced & of_length(c)) | (longer & of_length(c + 1))
    flags = np.unpackbits(near.view(np.uint8), axis=1, count=len(words), bitorder="little")
    one, two = np.nonzero(flags)
    return short[one], two


NEAR = "word string, n_near long, best_n long, best string"


def _of_pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Near words of each word of a pack: their number and the most frequent one."""
    c, lo, hi = (int(x) for x in key[:3])
    words = [w.encode("latin-1") for w in rows["word"]]
    one, two = near_pairs(words, c, lo, hi)
    # a pair of equal length comes from both sides, one of unequal length from the shorter word
    unequal = np.array([len(words[k]) > c for k in two], bool)
    word = np.concatenate([one, two[unequal]])
    other = np.concatenate([two, one[unequal]])
    n = rows["n"].to_numpy()
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, word, rank[other])
    counts = np.bincount(word, minlength=len(words))
    has = np.flatnonzero(counts)
    forms = [order[k] for k in best[has]]
    names = rows["word"].to_numpy()
    return pd.DataFrame({"word": names[has], "n_near": counts[has], "best_n": n[forms], "best": names[forms]})


# --- forms -----------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """Last form of each word (word, root), for (word, form): pointers double until none moves.

    A form has twice its word's occurrences, so chains end and have no cycles.
    """
    roots = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(roots.join(further, "root", "left"))
        if step.where("next IS NOT NULL").isEmpty():
            return roots
        roots = step.select("word", F.coalesce("next", "root").alias("root"))


def grouped_variants(docs: DataFrame, limit: int = LIMIT, pack: int = PACK) -> DataFrame:
    """Every word with its form, root, n, n_near and form_n."""
    small_batches(docs.sparkSession)
    words = cut_lineage(vocabulary(docs))
    packs = _packed(grouped(words, limit), pack)
    found = packs.groupBy("c", "lo", "hi", "pack").applyInPandas(_of_pack, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("of"), "best"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    has = F.coalesce(-F.col("b.of") >= RATIO * F.col("n"), F.lit(False))
    out = cut_lineage(words.join(found, "word", "left").select(
        "word", F.when(has, F.col("b.best")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, -F.col("b.of")).alias("form_n"),
    ))
    roots = _roots(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
