"""Quality classifier from weak labels.

Eight heuristic labellers vote for (1) or against (-1) a text, or abstain (0).  Expectation
maximisation on the counts of vote patterns (at most ``3 ** 8`` of them, whatever the size of
the corpus) estimates how each labeller votes on good and on bad texts and so the posterior of
each pattern.  Posterior labels of a bounded sample of documents train a linear scorer on hashed
features, which then scores every text: runs of three character classes, and how much a
text repeats, shouts or lacks common words.

Defined cases: a null text counts as empty (all labellers abstain, and it is kept unless the
scorer says otherwise); equal texts get equal scores; without any text the scorer stays at
zero; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import small_batches, text_of
from leadframe.llm.quality_rules import STOP_WORDS

#: Hashed features; documents that train the scorer (those whose hashed id comes first).
DIMENSIONS, TRAIN_DOCS = 1024, 4000
#: Rounds of expectation maximisation and of gradient descent, and its strength and pull.
EM_ROUNDS, ROUNDS, RATE, PULL = 100, 300, 2.0, 1e-4
N_LABELLERS = 8
#: Words from which shares of words say something.
LONG = 30
#: Belief in the labellers before any data, as a share of the texts: a vote is right.
BELIEF = 0.03
#: Score from which a text is kept.
KEEP = 0.4

_STOP = frozenset(w for line in STOP_WORDS.values() for w in line.split())
_SYMBOLS = b"#*$%&|<>"


def _classes() -> bytes:
    """A character class for each byte: lower, upper, digit, space, beyond ASCII, marks."""
    table = bytearray(range(256))
    for c in range(256):
        table[c] = (
            1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else
            4 if c in b" \t" else 5 if c in b"\n\r\x0b\x0c" else 1 if c >= 128 else
            6 if c in b".,;:" else 7 if c in b"!?" else 8 if c in b"#*$%&" else 9 if c in b"|<>" else
            10 if c in b"\"'()-" else 11
        )
    return bytes(table)


_CLASS = _classes()


class Facts:
    """Counts of a text that labellers and features share."""

    __slots__ = ("data", "n", "letters", "capitals", "symbols", "shouts", "bars", "stops", "repeats", "distinct", "chars")

    def __init__(self, text: str):
        self.data = text.encode("utf-8", "replace")
        words = text.split()
        kinds = np.bincount(np.frombuffer(self.data.translate(_CLASS), np.uint8), minlength=12)
        self.n = len(words)
        self.chars = len(text)
        self.capitals = int(kinds[2])
        self.letters = int(kinds[1] + kinds[2])
        self.shouts = int(kinds[7])
        self.bars = self.data.count(b"|")
        self.symbols = int(kinds[8] + kinds[9]) - self.bars
        counts = Counter(words)
        self.stops = sum(n for w, n in counts.items() if w.lower() in _STOP)
        self.repeats = sum(map(eq, words, words[1:]))
        self.distinct = len(counts)


def votes(f: Facts) -> tuple[int, ...]:
    """Votes of the eight labellers: symbols, shouts, bars, capitals, stop words, repeats, variety,
    length.

    Six of them know one kind of bad text each and say nothing of others.
    """
    if not f.n:
        return (0,) * N_LABELLERS
    against = lambda x, share: -int(x > share * f.n)
    return (
        against(f.symbols, 0.25),
        against(f.shouts, 0.25),
        against(f.bars, 0.20),
        -int(f.capitals > 0.5 * f.letters),
        0 if f.n < LONG else -1 if f.stops < 0.05 * f.n else int(f.stops > 0.12 * f.n),
        0 if f.n < LONG else against(f.repeats, 0.20),
        -int(LONG <= f.n and f.distinct < 0.15 * min(f.n, 5000)),
        -1 if not 2.5 * f.n < f.chars < 16 * f.n else int(4.5 * f.n < f.chars < 7.5 * f.n),
    )


class Labellers:
    """Posterior of a good text for every vote pattern."""

    def __init__(self, patterns: Counter):
        """Expectation maximisation on pattern counts, started at the majority vote.

        ``table[j, c, v]`` is the chance that labeller ``j`` votes ``v - 1`` on class ``c``.
        """
        rows = np.array(sorted(patterns) or [(0,) * N_LABELLERS])
        weight = np.array([patterns.get(tuple(r), 0) for r in rows.tolist()], float)
        m = rows.shape[1]
        # start: a vote against counts more than one for, as bad texts are bad in one way each
        good = 1 / (1 + np.exp(4.0 * (rows == -1).sum(1) - 1.0 * (rows == 1).sum(1) - 1.0))
        belief = 1 + BELIEF * weight.sum() * np.array([[1.0, 1.0, 0.0], [0.0, 1.0, 1.0]])
        for _ in range(EM_ROUNDS):
            both = np.stack([1 - good, good], 1) * weight[:, None]
            prior = (both.sum(0) + 1) / (weight.sum() + 2)
            table = np.stack([[both[rows[:, j] == v].sum(0) for v in (-1, 0, 1)] for j in range(m)])
            table = np.moveaxis(table, 1, 2) + belief
            table /= table.sum(2, keepdims=True)
            logs = np.log(prior) + sum(np.log(table[j][:, rows[:, j] + 1]).T for j in range(m))
            good = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        self.prior, self.table = prior, table

    def posterior(self, pattern: tuple[int, ...]) -> float:
        logs = np.log(self.prior) + sum(np.log(self.table[j][:, v + 1]) for j, v in enumerate(pattern))
        return float(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50))))

    def accuracies(self) -> list[float]:
        """Of each labeller: how often it is right where it votes."""
        right = self.prior[0] * self.table[:, 0, 0] + self.prior[1] * self.table[:, 1, 2]
        wrong = self.prior[0] * self.table[:, 0, 2] + self.prior[1] * self.table[:, 1, 0]
        return (right / (right + wrong)).tolist()


def _slot(code: np.ndarray | int):
    return (np.asarray(code, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64)


_STEPS = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])


def features(f: Facts) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the hashed features and their values; the vector has length 1 or so."""
    kinds = np.frombuffer(f.data.translate(_CLASS), np.uint8).astype(np.int64)
    slots, values = np.empty(0, np.int64), np.empty(0)
    if len(kinds) >= 3:
        runs = np.bincount(kinds[:-2] * 144 + kinds[1:-1] * 12 + kinds[2:], minlength=1728)
        seen = np.flatnonzero(runs)
        slots, values = _slot(seen), np.sqrt(runs[seen] / len(kinds))
    if f.n >= LONG:
        shares = [f.stops / f.n, f.repeats / f.n, f.distinct / f.n, f.capitals / max(f.letters, 1)]
        marks = [10_000 + 100 * k + int(np.searchsorted(_STEPS, s)) for k, s in enumerate(shares)]
        slots = np.append(slots, _slot(marks))
        values = np.append(values, np.full(len(marks), 0.5))
    return slots, values


def train(rows: list[tuple[list[int], list[float], float]]) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer for soft labels, by gradient descent.

    Good and bad texts weigh the same in total, so that a rare class counts.
    """
    weights = np.zeros(DIMENSIONS + 1, np.float32)
    if not rows:
        return weights
    x = np.zeros((len(rows), DIMENSIONS + 1), np.float32)
    for i, (slots, values, _) in enumerate(rows):
        np.add.at(x[i], slots, values)
    x[:, -1] = 1
    y = np.array([r[2] for r in rows], np.float32)
    share = min(max(y.mean(), 0.01), 0.99)
    each = y / share + (1 - y) / (1 - share)
    each = (each / each.sum()).astype(np.float32)
    velocity = np.zeros_like(weights)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        velocity = 0.9 * velocity - RATE * (x.T @ (each * (p - y)) + PULL * weights)
        weights = weights + velocity
    return weights


def score(f: Facts, weights: np.ndarray) -> float:
    slots, values = features(f)
    return float(1 / (1 + np.exp(-np.clip(weights[slots] @ values + weights[-1], -30, 30))))


# --- Spark ---------------------------------------------------------------------------------------


class Model:
    def __init__(self, labellers: Labellers, weights: np.ndarray):
        self.labellers, self.weights = labellers, weights


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Labellers from the vote patterns of all documents, the scorer from a bounded sample."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def vote(texts: pd.Series) -> pd.Series:
        return pd.Series([list(votes(Facts(t))) for t in texts], dtype=object)

    rows = docs.select(vote(text_of(text)).alias("v"))
    # one row per pattern: 3 ** 8 at most
    patterns = Counter({tuple(r["v"]): r["n"] for r in rows.groupBy("v").agg(F.count("*").alias("n")).collect()})
    labellers = Labellers(patterns)

    @F.pandas_udf("slots array<int>, vals array<float>, label double")
    def example(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            f = Facts(t)
            slots, values = features(f)
            out.append((slots, values, labellers.posterior(votes(f))))
        return pd.DataFrame(out, columns=["slots", "vals", "label"])

    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    # at most TRAIN_DOCS ids are broadcast; as many rows of a few hundred numbers come back
    sample = docs.select("doc_id", text_of(text).alias("t")).join(F.broadcast(ids), "doc_id", "left_semi")
    got = sample.groupBy("doc_id").agg(F.min("t").alias("t")).select("doc_id", example("t").alias("e")).collect()
    ready = sorted((r["doc_id"], r["e"]["slots"], r["e"]["vals"], r["e"]["label"]) for r in got)
    return Model(labellers, train([r[1:] for r in ready]))


def scored(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """doc_id, posterior of its votes, score and whether it is kept, of every row."""
    model = fit(docs, text) if model is None else model
    small_batches(docs.sparkSession)

    @F.pandas_udf("weak_label double, score double, kept boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, float] = {}
        for texts in batches:
            out = []
            for t in texts:
                f = Facts(t)
                pattern = votes(f)
                if pattern not in known:
                    known[pattern] = model.labellers.posterior(pattern)
                s = score(f, model.weights)
                out.append((known[pattern], s, s >= KEEP or not f.n))
            yield pd.DataFrame(out, columns=["weak_label", "score", "kept"])

    return docs.select("doc_id", judge(text_of(text)).alias("j")).select("doc_id", "j.*")
