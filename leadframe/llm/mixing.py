"""Mixing to target weights with soft membership: DataFrame and SQL functions only.

A classifier fitted on labelled rows gives every document a posterior over domains: naive Bayes
on hashed words, its evidence scaled to ``EVIDENCE`` words so that long texts stay soft.  With
tokens ``t`` and posteriors ``p``, a document of rate ``w`` adds ``w * t * p[d]`` expected tokens
to domain ``d``.  Projected gradient steps fit nonnegative rates whose totals come closest to
the targets in the least squares sense, each domain's error weighed by the tokens it has.  One
step needs one sum per domain over all documents; rates are a function of the posterior
and of the steps' errors.  The rates are written after every ``SPAN`` steps, so the plan of a step
does not grow with the steps before it.

With weights ``1 / m[d]`` (``m[d]``: the tokens domain ``d`` has) and the inner product that
weighs documents by their tokens, the squared operator is a stochastic matrix: its
eigenvalues are at most 1, and steps of length 1 converge.

Defined cases: a null or empty text has no words, the prior as posterior and no influence; equal
texts get equal rates, however often they stand; a very long text is one document, its words weigh
``EVIDENCE`` at most; a domain with hardly any expected tokens (``REACH``) cannot be reached and is left out; a
language that is no domain has the posterior its words give, so it counts to the domains most like it;
without labelled rows all domains are equally likely; an empty table gives an empty result;
further columns of the input stay.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import SPACE_PATTERN, text_of, words_of
from leadframe.session import cut_lineage, discard

#: Domains of the registered query with their target shares of all tokens.
TARGETS = {"de": 0.14, "en": 0.60, "es": 0.11, "fr": 0.14, "junk": 0.01}
#: Labelled documents the classifier is fitted on (those whose hashed id comes first), word
#: buckets, and the words a posterior counts at most.
TRAIN_DOCS, BUCKETS, EVIDENCE = 4000, 4096, 40
#: Steps at most, and the relative error at which they end.
STEPS, EXACT = 40, 1e-6
#: Steps that one plan holds at most, until the rates are written.
SPAN = 4
#: Share of all tokens below which a domain is out of reach: none of its documents is there.
REACH = 1e-4
#: Most tokens of a mix that keeps all documents, as a multiple of the tokens there are.
GROWTH = 2.0


def domains_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Domain of labelled documents: junk where the quality is 0, else the language."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    first = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    # at most TRAIN_DOCS rows are broadcast
    rows = docs.join(F.broadcast(first), "doc_id")
    return rows.select(
        "doc_id", text_of().alias("text"), F.when(F.col("quality") == 0, "junk").otherwise(F.col("lang")).alias("domain")
    )


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class Classifier:
    """Log prior of each domain, and log word weights relative to the first domain."""

    def __init__(self, domains: list[str], prior: list[float], weights: list[list[float]]):
        self.domains, self.prior, self.weights = domains, prior, weights


def fit(labelled: DataFrame, domains: list[str]) -> Classifier:
    """Naive Bayes on hashed words; at most one count per bucket and domain comes back."""
    rows = labelled.where(F.col("domain").isin(domains))
    n = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    words = rows.select("domain", F.explode(F.split("text", SPACE_PATTERN)).alias("w")).where("w <> ''")
    counts = [[1.0] * BUCKETS for _ in domains]
    for r in words.groupBy("domain", _bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n")).collect():
        counts[domains.index(r["domain"])][r["b"]] += r["n"]
    logs = [[math.log(c / sum(row)) for c in row] for row in counts]
    total = sum(n.values()) + len(domains)
    prior = [math.log((n.get(d, 0) + 1) / total) for d in domains]
    return Classifier(domains, prior, [[x - y for x, y in zip(row, logs[0])] for row in logs])


def _sum_over(indices: str, table: Column) -> Column:
    return F.aggregate(indices, F.lit(0.0), lambda a, i: a + F.get(table, i))


def with_posteriors(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with the words of each text (``_tokens``) and its posteriors (``_p``: array)."""
    buckets = F.transform(words_of(text_of(text)), _bucket)
    out = docs.withColumn("_buckets", buckets).withColumn("_tokens", F.size("_buckets").cast("long"))
    scale = F.least(F.lit(1.0), EVIDENCE / F.greatest(F.col("_tokens"), F.lit(1)))
    scores = [F.lit(model.prior[0])]
    for prior, row in list(zip(model.prior, model.weights))[1:]:
        # a literal of BUCKETS numbers: one constant of the plan
        table = F.split(F.lit(",".join(map(repr, row))), ",").cast("array<double>")
        scores.append(prior + scale * _sum_over("_buckets", table))
    out = out.withColumn("_scores", F.array(*scores)).drop("_buckets")
    highest = F.array_max("_scores")
    out = out.withColumn("_e", F.transform("_scores", lambda s: F.exp(s - highest)))
    sum_ = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("_sum", sum_).withColumn(
        "_p", F.transform("_e", lambda x: x / F.col("_sum"))
    ).drop("_scores", "_e", "_sum")


def _rate(steps: list[list[float]], least: float = 0.0, start: Column | None = None) -> Column:
    """Rate after these steps: each subtracts the posterior's share of the errors, down to ``least``."""
    rate = F.lit(1.0) if start is None else start
    for errors in steps:
        move = reduce(Column.__add__, [F.get("_p", F.lit(d)) * e for d, e in enumerate(errors)])
        rate = F.greatest(F.lit(least), rate - move)
    return rate


def grown(have: list[float], goal: list[float], growth: float = GROWTH) -> list[float]:
    """Totals at least ``have``, and in the goal's proportions as far as ``growth`` allows.

    The goal is scaled up until the domain that would shrink most keeps its tokens; if that is more
    than ``growth`` times all tokens, domains are raised to the highest common multiple of the goal
    that is not, and those above it stay as they are.
    """
    level = max((m / g for m, g in zip(have, goal) if g > 0), default=1.0)
    raised = lambda x: [max(m, x * g) for m, g in zip(have, goal)]
    budget = growth * sum(have)
    if sum(raised(level)) > budget:
        low, high = 0.0, level
        for _ in range(60):
            level = (low + high) / 2
            low, high = (level, high) if sum(raised(level)) <= budget else (low, level)
        level = low
    return raised(level)


def fitted_steps(soft: DataFrame, targets: list[float], keep_all: bool = False) -> list[list[float]]:
    """Projected gradient steps that bring the expected totals to the target shares.

    The target total is that of the table; with ``keep_all`` no rate falls below 1, and the totals
    are those of ``grown``.
    """
    least = 1.0 if keep_all else 0.0

    def totals(rated: DataFrame) -> list[float]:
        sums = [F.sum(F.get("_p", F.lit(d)) * F.col("_tokens") * F.col("_rate")).alias(f"s{d}") for d in range(len(targets))]
        return [x or 0.0 for x in rated.agg(*sums).first()]

    rated = soft.select("_p", "_tokens", F.lit(1.0).alias("_rate"))
    have = totals(rated)
    reachable = [m > REACH * sum(have) for m in have]
    share = sum(t for t, r in zip(targets, reachable) if r) or 1.0
    goal = [sum(have) * t / share * r for t, r in zip(targets, reachable)]
    if keep_all:
        goal = grown(have, goal)
    steps: list[list[float]] = []
    now, written = have, None
    for _ in range(STEPS):
        errors = [(n - g) / m if r else 0.0 for n, g, m, r in zip(now, goal, have, reachable)]
        if max(map(abs, errors), default=0.0) < EXACT:
            break
        steps.append(errors)
        since = steps[(len(steps) - 1) // SPAN * SPAN :]
        after = rated.select("_p", "_tokens", _rate(since, least, F.col("_rate")).alias("_rate"))
        if len(since) == SPAN:
            after = rated = cut_lineage(after)
            if written is not None:
                discard(written)
            written = rated
        now = totals(after)
    if written is not None:
        discard(written)
    return steps


def _soft(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text: str, keep: list[str]) -> DataFrame:
    model = fit(labelled, list(targets))
    return cut_lineage(with_posteriors(docs, model, text).select(*keep, "_tokens", "_p"))


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, text: str = "text") -> DataFrame:
    """Every row's doc_id, source, n_tokens, posterior per domain (``p_...``) and rate."""
    soft = _soft(docs, labelled, targets, text, ["doc_id", "source"])
    steps = fitted_steps(soft, list(targets.values()))
    posts = [F.get("_p", F.lit(d)).alias(f"p_{name}") for d, name in enumerate(targets)]
    return soft.select("doc_id", "source", F.col("_tokens").alias("n_tokens"), *posts, _rate(steps).alias("rate"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, text: str = "text") -> DataFrame:
    """``docs`` in the fitted mix, nothing lost: each row as often as its rate says, once at least.

    The result has about ``GROWTH`` times the tokens of ``docs`` at most.  The part of a rate after
    the point becomes one more copy with that chance, drawn from a hash of the text.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    at = names[docs.columns.index(text)]
    soft = _soft(inner, labelled, targets, at, names)
    steps = fitted_steps(soft, list(targets.values()), keep_all=True)
    chance = F.pmod(F.xxhash64(F.lit(11), F.col(at)), F.lit(1 << 20)) / float(1 << 20)
    copies = F.greatest(F.lit(1), F.floor(_rate(steps, 1.0) + chance)).cast("int")
    return soft.withColumn("_k", F.explode(F.sequence(F.lit(1), copies))).select(*names).toDF(*docs.columns)
