"""License scan by a positional index of rare licence words.

Templates are notices with key phrases that must stand in them word for word.  A first pass over
all documents counts how many hold each template word.  Each template is then indexed under its
rarest words (highest inverse document frequency, until they make up ``INDEXED`` of its weight)
with their positions.

A file looks its words up in that index.  A hit at word ``p`` for position ``q`` of a template
places the template at ``p - q``; hits within a band of ``2 * SLACK`` places speak for the same
place.  A band whose hits leave no more weight missing than ``MATCH`` allows is verified: the
common subsequence of notice and file inside the band must reach ``MATCH`` of the notice's weight,
and all key phrases must stand there consecutively.  No band that passes the verification is
lost by the index, as a lost rare word would count as missing there too.

The base phrases are templates as well, found through their rarest word and verified word for
word; all their places count.

Defined cases: a null text counts as empty: no words, no places, empty labels, score 0; very long
texts are read in stretches that overlap by a template; overlapping places all count; equally rare
words are taken in order of the words; repeated rows and equal texts get equal results; an empty
table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import small_batches, text_of

#: Share of a notice's weight that must stand in the file; share that is indexed.
MATCH, INDEXED = 0.8, 0.5
#: Half the width of a band: words that may be missing or added inside a notice.
SLACK = 8
#: Words of all templates together; a longer list is refused, not cut.
MAX_WORDS = 20_000
#: Bytes that are cut into words at once, words that are looked up at once.
CHUNK, STRETCH = 1 << 20, 1 << 20


class Template(NamedTuple):
    label: str
    notice: str
    keys: tuple[str, ...]  # must stand in the file, word for word


# --- fixed values: phrases of the base -------------------------------------------------------------
BASE = [
    Template("mit", "under the mit license", ()),
    Template("apache-2", "apache license version 2", ()),
    Template("cc-by-nc", "cc by nc", ()),
]
# --- fixed values: sentences of public licence notices ---------------------------------------------
TEMPLATES = [
    Template("mit", "released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
             "and associated documentation files, to deal in the Software without restriction",
             ("permission is hereby granted free of charge", "without restriction")),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2")),
    Template("apache-2", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
             ("apache org licenses license 2 0",)),
    Template("gpl-2", "licensed under the GNU General Public License, version 2",
             ("gnu general public license", "version 2")),
    Template("gpl-3", "licensed under the GNU General Public License, version 3",
             ("gnu general public license", "version 3")),
    Template("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
             "published by the Free Software Foundation; either version 2 of the License",
             ("gnu general public license", "version 2 of the license")),
    Template("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
             "published by the Free Software Foundation, either version 3 of the License",
             ("gnu general public license", "version 3 of the license")),
    Template("lgpl-3", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
             "License as published by the Free Software Foundation, either version 3 of the License",
             ("gnu lesser general public license", "version 3 of the license")),
    Template("agpl-3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
             "License as published by the Free Software Foundation, either version 3 of the License",
             ("gnu affero general public license", "version 3 of the license")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met",
             ("redistribution and use in source and binary forms", "are permitted provided that")),
    Template("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to "
             "endorse or promote products derived from this software without specific prior written permission",
             ("endorse or promote products", "prior written permission")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
             "fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
             "all copies", ("with or without fee is hereby granted",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("mozilla public license", "v 2 0")),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will "
             "the authors be held liable for any damages arising from the use of this software",
             ("as is without any express or implied warranty",)),
    Template("cc-by", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License",
             ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
             ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
             ("creative commons attribution noncommercial",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
             "rights to this work", ("waived all copyright",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
]

#: Digits, letters and all beyond ASCII, in lower-cased UTF-8.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def words_of(text: str) -> Iterator[list[bytes]]:
    """Words of a text in order, in parts; only A-Z are lower-cased."""
    data = text.encode("utf-8", "surrogatepass").lower()
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + CHUNK)
        end = gap.start() if gap else len(data)
        yield _WORD.findall(data, at, end)
        at = end


def _words(text: str) -> list[bytes]:
    return [w for part in words_of(text) for w in part]


def vocabulary(templates: Iterable[Template]) -> list[bytes]:
    """All words of the templates, in order."""
    return sorted({w for t in templates for text in (t.notice, *t.keys) for w in _words(text)})


def coded(text: str, ids: dict[bytes, int]) -> np.ndarray:
    """Number of each word of a text, -1 for words that no template has."""
    parts = [np.array([ids.get(w, -1) for w in part], np.int32) for part in words_of(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def places(codes: np.ndarray, phrase: np.ndarray, lead: int) -> np.ndarray:
    """Where a phrase stands, from the places of its word at position ``lead``."""
    starts = np.flatnonzero(codes == phrase[lead]) - lead
    starts = starts[(starts >= 0) & (starts <= len(codes) - len(phrase))]
    for k, word in enumerate(phrase):
        starts = starts[codes[starts + k] == word]
    return starts


class _Entry:
    """A template with the weights of its words and its indexed positions."""

    def __init__(self, template: Template, ids: dict[bytes, int], weights: np.ndarray) -> None:
        code = lambda text: np.array([ids[w] for w in _words(text)], np.int32)
        self.label, self.notice, self.keys = template.label, code(template.notice), [code(k) for k in template.keys]
        self.weights = weights[self.notice]
        self.total = self.weights.sum()
        # numbers follow the order of words, so equally rare words keep that order
        order = sorted(range(len(self.notice)), key=lambda q: (-self.weights[q], self.notice[q], q))
        held = np.cumsum(self.weights[order])
        self.rare = order[: int(np.searchsorted(held, INDEXED * self.total)) + 1]
        self.leads = [int(np.argmax(weights[k])) for k in self.keys]
        self.lead = order[0]

    def share(self, codes: np.ndarray, start: int) -> float:
        """Weight of the common subsequence in the band from ``start``, as a share."""
        low, high = max(0, start), min(len(codes), start + 2 * SLACK + len(self.notice))
        part = codes[low:high]
        best = np.zeros(len(part) + 1)
        for q, word in enumerate(self.notice):
            shift = low + np.arange(len(part)) - q - start
            equal = (part == word) & (shift >= 0) & (shift < 2 * SLACK)
            step = best.copy()
            step[1:] = np.maximum(step[1:], best[:-1] + self.weights[q] * equal)
            best = np.maximum.accumulate(step)
        return float(best[-1] / self.total)

    def holds_keys(self, codes: np.ndarray, start: int) -> bool:
        part = codes[max(0, start) : start + 2 * SLACK + len(self.notice)]
        return all(len(places(part, k, lead)) for k, lead in zip(self.keys, self.leads))


class Index:
    """Positions of the templates' rarest words."""

    def __init__(self, base: list[Template], templates: list[Template], weights: dict[bytes, float]) -> None:
        self.ids = {w: k for k, w in enumerate(sorted(weights))}
        values = np.array([weights[w] for w in sorted(weights)])
        self.base = [_Entry(t, self.ids, values) for t in base]
        self.entries = [_Entry(t, self.ids, values) for t in templates]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, e in enumerate(self.entries):
            for q in e.rare:
                self.postings.setdefault(int(e.notice[q]), []).append((t, q))
        self.rare = np.zeros(len(values) + 1, bool)
        self.rare[[w + 1 for w in self.postings]] = True
        self.longest = max((len(e.notice) for e in self.entries), default=0) + 2 * SLACK

    def _bands(self, codes: np.ndarray) -> Iterator[tuple[_Entry, int]]:
        """Bands of a stretch whose rare words leave little enough missing."""
        at = np.flatnonzero(self.rare[codes + 1])
        hits: dict[int, list[tuple[int, np.ndarray]]] = {}
        for word in np.unique(codes[at]):
            where = at[codes[at] == word]
            for t, q in self.postings[int(word)]:
                hits.setdefault(t, []).append((q, where - q))
        for t, found in sorted(hits.items()):
            e = self.entries[t]
            missing = (1 - MATCH) * e.total
            sought = e.weights[e.rare].sum()
            if sought - sum(e.weights[q] for q, _ in found) > missing:
                continue
            # a hit speaks for the band that begins in its own SLACK places and for the one before
            bands = [np.unique(np.concatenate([d // SLACK, d // SLACK - 1])) for _, d in found]
            votes = np.repeat([e.weights[q] for q, _ in found], [len(b) for b in bands])
            band, inverse = np.unique(np.concatenate(bands), return_inverse=True)
            enough = np.bincount(inverse, votes) >= sought - missing - 1e-9
            for b in band[enough]:
                yield e, int(b) * SLACK

    def labels(self, codes: np.ndarray) -> dict[str, float]:
        """Labels of the verified notices and the best share of each."""
        out: dict[str, float] = {}
        for at in range(0, len(codes), STRETCH):
            part = codes[max(0, at - self.longest) : at + STRETCH + self.longest]
            for e, start in self._bands(part):
                if out.get(e.label, 0) < 1 and e.holds_keys(part, start):
                    share = e.share(part, start)
                    if share >= MATCH - 1e-9:
                        out[e.label] = max(out.get(e.label, 0), min(share, 1.0))
        return out

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score of a text."""
        codes = coded(text, self.ids)
        found = [(e.label, places(codes, e.notice, e.lead)) for e in self.base]
        starts = np.concatenate([np.empty(0, np.int64), *(p for _, p in found)])
        base = {label for label, p in found if len(p)}
        more = self.labels(codes)
        first, last = (int(starts.min()), int(starts.max())) if len(starts) else (None, None)
        score = 1.0 if base else round(max(more.values(), default=0.0), 6)
        return (len(codes), len(starts), first, last, ",".join(sorted(base)),
                ",".join(sorted(base | set(more))), score)


# --- Spark -------------------------------------------------------------------------------------------


def weights_of(docs: DataFrame, words: list[bytes], text: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of the given words over all documents."""
    if len(words) > MAX_WORDS:
        raise ValueError(f"{len(words)} words of templates; the index takes {MAX_WORDS}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = {w: k for k, w in enumerate(words)}
        inside, texts = np.zeros(len(words), np.int64), 0
        for batch in batches:
            texts += len(batch)
            for t in batch["text"]:
                codes = np.unique(coded(t, ids))
                inside[codes[codes >= 0]] += 1
        yield pd.DataFrame({"word": np.arange(-1, len(words)), "n": np.append(texts, inside)})

    rows = docs.select(text_of(text).alias("text")).mapInPandas(count, "word int, n long")
    sums = dict(rows.groupBy("word").agg(F.sum("n").alias("n")).collect())  # one row a word
    texts = sums.get(-1, 0)
    return {w: float(np.log(1 + (texts + 1) / (sums.get(k, 0) + 1))) for k, w in enumerate(words)}


SCAN = ("n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double")


def scanned(
    docs: DataFrame, templates: list[Template] = TEMPLATES, base: list[Template] = BASE, text: str = "text"
) -> DataFrame:
    """Words, base places, labels and score of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    weights = weights_of(docs, vocabulary([*base, *templates]), text)
    held = spark.sparkContext.broadcast((list(map(tuple, base)), list(map(tuple, templates)), weights))

    @F.pandas_udf(SCAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        base, templates, weights = held.value
        index = Index([Template(*t) for t in base], [Template(*t) for t in templates], weights)
        names = [f.split()[0] for f in SCAN.split(", ")]
        for texts in batches:
            rows = pd.DataFrame([index.scan(t) for t in texts], columns=names)
            yield rows.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scan(text_of(text)).alias("s")).select("doc_id", "s.*")
