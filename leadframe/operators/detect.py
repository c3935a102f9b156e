"""Technology signatures by one pass over the text, however many there are.

All literals of all signatures form one automaton; a text is read once and yields the
signatures whose literals stand in it.  A regular expression is only tried on texts that hold
its longest literal part.  Made for signature tables of hundreds of patterns and more; a few
dozen are quicker as substring probes in generated code (``enrich.technology_present``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants, _parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of all patterns together: they travel with the function, so a larger table is refused.
MAX_PATTERNS = 32 << 20


def _runs(parsed) -> Iterator[str]:
    """Literal runs that every match of a parsed expression holds."""
    run: list[str] = []
    for kind, value in parsed:
        if kind is _constants.LITERAL:
            run.append(chr(value))
            continue
        yield "".join(run)
        run = []
        if kind is _constants.SUBPATTERN and not value[1] and not value[2]:
            yield from _runs(value[3])
        elif kind in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0] > 0:
            yield from _runs(value[2])
    yield "".join(run)


def required_literal(pattern: str) -> tuple[str, bool]:
    """The longest literal that every match holds, and whether the pattern is nothing else.

    Alternatives, classes and optional parts hold none; '' if there is no literal at all.
    """
    parsed = _parser.parse(pattern)
    whole = all(kind is _constants.LITERAL for kind, _ in parsed)
    if parsed.state.flags & ~re.UNICODE:  # a flag inside the pattern changes what its literals match
        return "", False
    return max(_runs(parsed), key=len), whole


class Detector:
    """Names of the signatures found in a text, in the order of the table."""

    def __init__(self, signatures: dict[str, list[str]]):
        import ahocorasick

        self.names = list(signatures)
        self.always: list[tuple[int, re.Pattern]] = []
        literals: dict[str, tuple[set[int], list[tuple[int, re.Pattern]]]] = {}
        for number, patterns in enumerate(signatures.values()):
            for pattern in patterns:
                literal, whole = required_literal(pattern)
                if not literal:
                    self.always.append((number, re.compile(pattern)))
                    continue
                plain, tried = literals.setdefault(literal, (set(), []))
                if whole:
                    plain.add(number)
                else:
                    tried.append((number, re.compile(pattern)))
        self.automaton = ahocorasick.Automaton()
        for literal, found in literals.items():
            self.automaton.add_word(literal, found)
        if literals:
            self.automaton.make_automaton()
        else:
            self.automaton = None

    def __call__(self, text: str) -> list[str]:
        found: set[int] = set()
        tried = list(self.always)
        seen: set[int] = set()
        for _, hit in self.automaton.iter(text) if self.automaton else ():
            if id(hit) not in seen:
                seen.add(id(hit))
                found |= hit[0]
                tried += hit[1]
        found |= {n for n, pattern in tried if n not in found and pattern.search(text)}
        return [self.names[n] for n in sorted(found)]


def technologies_in(text: Column | str, signatures: dict[str, list[str]]) -> Column:
    """Names of all signatures found in a text column; null for a null text."""
    size = sum(len(p) for patterns in signatures.values() for p in patterns)
    if size > MAX_PATTERNS:
        raise ValueError(f"patterns of {size} characters; one automaton takes {MAX_PATTERNS}")

    @F.pandas_udf("array<string>")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detector = Detector(signatures)
        for texts in batches:
            yield pd.Series([None if t is None else detector(t) for t in texts], dtype=object)

    return detect(text)
