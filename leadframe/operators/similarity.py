"""Similar-name candidates: lossless signatures and the exact similarity test.

Two names match when the Ratcliff-Obershelp ratio ``2M / (|a| + |b|)`` reaches
a threshold t.  The M matched characters form a common subsequence made of at
most ``1 + T - 2M`` blocks (T = |a| + |b|), so the names share at least
``3M - 1 - T`` bigrams, counted with multiplicity.  With a shared total order of
tokens, rarest first, that makes prefixes of the token lists overlap: names that
share c tokens have at least k common ones among the first ``n - c + k`` of each
(prefix filter, Chaudhuri et al. 2006; k > 1 after Wang et al. 2012).  Names of
ordinary length use pairs of tokens (k = 2) as keys, which are far more
selective than single ones.

Within one run names meet as arrays instead (``near``): three bounds of the ratio, each for many pairs at
once, leave hardly more than the pairs that match.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations
from math import ceil, floor
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPS = 1e-9
# Longest name that uses pair keys: bounds the number of keys per name.
_MAX_PAIRED = 32
# Number of most frequent tokens whose order is known; the size of the table
# that travels with the signature function.
_RANKED_TOKENS = 4096


def length_ratio(t: float) -> float:
    """Smallest length ratio of two names that can match."""
    return t / (2.0 - t)


def _needed(t: float, total: int) -> int:
    return ceil(t * total / 2 - _EPS)


def _feasible(t: float, n: int, m: int) -> bool:
    """Can different names of these lengths match at all?"""
    need = _needed(t, n + m)
    return need <= min(n, m) and not (n == m == need)


class Bounds:
    """Token size and guaranteed shared tokens for a threshold."""

    def __init__(self, t: float):
        if not 0.0 < t <= 1.0:
            raise ValueError("threshold must be in (0, 1]")
        self.t = t
        self._shared: dict[int, int] = {}
        self.ratio = length_ratio(t)
        self.gram = 2 if self._bigrams_suffice() else 1
        self.paired_from = next(
            (n for n in range(2, _MAX_PAIRED + 1)
             if all(self.shared(m) >= 2 for m in range(n, 2 * _MAX_PAIRED))),
            _MAX_PAIRED + 1,
        )

    def _bigrams_suffice(self) -> bool:
        growth = 1.5 * self.t - 1.0
        if growth <= 0.1:
            return False
        # beyond this total length the linear bound alone gives one bigram
        limit = ceil(2.0 / growth) + 2
        return all(
            3 * _needed(self.t, n + m) - 1 - (n + m) >= 1
            for n in range(1, limit)
            for m in range(n, limit - n + 1)
            if _feasible(self.t, n, m)
        )

    def partner_range(self, n: int) -> tuple[int, int]:
        return ceil(n * self.ratio - _EPS), floor(n / self.ratio + _EPS)

    def shared(self, n: int) -> int:
        """Tokens a name of length n shares with any name it can match."""
        if n not in self._shared:
            low, high = self.partner_range(n)
            found = [self.shared_by(n, m) for m in range(low, high + 1) if _feasible(self.t, n, m)]
            self._shared[n] = min(found, default=1)
        return self._shared[n]

    def shared_by(self, n: int, m: int) -> int:
        """Tokens that two matching names of these lengths share."""
        need = _needed(self.t, n + m)
        return max(1, need if self.gram == 1 else 3 * need - 1 - (n + m))

    def paired(self, n: int) -> bool:
        return self.paired_from <= n <= _MAX_PAIRED

    def single(self, n: int) -> bool:
        """Single-token keys: for names that may match a name without pair keys."""
        low, high = self.partner_range(n)
        return not (self.paired(n) and self.paired(low) and self.paired(high))


def signature_keys(name: str, bounds: Bounds, rank: dict[str, int]) -> list[str]:
    """Block keys of a name: every different name it can match has one of them."""
    n, g = len(name), bounds.gram
    seen: Counter[str] = Counter()
    tokens = []
    for i in range(n - g + 1):
        gram = name[i : i + g]
        tokens.append((rank.get(gram, -1), gram, seen[gram]))
        seen[gram] += 1
    tokens.sort()
    words = [f"{gram}{count or ''}" for _, gram, count in tokens]
    spare = len(words) - min(bounds.shared(n), len(words))
    keys = []
    if bounds.single(n):
        keys.extend(words[: spare + 1])
    if bounds.paired(n):
        keys.extend(f"{a}\t{b}" for a, b in combinations(words[: spare + 2], 2))
    return keys


def token_ranks(names: DataFrame, bounds: Bounds) -> dict[str, int]:
    """Order of the most frequent tokens; unlisted ones count as rarest.

    Any order is lossless, so a fixed number of ranks is enough; the result is
    at most ``_RANKED_TOKENS`` rows, whatever the size of the data.
    """
    chars = F.split("name", "")
    if bounds.gram == 1:
        grams = chars
    else:
        grams = F.zip_with(
            F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))),
            F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))),
            lambda a, b: F.concat(a, b),
        )
    counts = names.select(F.explode(grams).alias("gram")).groupBy("gram").count()
    top = counts.orderBy(F.col("count").desc(), "gram").limit(_RANKED_TOKENS).collect()
    return {r["gram"]: len(top) - i for i, r in enumerate(top)}


def signatures(name: Column | str, bounds: Bounds, rank: dict[str, int]) -> Column:
    @F.pandas_udf("array<string>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda s: signature_keys(s, bounds, rank))

    return keys(name)


#: Longs of 64 bits that hold the tokens of a name.
MARKS = 16


def _marked(name: str, gram: int) -> list[int]:
    """A bit for each token of a name, repeated ones by their number, as signed longs."""
    bits, seen = 0, Counter()
    for i in range(len(name) - gram + 1):
        token = name[i : i + gram]
        bits |= 1 << crc32(f"{token}{seen[token] or ''}".encode("utf-8", "surrogatepass")) % (64 * MARKS)
        seen[token] += 1
    return np.frombuffer(bits.to_bytes(8 * MARKS, "little"), "<i8").tolist()


def marks(name: Column | str, bounds: Bounds) -> Column:
    """The tokens of a name as ``MARKS`` longs: struct of m0, m1, ..."""
    gram, names = bounds.gram, [f"m{i}" for i in range(MARKS)]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def bits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_marked(s, gram) for s in batch], columns=names)

    return bits(name)


def may_share(a: str, b: str, bounds: Bounds) -> Column:
    """May the names of two aliases (len, m0, ...) share the tokens that different matching names do?

    A bit that one of them has alone is a token that they do not share.
    """
    total = F.col(f"{a}.len") + F.col(f"{b}.len")
    need = F.ceil(bounds.t * total / 2 - _EPS)
    shared = need if bounds.gram == 1 else 3 * need - 1 - total
    apart = sum(
        (F.bit_count(F.col(f"{a}.m{i}").bitwiseXOR(F.col(f"{b}.m{i}"))) for i in range(MARKS)), F.lit(0)
    )
    return apart <= total - 2 * (bounds.gram - 1) - 2 * F.greatest(shared, F.lit(0))


def is_similar(new: Column | str, kept: Column | str, t: float) -> Column:
    """Does the ratio of (new, kept) reach t?  The order matters."""

    @F.pandas_udf("boolean")
    def compare(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series(_compare_batch(left, right, t), dtype="bool")

    return compare(new, kept)


#: Bins that the characters of a name are counted in.
_BINS = 64


def _binned(names: list[str]) -> np.ndarray:
    """How many characters of each name fall in each bin."""
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.repeat(np.arange(len(names)), [len(x) for x in names])
    return np.bincount(at * _BINS + codes % _BINS, minlength=len(names) * _BINS).reshape(-1, _BINS)


def possible(new: pd.Series, kept: pd.Series, t: float) -> np.ndarray:
    """Which pairs may match: no more characters match than both names have, bin by bin."""
    (left, a), (right, b) = (pd.factorize(x) for x in (new, kept))
    one, two = _binned(list(a)), _binned(list(b))
    out = np.zeros(len(new), bool)
    for at in range(0, len(new), 8192):
        x, y = one[left[at : at + 8192]], two[right[at : at + 8192]]
        out[at : at + 8192] = 2 * np.minimum(x, y).sum(1) >= t * (x.sum(1) + y.sum(1)) - _EPS
    return out


def _compare_batch(new: pd.Series, kept: pd.Series, t: float) -> list[bool]:
    """Compare pairs; the index of a kept name is built once per run of it.

    Most pairs of a hot block fail on their counts of characters, which takes no loop over pairs.
    """
    hits = [False] * len(new)
    matcher, current = SequenceMatcher(None), None
    news, olds = new.tolist(), kept.tolist()
    for i in sorted(np.flatnonzero(possible(new, kept, t)).tolist(), key=olds.__getitem__):
        if olds[i] != current:
            current = olds[i]
            matcher.set_seq2(current)
        matcher.set_seq1(news[i])
        hits[i] = matcher.quick_ratio() >= t and matcher.ratio() >= t
    return hits


#: Columns of the most frequent characters of a table of names, and those that all others share.
_OWN, _SHARED = 224, 32
#: Words of 64 bits for the bigrams of a name; bins of its characters, the last one without a character.
_WORDS, _LETTERS = 16, 256
#: Rows and columns of a tile of pairs; longest names whose common subsequence is found for all pairs at once.
_ROWS, _COLUMNS, _SHORT, _LONG = 512, 2048, 64, 128


def _numbered(row: np.ndarray, token: np.ndarray) -> np.ndarray:
    """How often a token stands before in its row."""
    order = np.lexsort((token, row))
    r, t = row[order], token[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
    at = np.arange(len(r))
    out = np.empty(len(r), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return out


class Names:
    """Names as arrays, so that what two of them share is bounded for many pairs at once.

    ``counts``: a character and its number in the name have a column, so the product of two rows is the
    number of characters both names have; rare ones share columns, which can only raise it.  ``bits``:
    the bigrams as in ``marks``.  ``letters``: the characters in order.  ``like``: names whose columns are used.
    """

    def __init__(self, names: list[str], like: Names | None = None):
        n = len(names)
        self.names = np.array(names, object)
        self.len = np.fromiter(map(len, names), np.int64, n)
        codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(n), self.len)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.len) - self.len, self.len)
        token = codes << 32 | _numbered(row, codes)
        if like is None:
            self.tokens, count = np.unique(token, return_counts=True)
            rank = np.empty(len(count), np.int64)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
            self.columns = np.where(rank < _OWN, rank, _OWN + rank % _SHARED)
        else:
            self.tokens, self.columns = like.tokens, like.columns
        width = _OWN + _SHARED
        if len(self.tokens):
            at = np.searchsorted(self.tokens, token).clip(max=len(self.tokens) - 1)
            known = self.tokens[at] == token  # others are in no name of ``like``
            cells = row[known] * width + self.columns[at[known]]
        else:
            cells = np.zeros(0, np.int64)
        self.counts = np.bincount(cells, minlength=n * width).reshape(n, width).astype(np.float32)
        self.bits = np.zeros(n * _WORDS, np.uint64)
        same = row[1:] == row[:-1]
        grams, home = (codes[:-1] << 21 | codes[1:])[same], row[1:][same]
        mixed = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed + _numbered(home, grams).astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        bit = (mixed >> np.uint64(54)).astype(np.int64) % (64 * _WORDS)
        np.bitwise_or.at(self.bits, home * _WORDS + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
        self.bits = self.bits.reshape(n, _WORDS)
        self.letters = np.full((n, _LONG), _LETTERS, np.uint16)
        short = place < _LONG
        self.letters[row[short], place[short]] = codes[short] % _LETTERS

    def __len__(self) -> int:
        return len(self.names)

    def take(self, rows: np.ndarray) -> Names:
        """Some of the names."""
        out = object.__new__(Names)
        out.tokens, out.columns = self.tokens, self.columns
        for part in ("names", "len", "counts", "bits", "letters"):
            setattr(out, part, getattr(self, part)[rows])
        return out

    def places(self) -> np.ndarray:
        """A bit for each place of each bin of characters, one row of bins per name; of short names only."""
        n, wide = len(self), _LETTERS + 1
        out = np.zeros(n * wide, np.uint64)
        for k in range(min(_SHORT, int(self.len.max(initial=0)))):
            out[np.arange(n) * wide + self.letters[:, k]] |= np.uint64(1 << k)
        out.reshape(n, wide)[:, _LETTERS] = 0
        return out


def _common(later: Names, i: np.ndarray, earlier: Names, j: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of bins of pairs of names, or more (bit-parallel, Hyyro 2004)."""
    found = np.full(len(i), np.iinfo(np.int64).max)
    ready = np.flatnonzero((later.len[i] <= _LONG) & (earlier.len[j] <= _SHORT))
    for at in range(0, len(ready), 32768):
        pairs = ready[at : at + 32768]
        one, two = i[pairs], j[pairs]
        base = two * (_LETTERS + 1)
        row = np.full(len(pairs), ~np.uint64(0))
        for k in range(int(later.len[one].max())):
            met = row & places[base + later.letters[one, k]]
            row = (row + met) | (row - met)
        inside = np.where(earlier.len[two] < 64, (np.uint64(1) << (earlier.len[two] % 64).astype(np.uint64)), 0)
        found[pairs] = np.bitwise_count(~row & (inside.astype(np.uint64) - np.uint64(1)))
    return found


def _subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence of two names of any length."""
    places: dict[str, int] = {}
    for k, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << k
    whole = row = (1 << len(b)) - 1
    for c in a:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & whole
    return len(b) - row.bit_count()


def near(later: Names, earlier: Names, bounds: Bounds) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of later, rows of earlier) that may match, those with most in common first in each part.

    All pairs of a tile are multiplied; those with too few common characters, then bigrams, then too short a
    common subsequence are out.  Each of the three is a bound for the ratio, so no pair that matches is lost.
    """
    t, r = bounds.t, bounds.ratio
    first, second = np.argsort(later.len, kind="stable"), np.argsort(earlier.len, kind="stable")
    lengths, places = earlier.len[second], earlier.places()
    other = earlier.counts[second].T.copy()
    for at in range(0, len(first), _ROWS):
        rows = first[at : at + _ROWS]
        own, own_len = later.counts[rows], later.len[rows]
        low = np.searchsorted(lengths, own_len[0] * r - _EPS)
        high = np.searchsorted(lengths, own_len[-1] / r + _EPS, "right")
        parts = []
        for start in range(low, high, _COLUMNS):
            end = min(start + _COLUMNS, high)
            shared = own @ other[:, start:end]
            shared -= (own_len * (t / 2)).astype(np.float32)[:, None]
            over = shared >= (lengths[start:end] * (t / 2 - 1e-4) - 0.01).astype(np.float32)  # for roundings
            cells = np.flatnonzero(over)
            i, j = rows[cells // (end - start)], second[start + cells % (end - start)]
            total = later.len[i] + earlier.len[j]
            need = np.ceil(t * total / 2 - _EPS).astype(np.int64)
            if bounds.gram == 2:
                grams = np.maximum(3 * need - 1 - total, 0)
                apart = np.bitwise_count(later.bits[i] ^ earlier.bits[j]).sum(1, dtype=np.int64)
                good = apart <= total - 2 - 2 * grams
                cells, i, j, need = cells[good], i[good], j[good], need[good]
            good = _common(later, i, earlier, j, places) >= need
            parts.append((i[good], j[good], shared.ravel()[cells[good]]))
        if parts:
            i, j, most = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(-most, kind="stable")
            yield i[order], j[order]


class Pairs:
    """The exact test of pairs; the index of an earlier name is built once."""

    def __init__(self, bounds: Bounds):
        self.bounds, self.made = bounds, {}

    def alike(self, new: str, kept: str) -> bool:
        t = self.bounds.t
        if max(len(new), len(kept)) > _SHORT and 2 * _subsequence(new, kept) < t * (len(new) + len(kept)) - _EPS:
            return False
        matcher = self.made.get(kept)
        if matcher is None:
            if len(self.made) >= 2048:
                self.made.clear()
            matcher = self.made[kept] = SequenceMatcher(None, "", kept)
        matcher.set_seq1(new)
        return matcher.ratio() >= t
