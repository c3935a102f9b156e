"""Document fingerprints by context-triggered piecewise hashing.

A rolling value over the last seven bytes decides where a chunk ends: where it is the last
residue modulo the block size.  Each chunk gives one of 64 characters from its own hash; the
characters make the signature, once for the block size and once for twice that size.  The
block size follows from the length and is halved while the signature has less than half of its
most characters, so that a text of few distinct windows has chunks as well.  Two fingerprints
compare by edit distance where their block sizes are equal or one is twice the
other.

Defined cases: a null text counts as empty and has the fingerprint ``3::``; equal fingerprints
are alike to 1.0 (empty ones included); signatures without a common run of ``COMMON``
characters, and fingerprints of incompatible block sizes, are alike to 0.0; rows with one id, or
none, follow each other by a hash of their text, then the text; a table with one row has itself as
its next; a very long text is held in memory with the one after it; an empty table gives an empty
result; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import small_batches, text_of

WINDOW = 7
MIN_BLOCK = 3
#: Most characters of a signature, and the common run two signatures must have.
LENGTH, COMMON = 64, 4
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT, _TOP = np.uint64(29), np.uint64(58)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _ODD
    return x ^ (x >> _SHIFT)


#: One pseudo-random value per byte, and a weight per place of the window.
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _MIX)
_PLACE = _mixed(np.arange(1001, 1001 + WINDOW, dtype=np.uint64) * _MIX) | np.uint64(1)


def _rolling(values: np.ndarray) -> np.ndarray:
    """A value for each byte from it and the six bytes before."""
    out = values * _PLACE[0]
    for k in range(1, min(WINDOW, len(values))):
        out[k:] += values[:-k] * _PLACE[k]
    return (_mixed(out) >> np.uint64(32)).astype(np.uint32)


def _signature(rolled: np.ndarray, sums: np.ndarray, block: int, limit: int) -> str:
    """Characters of the chunks; what comes after the limit makes the last one."""
    ends = np.flatnonzero(rolled % np.uint32(block) == block - 1)[: limit - 1]
    ends = np.append(ends, len(rolled) - 1) if not len(ends) or ends[-1] < len(rolled) - 1 else ends
    at = sums[ends]
    at[1:] -= sums[ends[:-1]]
    lengths = np.diff(ends, prepend=-1).astype(np.uint64)
    return LETTERS[(_mixed(at + lengths * _MIX) >> _TOP).astype(np.intp)].tobytes().decode()


def fingerprint(text: str) -> str:
    """``block size:signature:signature of twice the block size``."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return f"{MIN_BLOCK}::"
    values = _BYTE[data]
    rolled = _rolling(values)
    # a chunk's hash is a sum of windows, so that the order of its bytes counts
    sums = np.cumsum(_mixed(rolled.astype(np.uint64) * _MIX))
    block = MIN_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    one = _signature(rolled, sums, block, LENGTH)
    while block > MIN_BLOCK and len(one) < LENGTH // 2:
        block //= 2
        one = _signature(rolled, sums, block, LENGTH)
    return f"{block}:{one}:{_signature(rolled, sums, 2 * block, LENGTH // 2)}"


def _distance(a: str, b: str) -> int:
    """Edit distance by insertions and deletions, bit-parallel over the shorter signature."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return len(a) + len(b) - 2 * common


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    runs = {a[i : i + COMMON] for i in range(len(a) - COMMON + 1)}
    if not any(b[i : i + COMMON] in runs for i in range(len(b) - COMMON + 1)):
        return 0.0
    return 1.0 - _distance(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    if a == b:
        return 1.0
    size_a, one_a, two_a = a.split(":")
    size_b, one_b, two_b = b.split(":")
    n, m = int(size_a), int(size_b)
    if n == m:
        return max(_alike(one_a, one_b), _alike(two_a, two_b))
    if n == 2 * m:
        return _alike(one_a, two_b)
    return _alike(two_a, one_b) if m == 2 * n else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


# --- Spark -------------------------------------------------------------------------------

#: Rows of a range, on average; ranges at most, apart from those that single ids are cut in.
RANGE_ROWS, RANGES = 2000, 20_000
#: Bits of a text's hash.
_HASH_BITS = 46


class _Cuts:
    """Ranges in the order of rows: by descending id, and by hash within an id of many rows."""

    def __init__(self, ends: list[int], parts: dict[int, int]):
        """``ends``: highest id of each range; ``parts``: how many ranges a single id is cut in."""
        self.rising = np.array(sorted(ends), dtype=np.int64)
        self.parts = np.array([parts.get(e, 1) for e in self.rising.tolist()], dtype=np.int64)
        after = np.cumsum(self.parts[::-1])[::-1]
        self.first = after - self.parts  # ranges of higher ids come first

    def index(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.rising, ids)
        return self.first[at] + (hashes * self.parts[at] >> _HASH_BITS)


def _cuts(rows: DataFrame) -> _Cuts | None:
    """Ranges of similar size for rows (key, hash); None without rows.

    Only as many numbers as there are ranges come to the driver.
    """
    n = rows.count()
    if not n:
        return None
    size = max(RANGE_ROWS, n // RANGES)
    parts = max(1, n // size)
    cuts = [k / parts for k in range(1, parts + 1)]
    ends = set(rows.agg(F.percentile_approx("key", cuts, 10 * parts).alias("q")).first()["q"])
    ends.add(rows.agg(F.max("key")).first()[0])
    # an id of more rows than a range has ranges of its own: at most as many ids as ranges
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > size).collect()
    for r in hot:
        ends |= {r["key"]} | ({r["key"] - 1} if r["key"] > LOWEST else set())
    return _Cuts(sorted(ends), {r["key"]: -(-r["n"] // size) for r in hot})


def _index(cuts: _Cuts):
    @F.pandas_udf("long")
    def index(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(cuts.index(ids.to_numpy(np.int64), hashes.to_numpy(np.int64)))

    return index


#: Stands for a null id: the last of the order.
LOWEST = -(2**63)

COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def compared(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    One shuffle: rows go by ranges of ids, and within an id of many rows by hash; the first row of
    each range goes to the range before it too, where it serves as the next document of the last
    row.  A null id counts as the lowest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text")).withColumns({
        "key": F.coalesce("doc_id", F.lit(LOWEST)),
        "hash": F.shiftrightunsigned(F.xxhash64("text"), 64 - _HASH_BITS),
    })
    cuts = _cuts(rows.select("key", "hash"))
    if cuts is None:
        return spark.createDataFrame([], COLUMNS)
    rows = rows.withColumn("part", _index(cuts)("key", "hash"))
    order = F.struct(F.bitwise_not("key").alias("r"), "hash")
    heads = rows.groupBy("part").agg(F.min(order).alias("h")).orderBy("part").collect()  # one row a range
    filled = [r["part"] for r in heads]
    # a range's first row is also ahead of the range before; the very first one ends the last range
    before = [filled[k - 1] for k in range(len(heads))]
    first = spark.createDataFrame(
        [(~r["h"]["r"], r["h"]["hash"], b) for r, b in zip(heads, before)], "key long, hash long, part long")
    ahead = rows.drop("part").join(F.broadcast(first), ["key", "hash"])
    ahead = ahead.groupBy("part", "key", "hash").agg(F.min("text").alias("text")).select(
        "part", F.lit(1).alias("ahead"), F.col("key").alias("doc_id"), "key", "hash", "text")
    last = filled[-1]
    dealt = (
        rows.select("part", F.lit(0).alias("ahead"), "doc_id", "key", "hash", "text").unionByName(ahead)
        .repartitionById(last + 1, F.col("part").cast("int"))
        .sortWithinPartitions("part", "ahead", F.desc("key"), "hash", "text")
    )
    return dealt.select("part", "ahead", "doc_id", "text").mapInPandas(_compare_rows, COLUMNS)


def _compare_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order, each with the one after it; a row that is only ahead ends its range."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    held = None
    for batch in batches:
        out = []
        for part, ahead, doc, text in zip(batch["part"], batch["ahead"], batch["doc_id"], batch["text"]):
            print_ = fingerprint(text)
            if held is not None and held[0] == part:
                out.append(_row(held, text, print_))
            held = None if ahead else (part, doc, text, print_)
        yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})


def _row(held: tuple, following: str, next_print: str) -> tuple:
    _, doc, text, own = held
    new = edited(text, following)
    changed = own if new == text else fingerprint(new)
    return (
        None if pd.isna(doc) else int(doc), len(text),
        hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, changed,
        likeness(own, changed), likeness(own, next_print),
    )
