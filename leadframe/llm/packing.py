"""Packing by best-fit decreasing: the tightest open window takes the next longest piece.

Documents become token ids with an end id; those longer than a window are first cut into full
windows.  Best-fit decreasing depends on the lengths alone, so it runs on the counts of pieces
per length (one number for each length up to the window): a segment tree indexed by remaining
capacity finds the tightest open windows, and all pieces of one length that go the same way
form one step.  The steps, at most a few per length and stretch of windows, are broadcast, and
each piece finds its window by its rank among the pieces of its length.  The result is the
packing that a sequential pass over all pieces would give.

Defined cases: a null or empty text has the end id only; repeated rows are packed one by one;
pieces of one length rank by a hash of id, place and content, then by these, so the
result does not depend on partitions; an empty table gives an empty result; further columns
do not matter.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadframe.llm.common import per_process, small_batches, text_of
from leadframe.session import cut_lineage

WINDOW = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers; it forgets all when there are more.
REMEMBERED = 1_000_000
#: Pieces of a length that are ranked in one part, about; all full windows have one length.
PART_ROWS = 50_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# --- token ids ---------------------------------------------------------------------------

#: Letters that stay one run of tokens, as text and as bytes, and such a word with marks after it.
_PLAIN = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")
_MARKED = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]+)")


class WordIds:
    """Token ids of texts, with the ids of words remembered.

    The vocabulary drops white space and no token spans it, so a text's ids are those of its
    words.  Words are lowered in ASCII before lookup, as the vocabulary lowers everything;
    texts that may hold special tokens (``<|``) are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[bytes]) -> None:
        """Remember the ids of these words; marks after letters are tokens of their own."""
        known = self.known
        marked = [(w, m[1], m[2]) for w in words if (m := _MARKED.fullmatch(w))]
        words.difference_update(w for w, _, _ in marked)
        words.update(part for _, *both in marked for part in both if part not in known)
        texts = [w.decode() for w in words]
        plain = [w for w in texts if _PLAIN.fullmatch(w)]
        if plain:
            # letters only: one run of tokens each, told apart by the index of the word
            got = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
            data = np.array(got.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted(np.array(got.word_ids), np.arange(len(plain) + 1))).tolist()
            known.update((w.encode(), data[a:b]) for w, a, b in zip(plain, cuts, cuts[1:]))
        if len(plain) < len(texts):
            known.update((w.encode(), self._encode(w)) for w in texts if not _PLAIN.fullmatch(w))
        known.update((w, known[a] + known[b]) for w, a, b in marked)

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers, without an end id."""
        if "<|" in text:
            return self._encode(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = text.encode("utf-8", "replace").lower().split()
        found = list(map(self.known.get, words))
        if None in found:
            self._learn({w for w, f in zip(words, found) if f is None})
            found = map(self.known.__getitem__, words)
        return b"".join(found)


def vocabulary_path(name: str) -> str:
    """Where a vocabulary file is on this machine; an absolute path stays."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(data: bytes, window: int) -> Iterator[tuple[int, int, int]]:
    """Start, length and checksum of a document's pieces: full windows, then the rest."""
    for start in range(0, len(data), 4 * window):
        piece = data[start : start + 4 * window]
        yield start // 4, len(piece) // 4, zlib.crc32(piece)


def tokenized(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens."""
    small_batches(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = vocabulary_path(vocabulary)
        words = per_process(f"ids of {path}", lambda: WordIds(path))
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            out = []
            for doc, t in zip(batch["doc_id"], batch["text"]):
                data = words.ids(t) + end
                doc = None if pd.isna(doc) else int(doc)
                out += [(doc, *p, len(data) // 4) for p in pieces_of(data, window)]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), text_of(text).alias("text")).mapInPandas(cut, PIECES)


# --- best fit on counts --------------------------------------------------------------------


class _Open:
    """Open windows by remaining capacity, and a segment tree over the capacities in use."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.used = [False] * (2 * self.size)
        self.stretches: list[deque[tuple[int, int]]] = [deque() for _ in range(window + 1)]

    def _mark(self, capacity: int, on: bool) -> None:
        i = self.size + capacity
        self.used[i] = on
        while i > 1:
            i //= 2
            self.used[i] = self.used[2 * i] or self.used[2 * i + 1]

    def add(self, capacity: int, first: int, n: int) -> None:
        """Windows ``first`` to ``first + n - 1`` have this much room left."""
        if capacity and n:
            if not self.stretches[capacity]:
                self._mark(capacity, True)
            self.stretches[capacity].append((first, n))

    def tightest(self, length: int) -> int | None:
        """The least capacity in use that is at least ``length``."""
        i = self.size + length
        if self.used[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """At most so many windows of the first stretch with this capacity."""
        first, n = self.stretches[capacity].popleft()
        if n > most:
            self.stretches[capacity].appendleft((first + most, n - most))
            n = most
        elif not self.stretches[capacity]:
            self._mark(capacity, False)
        return first, n


#: Pieces of a length with ranks from ``rank`` on: ``each`` of them go to a window, windows
#: count up from ``window``, the first of a window stands at ``offset``.
Step = tuple[int, int, int, int, int]  # length, rank, window, offset, each


def plan(counts: dict[int, int], window: int = WINDOW) -> list[Step]:
    """Best-fit decreasing of so many pieces per length, as steps by length and rank."""
    open_ = _Open(window)
    steps: list[Step] = []
    used = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = open_.tightest(length)
            if room is None:
                # no window fits: new ones, each filled before the next is opened
                room = window
                each = room // length
                first, n = used, max(1, left // each)
                used += n
            else:
                each = room // length
                first, n = open_.take(room, max(1, left // each))
            here = min(left, n * each)
            if here < n * each:
                each = here  # the last window of this length takes what is left
            steps.append((length, rank, first, window - room, each))
            open_.add(room - each * length, first, n)
            rank += here
            left -= here
    return steps


def _ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """The rank of each piece among those of its length, without sorting a length whole.

    A length is dealt in as many parts as it needs for about ``PART_ROWS`` pieces in each.
    """
    # one row per length: at most ``window`` rows
    parts = [(length, -(-n // PART_ROWS)) for length, n in sorted(counts.items())]
    table = pieces.sparkSession.createDataFrame(parts, "length long, _parts long")
    mixed = F.xxhash64("doc_id", "start", "ids_crc32")
    salted = pieces.join(F.broadcast(table), "length").withColumn("_salt", F.pmod(mixed, F.col("_parts")))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    own = salted.withColumn("_own", F.row_number().over(order) - 1)
    return own.join(sizes, ["length", "_salt"]).withColumn("rank", F.col("_own") + F.col("_before"))


def placed(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each piece with its sequence_id and offset."""
    spark = pieces.sparkSession
    small_batches(spark)
    # one row per length: at most ``window`` rows
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = np.array(plan(counts, window), dtype=np.int64).reshape(-1, 5)
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    shared = spark.sparkContext.broadcast(steps[order])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = shared.value
        far = np.int64(1) << 50  # ranks stay below this, so length and rank make one key
        at = np.searchsorted(s[:, 0] * far + s[:, 1], length.to_numpy() * far + rank.to_numpy(), "right") - 1
        step = s[at]
        nth = rank.to_numpy() - step[:, 1]
        return pd.DataFrame({
            "sequence_id": step[:, 2] + nth // step[:, 4],
            "offset": step[:, 3] + nth % step[:, 4] * step[:, 0],
        })

    return _ranked(pieces, counts).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", place("length", "rank").alias("p")
    ).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "p.sequence_id", "p.offset")


def packed(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """All documents packed: one row per piece.  Pieces are written once, then placed."""
    return placed(cut_lineage(tokenized(docs, window, vocabulary, text)), window)
