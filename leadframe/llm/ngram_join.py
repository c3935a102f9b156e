"""Self-join of texts by Jaccard similarity of their word 5-grams, by chosen paths.

Texts with equal 5-gram sets collapse to one set.  Each run of the join starts all sets at a
root; at a node, a set follows the tokens whose hash under that node falls below
``1 / (threshold * size)``, so two similar sets are expected to share at least one child.
Nodes with few sets are compared by brute force, larger ones are split further, down to
``DEPTH``.  Runs repeat until the chance that a pair at the threshold shares a compared node
in some run reaches ``RECALL``.  The recursion sees a consistent sample of each set's tokens
(``SAMPLE`` on average), the comparison all of them.

Each set that meets another has a home, its largest node, and a room, the largest home of those it
meets; rooms are cut into blocks by the number of their sets.  A block is compared with itself, and
with each other block it shares a node with; there, only the sets that share one take part.  Samples
decide which sets are near, whole sets which pairs reach the threshold.

The result is one row per row of the input with its class and its number of links to all others.
Besides, a block's sets are cut into stars: the text of each row reaches the threshold with the
star's own text, and the representative of a star lists the stars that hold a text linked to one of
its texts.  Classes are the components.

The links of a group of ``n`` near texts take ``n * n / 2`` comparisons by their nature.  They run in
matrix products of a block's size, dealt by pairs of blocks; Spark sees ``n / BLOCK_SETS`` rows a set.

Defined cases: null and empty texts, and those of white space, have no 5-grams: a class and a star
of their own without links; texts of fewer than five words have one token, all their words; texts
with equal words are copies, one set; repeated rows are copies too; a null id never becomes a class id or star id
unless all its rows are null; very long texts are one set like any other; an empty table gives
an empty result; further columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import small_batches, text_of
from leadframe.session import cut_lineage, discard

NGRAM, THRESHOLD = 5, 0.8
#: Chance that a pair at the threshold is found; depth of the recursion; sets of a small node.
RECALL, DEPTH, LIMIT = 0.9999, 3, 12
#: Tokens of a set that the recursion sees, on average.
SAMPLE = 96
#: Share of the larger sample that two samples must have in common to be compared in full.
SKETCH = 0.6
#: Sets and tokens of a block.
BLOCK_SETS, BLOCK_TOKENS = 1024, 1 << 18
#: Rows of a key above which they are dealt in ``SALTS`` parts.
HOT, SALTS = 4096, 16
#: Bits of the filter that drops rows of other keys before a shuffle: 2 MB, whatever the tables.
PLACES = 1 << 24

_U = np.uint64
_M1, _M2, _S1, _S2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(30), _U(27)
_STEP = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value of each 64-bit value."""
    x = x + _STEP
    x = (x ^ (x >> _S1)) * _M1
    x = (x ^ (x >> _S2)) * _M2
    return x ^ (x >> _U(31))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = mixed(np.arange(256, dtype=_U))
_PLACE = mixed(np.arange(1 << 10, 1 << 11, dtype=_U)) | _U(1)
_TURN = mixed(np.arange(77, 77 + 64, dtype=_U)) | _U(1)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit value for each word of a text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    at = np.flatnonzero(~_SPACE[data])
    if not len(at):
        return np.empty(0, _U)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    longest = int(lengths.max())
    weights = _PLACE if longest <= len(_PLACE) else mixed(np.arange(1024, 1024 + longest, dtype=_U)) | _U(1)
    sums = np.add.reduceat(_BYTE[data[at]] * weights[place], first)
    return mixed(sums + lengths.astype(_U) * _STEP)


def tokens(text: str, n: int = NGRAM) -> np.ndarray:
    """The set of word n-grams as sorted 64-bit values; one value for a shorter text."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(n, len(words))
    grams = np.zeros(len(words) - width + 1, _U)
    for k in range(width):
        grams += words[k : k + len(grams)] * _TURN[k]
    return np.unique(mixed(grams + _U(width)))


def set_id(grams: np.ndarray) -> bytes | None:
    """128 bits that tell sets apart; null for the empty set."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _below(share: float) -> int:
    return min(int(share * 2.0**64), 2**64 - 1)


def sample(grams: np.ndarray) -> bytes:
    """Tokens that the recursion sees: chosen by their own hash, alike in similar sets.

    32 bits of each are enough to follow paths and to estimate.
    """
    if len(grams) > SAMPLE:
        grams = grams[mixed(grams ^ _U(0x5EED)) < _U(_below(SAMPLE / len(grams)))]
    return np.unique(grams >> _U(32)).astype("<u4").tobytes()


def sampled(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(_U)


def children(grams: np.ndarray, nodes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes below ``nodes`` that a set goes to, one per chosen token, and the place of the node above each."""
    if not len(grams):
        return grams, np.empty(0, np.int64)
    value = mixed(grams ^ nodes[:, None])
    above, at = np.nonzero(value < _U(_below(1 / (threshold * len(grams)))))
    return mixed(value[above, at] ^ nodes[above] * _M1), above


def runs(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold meets with this chance.

    At the threshold a pair shares one child per node on average; with Poisson numbers of
    children, the chance to share a node at each depth follows from that of the depth below.
    """
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


# --- Spark: sets and recursion ---------------------------------------------------------------

SETS = "doc_id long, key long, set_id binary, n int, sample binary"


def _scan(docs: DataFrame, text: str, hashed: bool) -> DataFrame:
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch["text"]:
                grams = tokens(t)
                out.append((set_id(grams), len(grams), sample(grams)))
            sets = pd.DataFrame(out, columns=["set_id", "n", "sample"], index=batch.index)
            yield pd.concat([batch["doc_id"].astype("Int64"), batch[batch.columns[1:-1]], sets], axis=1)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text"))
    more = [F.xxhash64("text").alias("hash")] if hashed else []
    return rows.select("doc_id", _key(), *more, "text").mapInPandas(describe, SETS + ", hash long" * hashed)


def _follow(threshold: float):
    @F.pandas_udf("array<long>")
    def follow(samples: pd.Series, nodes: pd.Series) -> pd.Series:
        return pd.Series([
            children(sampled(s), np.asarray(ns, np.int64).view(_U), threshold)[0].view(np.int64)
            for s, ns in zip(samples, nodes)
        ])

    return follow


def _follow_twice(threshold: float):
    """Rows (sid, node, below): each node below those of a set, with the nodes below it."""

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sids, found, below = [], [], []
            for sid, data, nodes in zip(batch["sid"], batch["sample"], batch["nodes"]):
                grams = sampled(data)
                reached, _ = children(grams, np.asarray(nodes, np.int64).view(_U), threshold)
                next_ones, above = children(grams, reached, threshold)
                sids += [sid] * len(reached)
                found += reached.view(np.int64).tolist()
                ends = np.searchsorted(above, np.arange(len(reached) + 1))
                below += [next_ones[a:b].view(np.int64) for a, b in zip(ends, ends[1:])]
            yield pd.DataFrame({"sid": sids, "node": found, "below": below})

    return follow


def _meetings(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Nodes whose sets are compared: (node, sid, size).

    ``sid`` is a hash of the set's id; sets with an equal one share all their nodes.  Samples are wide:
    where they are fetched, two levels are followed, so that every other one needs no join.
    """
    roots = [int(x) for x in mixed(np.arange(1, runs(recall) + 1, dtype=_U)).view(np.int64)]
    start = F.array(*[F.lit(r) for r in roots])
    follow = _follow(threshold)
    sets = sets.select(F.xxhash64("set_id").alias("sid"), "sample")
    level = sets.select("sid", F.explode(follow("sample", start)).alias("node"))
    done, old = [], []
    for depth in range(1, DEPTH + 1):
        level = cut_lineage(level)
        old.append(level)
        met = _counted(level, "node", "size", least=2, spread="sid")
        if depth == DEPTH:
            done.append(met)
            break
        met = cut_lineage(met)
        old.append(met)
        done.append(met.where(F.col("size") <= LIMIT))
        large = met.where(F.col("size") > LIMIT)
        if "below" in large.columns:
            level = large.select("sid", F.explode("below").alias("node"))
            continue
        nodes = large.groupBy("sid").agg(F.collect_list("node").alias("nodes"))
        level = nodes.join(sets, "sid").select("sid", "sample", "nodes").mapInPandas(
            _follow_twice(threshold), "sid long, node long, below array<long>")
    done = [x.select("node", "sid", "size") for x in done]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = cut_lineage(out)
    _discard_all(*old)
    return out


def _by_key(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, spread: str = "set_id") -> DataFrame:
    """Rows with the row of ``table`` of their key; those of ``hot`` keys are dealt in parts."""
    if hot.isEmpty():
        return rows.join(table, key)
    hot = hot.withColumn("_hot", F.lit(True))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(-1)
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    left = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def _counted(rows: DataFrame, key: str, name: str, least: int = 1, spread: str = "set_id") -> DataFrame:
    """Written rows with the number of rows of their key."""
    sizes = rows.groupBy(key).agg(F.count("*").alias(name)).where(F.col(name) >= least)
    sizes = cut_lineage(sizes)
    # a table of its own: by the size of all keys it would be joined by a shuffle of the rows
    hot = cut_lineage(sizes.where(F.col(name) > HOT).select(key))
    return _by_key(rows, sizes, key, hot, spread)


def _perhaps(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be one of ``wanted``, a column of that name: all of those, few others.

    A bit for each hash of a wanted key, in maps of a fixed size.  The more keys there are, the more
    other rows stay; a join decides.
    """
    place = F.pmod(F.xxhash64(key), F.lit(PLACES)) + 1
    bits = wanted.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_map"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    rows = rows.withColumn("_map", F.bitmap_bucket_number(place)).withColumn("_at", F.bitmap_bit_position(place))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = rows.join(F.broadcast(bits), "_map").where(F.getbit(byte, F.pmod("_at", F.lit(8)).cast("int")) == 1)
    return found.drop("_map", "_at", "_bits")


def _discard_all(*tables: DataFrame) -> None:
    for table in tables:
        discard(table)


def _sid(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sid", F.xxhash64("set_id"))


def _hot_nodes(met: DataFrame) -> DataFrame:
    return cut_lineage(met.where(F.col("size") > HOT).select("node").distinct())


def _rooms(met: DataFrame, hot: DataFrame) -> DataFrame:
    """The room of each set that meets others: (sid, room).

    The room decides who shares a block.  It is the home with most sets among those of all sets it
    meets, so that the stragglers of a group fill few blocks.
    """
    homes = cut_lineage(met.groupBy("sid").agg(F.max(F.struct("size", "node"))["node"].alias("home")))
    own = cut_lineage(_counted(homes, "home", "k", spread="sid"))
    of = cut_lineage(met.join(own, "sid").groupBy("node").agg(F.max(F.struct("k", "home")).alias("largest")))
    room = cut_lineage(_by_key(met, of, "node", hot, "sid").groupBy("sid").agg(F.max("largest")["home"].alias("room")))
    _discard_all(homes, own, of)
    return room


def _blocks(rooms: DataFrame, sets: DataFrame) -> DataFrame:
    """Sets with their block, by the number of sets in their room: (sid, set_id, block).

    Sets of many tokens go to blocks of fewer sets: ``per`` of them, a power of two.
    """
    space = F.least(F.lit(float(BLOCK_SETS)), BLOCK_TOKENS / F.col("n"))
    per = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1.0), space)))).cast("int")
    rows = _sid(sets.select("set_id", "n")).join(rooms, "sid")
    rows = cut_lineage(rows.select("sid", "set_id", F.xxhash64("room", per).alias("room"), per.alias("per")))
    part = F.pmod(F.xxhash64("set_id"), F.ceil(F.col("k") / F.col("per")))
    blocks = cut_lineage(_counted(rows, "room", "k").select("sid", "set_id", F.xxhash64("room", part).alias("block")))
    discard(rows)
    return blocks


def _cells(met: DataFrame, blocks: DataFrame, hot: DataFrame) -> DataFrame:
    """Sets to compare: (cell, side, set_id).

    A cell of two blocks holds the sets of each that share a node with one of the other; a block of
    several sets is a cell of one side.
    """
    rows = cut_lineage(met.select("node", "sid").join(blocks.select("sid", "block"), "sid"))
    there = rows.groupBy("node").agg(F.sort_array(F.collect_set("block")).alias("blocks")).where(F.size("blocks") > 1)
    there = cut_lineage(there)
    # a group meets at many nodes with the same blocks
    meets = _by_key(rows, there, "node", hot, "sid").select("sid", "block", "blocks").distinct()
    meets = meets.select("sid", "block", F.explode("blocks").alias("other")).where("block <> other").distinct()
    across = meets.join(blocks, ["sid", "block"]).select(
        F.xxhash64(F.least("block", "other"), F.greatest("block", "other")).alias("cell"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "set_id",
    )
    several = blocks.groupBy("block").agg(F.count("*").alias("k")).where("k > 1").select("block")
    own = blocks.join(several, "block").select(F.xxhash64("block", "block").alias("cell"), F.lit(0).alias("side"), "set_id")
    cells = cut_lineage(across.unionByName(own))
    _discard_all(rows, there)
    return cells


# --- comparison --------------------------------------------------------------------------------


def common_tokens(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set on the left shares with each on the right."""
    if len(left) * len(right) <= 8:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    values = np.concatenate(left + right)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.flatnonzero(np.diff(values, prepend=values[:1] - _U(1)) != 0)
    counts = np.diff(new, append=len(values))
    column = np.repeat(np.cumsum(counts > 1) - 1, counts)
    keep = np.repeat(counts > 1, counts)  # a token of one set is shared with none
    column, row = column[keep], row[keep]
    total = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        dense = np.zeros((len(left) + len(right), width), np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        total += dense[: len(left)] @ dense[len(left) :].T
    return np.rint(total).astype(np.int64)


def similar(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Common and joint tokens of each set on the left with each on the right."""
    common = common_tokens(left, right)
    return common, np.add.outer([len(s) for s in left], [len(s) for s in right]) - common


def reaches(common: np.ndarray, joint: np.ndarray, threshold: float) -> np.ndarray:
    return common * 1_000_000 >= joint * round(threshold * 1_000_000)


def near_samples(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs of samples have enough in common for their sets to be compared."""
    larger = np.maximum.outer([len(x) for x in left], [len(x) for x in right])
    return common_tokens(left, right) >= SKETCH * larger


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, by exact counts."""
    return reaches(*similar(left, right), threshold)


def _by_cell(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """The rows of each cell as ``{set_id: other values}``, for rows in order of cells."""
    cell, rows = None, {}
    for batch in batches:
        for c, key, *values in zip(*(batch[x] for x in ["cell", "set_id", *columns])):
            if c != cell:
                if rows:
                    yield cell, rows
                cell, rows = c, {}
            rows[key] = values
    if rows:
        yield cell, rows


def _sides(rows: dict[bytes, list]) -> tuple[list[bytes], list[bytes], bool]:
    """Sets of a cell's two blocks, in order; a block with itself has one twice."""
    left = sorted(i for i in rows if rows[i][0] == 0)
    right = sorted(i for i in rows if rows[i][0] == 1)
    return left, right or left, not right


def _in_parts(found: Iterator[list], names: list[str], size: int = 2000) -> Iterator[pd.DataFrame]:
    out: list = []
    for rows in found:
        out += rows
        if len(out) >= size:
            yield pd.DataFrame(out, columns=names)
            out = []
    yield pd.DataFrame(out, columns=names)


NEAR = "cell long, side int, set_id binary, same boolean"


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sets of each cell whose sample is near another's."""

    def found(cell: int, rows: dict[bytes, list]) -> list:
        left, right, same = _sides(rows)
        hit = near_samples(*([sampled(rows[i][1]) for i in side] for side in (left, right)))
        if same:
            np.fill_diagonal(hit, False)
        near = {i for i, h in zip(left, hit.any(1)) if h} | {i for i, h in zip(right, hit.any(0)) if h}
        return [(cell, rows[i][0], i, same) for i in near]

    return _in_parts((found(c, r) for c, r in _by_cell(batches, ["side", "sample"])), ["cell", "side", "set_id", "same"])


#: A set's star and the rows of the sets linked to it; or a pair of linked stars.
FOUND = "set_id binary, star binary, other binary, links long"


def _links(names: list[bytes], hit: np.ndarray, copies: list[int]) -> list[tuple]:
    """How many rows the sets linked to each set have, for the sets that have any."""
    return [(i, None, None, n) for i, n in zip(names, (hit @ np.array(copies, np.int64)).tolist()) if n]


def _star_pairs(threshold: float):
    """Links between the two sides of a cell."""

    def found(rows: dict[bytes, list]) -> list:
        left, right, _ = _sides(rows)
        hit = linked(*([np.frombuffer(rows[i][2], _U) for i in side] for side in (left, right)), threshold)
        pairs = {(rows[left[a]][1], rows[right[b]][1]) for a, b in zip(*np.nonzero(hit))}
        out = [(None, *p, None) for p in sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})]
        out += _links(left, hit, [rows[i][3] for i in right])
        return out + _links(right, hit.T, [rows[i][3] for i in left])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = _by_cell(batches, ["side", "star", "grams", "copies"])
        return _in_parts((found(rows) for _, rows in cells), ["set_id", "star", "other", "links"])

    return compare


def greedy_stars(
    sets: dict[bytes, np.ndarray], copies: dict[bytes, int], threshold: float
) -> tuple[dict[bytes, bytes], set, dict[bytes, int]]:
    """Star of each set of a block, the pairs of its stars that are linked and the links of each set.

    In order of their bytes, a set that reaches no earlier star's own set begins a star.  The links
    of a set are the rows of all other sets that it reaches, in its star or not.
    """
    names = sorted(sets)
    grams = [sets[x] for x in names]
    hit = linked(grams, grams, threshold)
    np.fill_diagonal(hit, False)
    pivots: list[int] = []
    star = {}
    for k, name in enumerate(names):
        at = next((p for p in pivots if hit[k, p]), None)
        if at is None:
            pivots.append(k)
            at = k
        star[name] = names[at]
    a, b = np.nonzero(np.triu(hit))
    pairs = {tuple(sorted((star[names[x]], star[names[y]]))) for x, y in zip(a, b)}
    links = dict(zip(names, (hit @ np.array([copies[x] for x in names], np.int64)).tolist()))
    return star, {p for p in pairs if p[0] != p[1]}, links


def _block_stars(threshold: float):
    """Rows (set_id, star, links) of a block's sets and (star, other) of its linked stars."""

    def found(rows: dict[bytes, list]) -> list:
        sets = {i: np.frombuffer(r[0], _U) for i, r in rows.items()}
        star, pairs, links = greedy_stars(sets, {i: r[1] for i, r in rows.items()}, threshold)
        return [(i, s, None, links[i]) for i, s in star.items()] + [(None, *p, None) for p in sorted(pairs)]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = _by_cell(batches, ["grams", "copies"])
        return _in_parts((found(rows) for _, rows in cells), ["set_id", "star", "other", "links"])

    return compare


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a cell together, one cell after the other."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "cell").sortWithinPartitions("cell")


def _with_grams(docs: DataFrame, sets: DataFrame, text: str) -> DataFrame:
    """Some sets with all their tokens, ``grams``, in place of ``first_key``: from one document each.

    Repeated rows give some twice.
    """
    columns = [c for c in sets.columns if c != "first_key"]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [tokens(t) for t in batch["text"]]
            same = np.array([set_id(g) == i for g, i in zip(grams, batch["set_id"])], bool)
            batch = batch[columns].assign(grams=[g.tobytes() for g in grams])
            yield batch[same]

    rows = docs.select("doc_id", text_of(text).alias("text")).select(_key().alias("first_key"), "text")
    rows = _perhaps(rows, "first_key", sets)  # most texts need not travel
    # a filter on a function of the text would become a key of the join: all texts would be described before it
    found = rows.join(sets.hint("merge"), "first_key").select(*columns, "text")
    kinds = [f"{c} {sets.schema[c].dataType.simpleString()}" for c in columns]
    return found.mapInPandas(describe, ", ".join([*kinds, "grams binary"]))


def _key():
    """What finds a document again: its id, a hash of its text without one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key")


# --- components --------------------------------------------------------------------------------


def _salted(edges: DataFrame, end: str) -> DataFrame:
    return edges.withColumn("_salt", F.pmod(F.xxhash64(end), F.lit(SALTS)).cast("int"))


def _each_salt(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def components(edges: DataFrame) -> DataFrame:
    """Least node of each node's component: (node, root), for edges (u, v).

    Large-star and small-star in turn: every node links its larger neighbours, then its smaller
    ones, to its least neighbour, until nothing changes; each round is written.  The edges of a
    node meet its least neighbour in ``SALTS`` parts; only nodes with smaller and larger
    neighbours need that, in a finished group none.
    """
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")).where("m < u AND u < x").drop("x")
        large = _salted(both.where("v > u"), "v").join(_each_salt(least), ["u", "_salt"], "left")
        large = large.select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        several = _each_salt(low.where("k > 1").select("u", "m"))
        small = _salted(large, "v").join(several, ["u", "_salt"]).where("v <> m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(seen)


# --- the join ------------------------------------------------------------------------------------


def joined(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text") -> DataFrame:
    """Every row with its class_id, its star_id, its links and, for a star's representative, the linked stars.

    Class and star are named by their least id, that of the star's own text; ``linked`` is null for
    rows that represent no star.  ``n_links`` counts the other rows whose text reaches the threshold,
    copies included.
    """
    scan, own, pairs = _classes(docs, threshold, recall, text)
    names = own.where("set_id = star").select("star", F.col("first_doc").alias("star_id"))
    both = pairs.unionByName(pairs.select(F.col("other").alias("star"), F.col("star").alias("other")))
    others = names.withColumnsRenamed({"star": "other", "star_id": "of"})
    linked = both.join(others, "other").groupBy("star").agg(F.sort_array(F.collect_list("of")).alias("linked"))
    stars = cut_lineage(names.join(linked, "star", "left"))
    none = F.array().cast("array<bigint>")
    rows = _by_key(own, stars, "star", _hot(own, "star")).select(
        "set_id", "class_id", "star_id",
        F.when(F.col("set_id") == F.col("star"), F.coalesce("linked", none)).alias("linked"), "n_links",
    )
    full = scan.where("n > 0").select("doc_id", "set_id")
    first = F.col("doc_id").eqNullSafe(F.col("star_id"))
    full = full.join(cut_lineage(rows), "set_id").select(
        "doc_id", "class_id", "star_id", F.when(first, F.col("linked")).alias("linked"), "n_links")
    empty = scan.where("n = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("star_id"), none.alias("linked"),
        F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(empty)


def _classes(
    docs: DataFrame, threshold: float, recall: float, text: str, hashed: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their set; sets with star, root of their component and class_id; linked stars."""
    small_batches(docs.sparkSession)
    scan = cut_lineage(_scan(docs, text, hashed))
    sets = cut_lineage(scan.where("n > 0").groupBy("set_id").agg(
        F.min("key").alias("first_key"), F.min("doc_id").alias("first_doc"),
        F.first("n").alias("n"), F.first("sample").alias("sample"), F.count("*").alias("copies"),
    ))
    met = _meetings(sets, threshold, recall)
    hot = _hot_nodes(met)
    rooms = _rooms(met, hot)
    blocks = _blocks(rooms, sets)
    cells = _cells(met, blocks, hot)
    _discard_all(met, rooms, blocks)
    # sets near another one by their samples are compared in full
    near = cells.join(sets.select("set_id", "sample"), "set_id")
    near = cut_lineage(_dealt(near).mapInPandas(_near, NEAR))
    discard(cells)
    # a set has one block and no, one or several blocks beside it
    places = near.groupBy("set_id").agg(
        F.bool_or("same").alias("inside"), F.bool_or(~F.col("same")).alias("beside"),
        F.coalesce(F.max(F.when(F.col("same"), F.col("cell"))), F.lit(0)).alias("cell"),
    )
    chosen = cut_lineage(sets.select("set_id", "first_key", "copies").join(places, "set_id"))
    grams = cut_lineage(_with_grams(docs, chosen, text))
    # blocks, then blocks with blocks
    within = _dealt(grams.where("inside").select("cell", "set_id", "grams", "copies"))
    within = cut_lineage(within.mapInPandas(_block_stars(threshold), FOUND))
    stars = within.where("set_id IS NOT NULL").select("set_id", "star")
    more = grams.where("beside").select("set_id", "grams", "copies")
    across = near.where("NOT same").join(more, "set_id").join(stars, "set_id", "left").select(
        "cell", "side", "set_id", F.coalesce("star", "set_id").alias("star"), "grams", "copies")
    across = cut_lineage(_dealt(across).mapInPandas(_star_pairs(threshold), FOUND))
    _discard_all(near, chosen, grams)
    found = within.unionByName(across)
    pairs = found.where("set_id IS NULL").select("star", "other").distinct()
    by_set = found.where("set_id IS NOT NULL").groupBy("set_id").agg(F.max("star").alias("star"), F.sum("links").alias("links"))
    pairs = cut_lineage(pairs)
    roots = components(pairs.select(F.col("star").alias("u"), F.col("other").alias("v"))).withColumnRenamed("node", "star")
    own = sets.select("set_id", "first_doc", "copies").join(by_set, "set_id", "left")
    own = cut_lineage(own.select(
        "set_id", "first_doc", F.coalesce("star", "set_id").alias("star"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    ))
    _discard_all(sets, within, across)
    tops = own.groupBy("star").agg(F.min("first_doc").alias("least")).join(roots, "star", "left")
    tops = cut_lineage(tops.withColumn("root", F.coalesce("root", "star")))
    classes = tops.groupBy("root").agg(F.min("least").alias("class_id"))
    tops = tops.join(classes, "root").select("star", "root", "class_id")
    return scan, cut_lineage(_by_key(own, tops, "star", _hot(own, "star"))), pairs


def _hot(rows: DataFrame, key: str) -> DataFrame:
    """Keys of many rows."""
    return cut_lineage(rows.groupBy(key).agg(F.count("*").alias("k")).where(F.col("k") > HOT).select(key))


def one_per_class(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one with the least id, then least text hash.

    Null ids come last.  Equal rows with that id and text count as one document; every empty text
    is a class of its own.  Columns stay as they are.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names)}
    scan, own, _ = _classes(docs, THRESHOLD, RECALL, text, hashed=True)
    # only the first row of each set competes for its class
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("r")
    sets = scan.where("n > 0").groupBy("set_id").agg(first)
    best = sets.join(own.select("set_id", "root"), "set_id").groupBy("root").agg(F.min("r").alias("r"))
    kept = best.select("r.doc_id", "r.hash").unionByName(scan.where("n = 0").select("doc_id", "hash").distinct())
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    rows = docs.toDF(*names).withColumn("_h", F.xxhash64(F.col(at[text])))
    same = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_of(at[text])) == F.col("_hash"))
    stay = rows.join(kept, same, "left_semi")
    return stay.dropDuplicates([at["doc_id"], "_h"]).select(*names).toDF(*docs.columns)
