"""Bag union of sources with a stable global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Positions of a source stay below 2**56 (listing readers use 32 bits for the page
# and 24 for the place on it); the rank of up to 127 sources goes above.
_POSITION_BITS = 56
_PLACE_BITS = 24


def _packed(high: Column, low: Column, bits: int, high_bits: int, what: str) -> Column:
    """Two numbers as one, high part first; a number out of range ends the job."""
    high, low = high.cast("bigint"), low.cast("bigint")
    fits = high.between(0, (1 << high_bits) - 1) & low.between(0, (1 << bits) - 1)
    broken = F.raise_error(F.concat_ws(" ", F.lit(what), high, low, F.lit("out of range"))).cast("bigint")
    whole = F.shiftleft(high, bits) + low
    return F.when(high.isNull() | low.isNull() | fits, whole).otherwise(broken)


def page_position(page: Column | str, place: Column | str) -> Column:
    """Order of an entry over all pages: page first, then place on the page."""
    page, place = (F.col(c) if isinstance(c, str) else c for c in (page, place))
    return _packed(page, place, _PLACE_BITS, _POSITION_BITS - _PLACE_BITS, "page and place")


def union_sources(sources: list[DataFrame], order: str = "seq") -> DataFrame:
    """All rows of all sources; earlier sources come first in ``seq``.

    ``seq`` is computed per row from (rank of the source, position in the
    source): no shuffle and no dependence on completion order.  A position outside
    its range is an error, never the ``seq`` of another row.
    """
    if len(sources) > 127:
        raise ValueError("too many sources")
    out = None
    for rank, df in enumerate(sources):
        seq = _packed(F.lit(rank), F.col(order), _POSITION_BITS, 7, "source and position")
        part = df.withColumn("seq", seq)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def expand_sources(names: list[str]) -> list[str]:
    """'all' stands for the four directory sources."""
    # fixed values: the sources behind 'all'
    everything = ["product_hunt", "angellist", "clutch", "crunchbase"]
    return everything if "all" in names else list(names)
