"""Series of pages: day pages, paginated listings, addresses to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadframe.functions.dates import date_spine, day_path


def day_pages(
    spark: SparkSession, pages: DataFrame, root: str, ref_date: str, days_back: int,
    url: str = "url",
) -> DataFrame:
    """Pages of the last days, newest first in ``day_offset``.

    The spine has one row per day asked for, so it is broadcast: its size is the
    parameter, not the data.
    """
    if not 0 <= days_back <= 100_000:
        raise ValueError("days_back out of range")
    spine = date_spine(spark, ref_date, days_back).withColumn(
        "_url", F.concat(F.lit(f"{root}/posts/"), day_path("day"))
    )
    return pages.join(F.broadcast(spine), F.col(url) == F.col("_url")).drop("_url")


def take_while_filled(
    listing: DataFrame, by: str, page: str, rows: str | Column, max_pages: int | None = None
) -> DataFrame:
    """Pages of each series before its first failed (null), empty or missing page.

    Pages count from 1.  A page stops the series if it follows a filled one, or is the
    first, and is not filled itself: an anti join on series and page finds all of them, and
    only the smallest per series is aggregated (one partial row per task and series) and joined
    back, so a long series is never gathered in one task.
    """
    count = F.col(rows) if isinstance(rows, str) else rows
    limited = listing if max_pages is None else listing.filter(F.col(page) <= max_pages)
    filled = limited.filter(F.coalesce(count, F.lit(0)) > 0).select(by, page)
    first = limited.select(by, F.lit(1).cast("long").alias(page)).distinct()
    due = first.unionByName(filled.select(by, (F.col(page) + 1).cast("long").alias(page)))
    stops = due.join(filled, [by, page], "left_anti").groupBy(by).agg(F.min(page).alias("_stop"))
    return limited.join(stops, by).filter(F.col(page) < F.col("_stop")).drop("_stop")
