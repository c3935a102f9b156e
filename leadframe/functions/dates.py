"""Date helpers.  The reference date is always a parameter, never 'now'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadframe.functions.text import as_col


def iso_timestamp(c: Column | str) -> Column:
    """ISO text; the fraction is written in six digits, and only if there is one."""
    fraction = F.date_format(as_col(c), ".SSSSSS")
    whole = F.date_format(as_col(c), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(fraction == ".000000", F.lit("")).otherwise(fraction))


def day_path(c: Column | str) -> Column:
    """Date as the 'yyyy/MM/dd' part of a page address."""
    return F.date_format(as_col(c), "yyyy/MM/dd")


def file_stamp(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyyMMdd_HHmmss")


def date_spine(spark: SparkSession, ref_date: str, days_back: int) -> DataFrame:
    """The reference date and the days before it, newest first."""
    return spark.range(days_back).select(
        F.col("id").cast("int").alias("day_offset"),
        F.date_sub(F.lit(ref_date).cast("date"), F.col("id").cast("int")).alias("day"),
    )
