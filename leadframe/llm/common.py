"""Helpers the operators of this package share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java pattern and as characters.
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Rows and bytes that travel to Python at once: long texts stay within memory.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session's Python functions."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_of(column: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs of anything but white space."""
    return F.array_remove(F.split(text, SPACE_PATTERN), "")


def per_process(name: str, make: Callable[[], object]) -> object:
    """One object for all tasks of a Python worker, such as a loaded vocabulary."""
    kept = sys.modules.setdefault("_leadframe_kept", types.ModuleType("_leadframe_kept"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)
