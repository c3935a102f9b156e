"""Array, map and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from leadframe.functions.text import as_col
from leadframe.session import cut_lineage


def json_get(c: Column | str, *keys: str, default=None) -> Column:
    """Value at a nested key of a JSON text as string, else the default."""
    path = "$" + "".join(f"['{k}']" for k in keys)
    return F.coalesce(F.get_json_object(as_col(c), path), F.lit(default))


def struct_get(c: Column | str, *keys: str, default=None) -> Column:
    """Nested struct or map lookup that survives missing parts."""
    value = as_col(c)
    for key in keys:
        value = value[key]
    return value if default is None else F.coalesce(value, F.lit(default))


def chunk_array(c: Column | str, size: int) -> Column:
    """Split an array into arrays of ``size``; the last may be shorter."""
    arr = as_col(c)
    steps = F.sequence(F.lit(0), F.ceil(F.size(arr) / F.lit(size)).cast("int") - 1)
    chunks = F.transform(steps, lambda i: F.slice(arr, i * size + 1, size))
    return F.when(F.size(arr) > 0, chunks).otherwise(F.array().cast("array<array<string>>"))


def chunk_rows(df: DataFrame, order: str, size: int, by: str | None = None) -> DataFrame:
    """Number rows in batches of ``size`` as ``batch_id``, per group with ``by``."""
    return global_position(df, order, by).withColumn(
        "batch_id", F.floor(F.col("position") / size)
    ).drop("position")


def _in_ranges(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """``df`` in ranges of rows along the group and the order: column ``_range``.

    Spark samples the bounds, so ranges hold about as many rows however sparse or uneven the
    order values are.  Another run of the sampling could give other bounds: the rows are
    written once with their range.
    """
    ranged = df.repartitionByRange(*[F.col(g) for g in group], F.col(order))
    return cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))


def global_position(df: DataFrame, order: str, by: str | None = None) -> DataFrame:
    """Add a dense 0-based ``position`` in the order of a unique column.

    Rows are ranked inside ranges of rows, so no task ever sorts a whole large group;
    the offsets come from the counts per range, one row for each group in a range.
    """
    group = [by] if by is not None else []
    rows = _in_ranges(df, group, order)
    counts = rows.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(order)) - 1
    return (
        _null_safe_join(rows.withColumn("_local", local), offsets, group + ["_range"])
        .withColumn("position", F.col("_local") + F.col("_off"))
        .drop("_range", "_local", "_off")
    )


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r{k}"]) for k in keys]
    return left.join(renamed, on).drop(*[f"_r{k}" for k in keys])


def next_value(df: DataFrame, by: str, order: str, value: Column, alias: str) -> DataFrame:
    """Forward as-of lookup: the first non-null ``value`` after each row.

    ``order`` is unique per group.  A row first looks inside its range of rows; the first
    value of the later ranges comes from one summary row per group and range.  A hot group is
    so spread over many tasks.
    """
    rows = _in_ranges(df.withColumn("_v", value), [by], order)
    inside = Window.partitionBy(by, "_range").orderBy(order)
    after = inside.rowsBetween(1, Window.unboundedFollowing)
    firsts = rows.groupBy(by, "_range").agg(
        F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_first")
    )
    later = Window.partitionBy(by).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    following = firsts.select(
        by, "_range", F.first("_first", ignorenulls=True).over(later).alias("_later")
    )
    near = rows.withColumn("_near", F.first("_v", ignorenulls=True).over(after))
    return (
        _null_safe_join(near, following, [by, "_range"])
        .withColumn(alias, F.coalesce("_near", "_later"))
        .drop("_v", "_range", "_near", "_later")
    )


def null_to_empty(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.array().cast("array<string>"))
