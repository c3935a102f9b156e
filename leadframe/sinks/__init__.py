"""Writers for ranked leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.operators.aggregate import summary
from leadframe.operators.flatten import by_priority, flatten_companies, nested_companies
from leadframe.session import cut_lineage, discard

FORMATS = ("csv", "json", "parquet", "excel")


def workbook_sets(df: DataFrame) -> dict[str, DataFrame]:
    """The three sheets of a workbook export as DataFrames."""
    return {
        "companies": flatten_companies(df),
        "high_priority": flatten_companies(by_priority(df, "high")),
        "summary": summary(df),
    }


def target_path(folder: str, name: str | None = None, stamp: str = "") -> str:
    """``folder/name`` without a file extension; 'companies_<stamp>' by default."""
    name = name or f"companies_{stamp}"
    base = name.rsplit("/", 1)[-1]
    stem = base.rsplit(".", 1)[0] if "." in base[1:] else base
    return f"{folder.rstrip('/')}/{stem}"


def write_leads(
    df: DataFrame, fmt: str, folder: str, name: str | None = None, stamp: str = "",
    partition_by: str | None = None, mode: str = "errorifexists",
) -> str | None:
    """Write companies in one of the formats; returns the path, None if empty.

    Files are written in parallel, one per partition.  'excel' writes the three
    workbook sheets as data sets under one path; the high-priority one only if
    it has rows.  The companies are computed once, into an intermediate table that
    all files and the test for rows are read from.
    """
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    written = cut_lineage(df)
    try:
        return None if written.isEmpty() else _write(
            written, fmt, target_path(folder, name, stamp), partition_by, mode
        )
    finally:
        discard(written)


def _write(df: DataFrame, fmt: str, path: str, partition_by: str | None, mode: str) -> str:
    if fmt == "excel":
        for sheet, rows in workbook_sets(df).items():
            if sheet == "high_priority" and rows.isEmpty():
                continue
            rows.write.mode(mode).option("header", True).option("escape", '"').csv(f"{path}/{sheet}")
        return path
    if fmt == "json":
        nested_companies(df).write.mode(mode).json(f"{path}.json")
        return f"{path}.json"
    writer = flatten_companies(df).write.mode(mode)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    if fmt == "csv":
        # quotes doubled inside quoted fields, so that any text reads back
        writer.option("header", True).option("escape", '"').csv(f"{path}.csv")
    else:
        writer.parquet(f"{path}.parquet")
    return f"{path}.{fmt}"


def write_run_metrics(metrics: DataFrame, path: str, run_time: str, mode: str = "append") -> None:
    """Run records of the sources as a table, with the time of the run."""
    stamp = F.lit(run_time).cast("timestamp")
    metrics.withColumn("written_at", stamp).write.mode(mode).parquet(path)
