"""Summaries and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadframe import schema as S
from leadframe.functions.text import round2


def is_hiring() -> Column:
    return F.coalesce(F.col("enrichment.hiring_intent.is_hiring"), F.lit(False))


def has_tech() -> Column:
    return F.col("enrichment.tech_stack").isNotNull()


def has_funding() -> Column:
    return F.col("enrichment.funding_info").isNotNull()


def summary(df: DataFrame) -> DataFrame:
    """Seven (Metric, Count) rows from a single aggregation pass."""
    level = F.col("score.priority")
    metrics = {
        "Total Companies": F.count(F.lit(1)),
        "High Priority": F.count_if(level == "high"),
        "Medium Priority": F.count_if(level == "medium"),
        "Low Priority": F.count_if(level == "low"),
        "Currently Hiring": F.count_if(is_hiring()),
        "With Tech Stack Data": F.count_if(has_tech()),
        "With Funding Data": F.count_if(has_funding()),
    }
    one = df.agg(*[c.alias(n) for n, c in metrics.items()])
    return one.unpivot([], list(metrics), "Metric", "Count")


def count_by_priority(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("score.priority").alias("priority")).agg(
        F.count(F.lit(1)).alias("companies")
    )


def source_metrics(df: DataFrame, source_runs: DataFrame) -> DataFrame:
    """Run record of each source with the numbers of its rows per stage.

    The rows are counted per source before the join, so a source that holds
    most rows shuffles one partial count per task.
    """
    counts = df.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_scraped"),
        F.count_if(F.col("enrichment").isNotNull()).alias("total_enriched"),
        F.count_if(F.col("score").isNotNull()).alias("total_scored"),
    )
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in
            ("total_scraped", "total_enriched", "total_scored")}
    return source_runs.join(counts, "source", "left").withColumns(zero)


def source_run_records(attempts: DataFrame) -> DataFrame:
    """One run record per source from page attempts.

    ``attempts(source, error, warning, seconds)``: a source succeeded when none
    of its attempts has an error.  Messages are kept as distinct sorted sets.
    """
    return attempts.groupBy("source").agg(
        F.bool_and(F.col("error").isNull()).alias("success"),
        F.array_sort(F.collect_set("error")).alias("errors"),
        F.array_sort(F.collect_set("warning")).alias("warnings"),
        F.sum("seconds").alias("execution_time"),
    )


def source_run_messages(attempts: DataFrame) -> DataFrame:
    """Messages of each source as rows: (source, kind, message, attempts).

    The child table of ``source_run_records``: a source with any number of different messages is
    as many rows, counted on the map side, and no array.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("message")) for k in ("error", "warning")])
    rows = attempts.select("source", F.inline(kinds)).filter(F.col("message").isNotNull())
    return rows.groupBy("source", "kind", "message").agg(F.count(F.lit(1)).alias("attempts"))


def hiring_rollup(
    postings: DataFrame, ref_time: str, recent_days: int = 30, by: str = "company"
) -> DataFrame:
    """Hiring intent per company from ``postings(company, posted_at, dept)``.

    Velocity is postings per 30-day month between first posting and reference.
    """
    ref = F.lit(ref_time).cast("timestamp")
    at = F.col("posted_at").cast("timestamp")
    in_dept = lambda d: F.count_if(F.col("dept") == d)
    days = F.greatest(F.datediff(ref, F.min(at)), F.lit(1))
    agg = postings.filter(at <= ref).groupBy(by).agg(
        F.count(F.lit(1)).alias("total_open_positions"),
        F.count_if(at >= ref - F.expr(f"INTERVAL {int(recent_days)} DAYS")).alias("recent_postings"),
        in_dept("engineering").alias("engineering_positions"),
        in_dept("sales").alias("sales_positions"),
        in_dept("marketing").alias("marketing_positions"),
        round2(F.count(F.lit(1)) * 30.0 / days).alias("hiring_velocity"),
    )
    return agg.withColumn("is_hiring", F.col("total_open_positions") > 0)


def hiring_struct(rollup: DataFrame, by: str = "company") -> DataFrame:
    """The roll-up as (company, hiring_intent struct)."""
    fields = {f: F.col(f) for f in S.HIRING_INTENT.fieldNames()}
    return rollup.select(by, S.build(S.HIRING_INTENT, **fields).alias("hiring_intent"))


def stage_counts(**stages: DataFrame) -> DataFrame:
    """Rows per pipeline stage as (stage, rows)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("stage"), "rows")
        for n, df in stages.items()
    ]
    return reduce(DataFrame.unionByName, parts)


class StageCounts:
    """Rows per stage, counted while something else reads or writes the rows.

    Each watched stage is an observation in the plan of the action to come: any number of counts
    costs no further pass.  The first action over a stage gives its count, so it must read
    all rows, as a sink does.  An action that fails gives none.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str, test: Column | None = None) -> DataFrame:
        """The same rows; those that pass ``test`` count as ``stage``."""
        if stage in self._seen:
            raise ValueError(f"stage {stage} is watched already")
        self._seen[stage] = Observation()
        rows = F.count(F.lit(1)) if test is None else F.count_if(test)
        return df.observe(self._seen[stage], rows.alias("rows"))

    def counts(self) -> dict[str, int]:
        """Stage and rows, in the order of watching; waits for the action."""
        return {stage: o.get["rows"] for stage, o in self._seen.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.counts().items()), "stage string, rows long")


def distinct_technologies(df: DataFrame) -> DataFrame:
    """Technologies seen anywhere, with the number of companies."""
    from leadframe.operators.flatten import all_technologies

    names = F.array_distinct(all_technologies(F.col("enrichment.tech_stack")))
    return (
        df.select(F.explode(names).alias("technology"))
        .groupBy("technology")
        .agg(F.count(F.lit(1)).alias("companies"))
    )
