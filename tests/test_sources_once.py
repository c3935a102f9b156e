"""A run with name matching reads its sources once."""

from pyspark.sql import functions as F

from leadframe.plans.run import RunOptions, run_leads
from leadframe.schema import companies


def test_sources_are_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(k):
        reads.add(1)
        return f"firm {k * 7919 % 1000} of {'abcdefghijklmnop'[k % 16] * 9}"

    n = 50
    rows = companies(spark.range(0, n, 1, 2), seq=F.col("id"), name=name("id"), source=F.lit("other"))
    got = run_leads([rows], options=RunOptions()).select("seq", "name").collect()
    assert 0 < len(got) <= n and reads.value == n


def test_a_column_without_a_type_goes_through(spark):
    rows = companies(spark.range(3), seq=F.col("id"), name=F.concat(F.lit("firm"), F.col("id")), source=F.lit("other"))
    rows = rows.withColumn("more", F.lit(None))
    assert run_leads([rows], options=RunOptions(score=False)).select("more").collect() == [(None,)] * 3
