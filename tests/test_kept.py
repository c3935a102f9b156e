"""Batches against an index of what earlier ones kept."""

import random
import uuid

import pytest

from leadframe.operators import dedup as D
from leadframe.operators.kept import KeptIndex
from test_dedup import companies, expected, random_rows


@pytest.fixture
def index(spark):
    made = KeptIndex(spark, f"kept_{uuid.uuid4().hex}", buckets=8)
    yield made
    made.drop()


def test_batches_give_what_one_pass_gives(spark, index):
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefg ") for _ in range(rng.randrange(2, 28))) for _ in range(12)]
    rows = random_rows(rng, 90, words, [None, None] + [f"h{i}.com" for i in range(9)])
    kept, _ = expected(spark, rows, 0.85)
    got = []
    for part in (rows[:30], [], rows[30:31], rows[31:90]):
        got += [r["seq"] for r in index.add(companies(spark, part)).collect()]
    assert sorted(got) == kept


def test_a_batch_that_was_not_committed_does_not_count(spark, index):
    assert [r["seq"] for r in index.add(companies(spark, [(0, "First Firm", "a.com", None)])).collect()] == [0]
    lost = spark.createDataFrame([("b.com", "lost")], "key string, batch string")
    index._append(lost, "keys", "key")
    second = companies(spark, [(1, "Second Thing", "b.com", None), (2, "First Firms", "c.com", None), (3, "Other", "A.com", None)])
    assert [r["seq"] for r in index.add(second).collect()] == [1]


def test_the_old_tables_are_not_shuffled(spark, index):
    index.add(companies(spark, [(k, f"firm number {k} of {k * 7}", f"d{k}.com", None) for k in range(40)]))
    rows = D.records_of(companies(spark, [(100 + k, f"house {k} in {k * 3}", f"e{k}.com", None) for k in range(40)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows.join(index._committed("keys").select("key"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    old = plan[plan.index("SortMergeJoin"):].split(":-")[-1].split("+- Scan")[0]
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1, plan
    assert "Bucketed: true" in plan or "bucket" in plan.lower(), (plan, old)


def test_the_query_keeps_what_the_single_pass_keeps(spark, sf_small):
    import __spark_entry__ as entry

    queries = entry.queries()
    got = [r["seq"] for r in queries["d_batches"](spark, sf_small).collect()]
    assert sorted(got) == sorted(r["seq"] for r in queries["d_fuzzy"](spark, sf_small).collect())
