"""Rows that fail alone, counts taken on the way, payloads that cannot be read."""

import pytest
from pyspark.sql import functions as F

from leadframe import schema as S
from leadframe.operators import enrich as E
from leadframe.operators.aggregate import StageCounts
from leadframe.plans import inputs as I
from leadframe.plans.run import RunOptions, run_leads
from leadframe.session import cut_lineage
from leadframe.sources.payloads import payload_items, unreadable_payloads


def leads(spark, n):
    df = spark.range(n).select(F.col("id").alias("seq"))
    return S.companies(
        df, seq=F.col("seq"), name=F.format_string("Firm %d", "seq"), source=F.lit("other"),
        domain=F.format_string("f%d.com", F.floor(F.col("seq") / 2)),
        enrichment=F.when(F.col("seq") % 2 == 0, S.build(S.ENRICHMENT, industry="web")),
    )


def results(df):
    rows = df.select("seq", "enrichment.industry", "enrichment.employee_count", "enrich_errors").collect()
    return {r[0]: (r[1], r[2], [(e["enricher"], e["error"]) for e in r[3]]) for r in rows}


def test_one_failing_row_leaves_the_others_alone(spark):
    def industry(lead):
        if lead["seq"] == 4:
            raise KeyError("gone")
        return {"industry": f"{lead['name']} trade"}

    def count(lead):
        return {"employee_count": len(lead["enrichment"]["industry"])}  # fails where there is none

    got = results(E.enrich_all(leads(spark, 8), [E.row_enricher("a", industry), E.row_enricher("b", count)]))
    for k in range(8):
        assert got[k] == (("web", 3, [("a", "KeyError: 'gone'")]) if k == 4 else (f"Firm {k} trade", 12, []))
    got = results(leads(spark, 8).transform(E.row_enricher("b", count)))
    assert all(got[k][1:] == ((3, []) if k % 2 == 0 else (None, got[k][2])) for k in range(8))
    assert all(got[k][2][0][1].startswith("TypeError") for k in range(1, 8, 2))


@pytest.mark.parametrize("result,what", [
    ({"employee_count": "many"}, "no valid enrichment"), ({"no_such_field": 1}, "no valid enrichment"),
    ([1], "no valid enrichment"), (None, "no valid enrichment"), ({1, 2}, "TypeError"),
])
def test_results_of_a_wrong_form_are_errors_of_their_row(spark, result, what):
    got = results(leads(spark, 3).transform(E.row_enricher("x", lambda lead: result if lead["seq"] == 0 else {"industry": "i"})))
    assert got[0][:2] == ("web", None) and got[0][2][0][0] == "x" and got[0][2][0][1].startswith(what)
    assert got[1] == got[2] == ("i", None, [])


def test_an_empty_result_changes_no_field_and_an_empty_table_stays_empty(spark):
    same = E.row_enricher("x", lambda lead: {})
    got = results(leads(spark, 2).transform(same))
    assert got == {0: ("web", None, []), 1: (None, None, [])}
    assert leads(spark, 0).transform(same).count() == 0


def test_counts_of_a_run_come_with_its_only_pass(spark):
    counts = StageCounts()
    out = run_leads([leads(spark, 10)], options=RunOptions(name_threshold=None), counts=counts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") >= 3
    rows = cut_lineage(out).count()
    assert counts.counts()["kept"] == rows == 5
    assert counts.counts() == {"collected": 10, "distinct": 5, "kept": 5}
    assert counts.table(spark).columns == ["stage", "rows"]


def test_counts_with_a_test_and_of_nothing(spark):
    counts = StageCounts()
    df = counts.watch(spark.range(100), "all")
    df = counts.watch(df, "even", F.col("id") % 2 == 0)
    counts.watch(df.filter("id > 1000"), "none").write.format("noop").mode("overwrite").save()
    assert counts.counts() == {"all": 100, "even": 50, "none": 0}
    with pytest.raises(ValueError):
        counts.watch(df, "all")


def test_every_payload_is_read_or_rejected(spark, sf_small):
    payloads = I.broken_payloads(spark, sf_small)
    read = {r[0] for r in payload_items(payloads).select("page_id").distinct().collect()}
    bad = {r["page_id"]: r["reason"] for r in unreadable_payloads(payloads).collect()}
    assert read | set(bad) == {r[0] for r in payloads.select("page_id").collect()} and not read & set(bad)


@pytest.mark.parametrize("text,reason", [
    (None, "empty"), ("", "empty"), (" \n", "empty"), ("<html>", "malformed"), ('{"data":', "malformed"),
    ("[1, 2]", "malformed"), ('{"data": {"items": "x"}}', "malformed"), ("{}", "no items"), ('{"data": null}', "no items"),
    ('{"data": {"items": []}}', None), ('{"data": {"items": [{"properties": {"name": "A"}}]}}', None),
])
def test_reasons_of_unreadable_payloads(spark, text, reason):
    df = spark.createDataFrame([(1, text)], "page_id long, payload string")
    assert [r["reason"] for r in unreadable_payloads(df).collect()] == ([reason] if reason else [])
