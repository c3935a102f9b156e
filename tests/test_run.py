import json

import pytest
from pyspark.sql import functions as F

from leadframe import schema as S
from leadframe.operators import enrich, rank, score, validate
from leadframe.operators.flatten import flatten_companies
from leadframe.operators.rules import RuleSet, is_high_value_target
from leadframe.operators.union import expand_sources, union_sources
from leadframe.plans.run import RunOptions, run_leads
from leadframe.sinks import target_path, write_leads
from leadframe.streaming import score_stream


def one(spark, **given):
    base = spark.range(1).withColumn("seq", F.col("id"))
    given = {"seq": F.col("seq"), **given}
    return S.companies(base, **given)


def words(*items):
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def harbour(spark):
    return one(
        spark, name="Harbour Analytics", website="https://harbour.example/", description="Tide tables",
        source="manual",
        enrichment=S.build(
            S.ENRICHMENT, company_size="medium", employee_count=120,
            hiring_intent=S.build(S.HIRING_INTENT, total_open_positions=4, is_hiring=True, recent_postings=1),
            tech_stack=S.build(
                S.TECH_STACK, frameworks=words("Rails"), databases=words("Redis"),
                cloud_providers=words("Azure"), analytics=words("Mixpanel")),
        ),
    )


def test_score_of_a_full_record(spark):
    """30 + 4 * 5 + 10; 90 + 10; 40 + 15 + 15 + 10; 30 + 20; weights 0.35, 0.3, 0.2, 0.15."""
    s = score.score_companies(harbour(spark)).first()["score"]
    assert (s.intent_score, s.fit_score, s.tech_score, s.engagement_score) == (60, 100, 80, 50)
    assert (s.total_score, s.priority) == (74.5, "high")


def test_recorded_run_score(spark):
    df = one(
        spark, name="x", website="https://example.com/", source="manual",
        enrichment=S.build(S.ENRICHMENT, tags=words("generic-scrape"), tech_stack=S.build(
            S.TECH_STACK, cloud_providers=words("Cloudflare", "Google Cloud"))),
    )
    s = score.score_companies(df).first()["score"]
    assert (s.intent_score, s.fit_score, s.tech_score, s.engagement_score) == (0, 40, 55, 30)
    assert (s.total_score, s.priority) == (27.5, "low")


def test_missing_enrichment_differs_from_an_empty_one(spark):
    none = score.score_companies(one(spark, name="a")).first()["score"]
    empty = score.score_companies(one(spark, name="a", enrichment=S.build(S.ENRICHMENT))).first()["score"]
    assert (none.fit_score, empty.fit_score) == (50, 40)


def test_weights():
    assert score.normalize_weights() == score.DEFAULT_WEIGHTS
    w = score.normalize_weights({"intent": 2, "fit": 1, "tech": 1, "engagement": 0})
    assert sum(w.values()) == 1
    with pytest.raises(ValueError):
        score.normalize_weights({"intent": 1.0})


def test_scores_stay_in_range(spark, sf_small):
    from leadframe.plans.inputs import leads

    s = score.score_companies(leads(spark, sf_small)).select("score.*")
    cols = [c for c in s.columns if c != "priority"]
    bad = s.filter(" OR ".join(f"{c} < 0 OR {c} > 100" for c in cols)).count()
    assert bad == 0
    by = {r["priority"]: r for r in s.groupBy("priority").agg(
        F.min("total_score").alias("lo"), F.max("total_score").alias("hi")).collect()}
    assert by["low"]["hi"] <= by["medium"]["lo"]


def test_flat_row_and_export(spark, tmp_path):
    df = one(
        spark, name="Example Inc.", domain="example.com", website="https://example.com/",
        source="product_hunt",
        enrichment=S.build(
            S.ENRICHMENT, company_size="startup", employee_count=25,
            tech_stack=S.build(S.TECH_STACK, languages=words("Python", "JavaScript"),
                               frameworks=words("Django", "React")),
            hiring_intent=S.build(S.HIRING_INTENT, total_open_positions=5, is_hiring=True)),
        score=S.build(S.SCORE, total_score=75.5, priority="high"),
        extra_data=F.create_map(F.lit("k"), F.lit("v")),
    ).unionByName(one(spark, name='Other, "quoted"\nname', source="manual"))
    flat = flatten_companies(df)
    assert len(flat.columns) == 20
    r = flat.first()
    assert r["technologies"] == "Python, JavaScript, Django, React"
    assert (r["open_positions"], r["total_score"], r["priority"]) == (5, 75.5, "high")
    csv = write_leads(df, "csv", str(tmp_path), "leads.csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(csv)
    assert csv.endswith("/leads.csv") and back.count() == 2
    assert {x["company_name"] for x in back.collect()} == {"Example Inc.", 'Other, "quoted"\nname'}
    path = write_leads(df, "json", str(tmp_path), stamp="20240131_120000")
    assert path.endswith("companies_20240131_120000.json")
    lines = [json.loads(x["value"]) for x in spark.read.text(path).collect()]
    assert {x["name"] for x in lines} == {"Example Inc.", 'Other, "quoted"\nname'}
    assert [x for x in lines if "enrichment" in x][0]["extra_data"] == {"k": "v"}
    assert spark.read.parquet(write_leads(df, "PARQUET", str(tmp_path), "p", partition_by="source")).count() == 2
    book = write_leads(df, "excel", str(tmp_path), "book.xlsx")
    summary = {x["Metric"]: x["Count"] for x in
               spark.read.option("header", True).csv(f"{book}/summary").collect()}
    assert summary["Total Companies"] == "2" and summary["High Priority"] == "1"
    assert write_leads(df.filter("false"), "csv", str(tmp_path), "none") is None
    with pytest.raises(ValueError):
        write_leads(df, "xml", str(tmp_path))


def test_target_path():
    assert target_path("/o/", "a.b.csv") == "/o/a.b"
    assert target_path("/o", None, "1") == "/o/companies_1"


def test_union_order_and_sources(spark):
    a = spark.createDataFrame([(5, "x")], "seq long, name string")
    b = spark.createDataFrame([(1, "y", 3)], "seq long, name string, extra int")
    got = union_sources([a, b]).orderBy("seq").collect()
    assert [r["name"] for r in got] == ["x", "y"] and got[0]["extra"] is None
    assert expand_sources(["all"]) == ["product_hunt", "angellist", "clutch", "crunchbase"]
    assert expand_sources(["clutch"]) == ["clutch"]
    with pytest.raises(ValueError):
        union_sources([])


def test_run_stages_can_be_switched(spark):
    a = one(spark, name="Example Inc", domain="example.com", source="manual")
    b = one(spark, name="Example Inc.", domain="other.com", source="clutch")
    runs = spark.createDataFrame([("manual", True), ("clutch", False)], "source string, success boolean")
    assert run_leads([a, b]).count() == 1
    assert run_leads([a, b], options=RunOptions(name_threshold=None)).count() == 2
    assert run_leads([a, b], options=RunOptions(deduplicate=False, score=False)).count() == 2
    assert run_leads([a, b], source_runs=runs, options=RunOptions(deduplicate=False)).count() == 1
    assert run_leads([a, b], options=RunOptions(deduplicate=False, min_score=99)).count() == 0
    report = rank.top_report(run_leads([a, b])).collect()
    assert report[0]["domain"] == "example.com" and report[0]["technologies"] is None


def test_rules(spark):
    df = harbour(spark)
    got = RuleSet(is_high_value_target).add(F.col("enrichment.employee_count") > 40).apply(df).first()
    assert got["rules"] == {"rule_0": False, "rule_1": True}


def test_rejects(spark):
    df = one(spark, name="", website="/x", source="nowhere",
             enrichment=S.build(S.ENRICHMENT, founded_year=1700))
    bad = validate.rejected_rows(df, 2024).first()
    assert bad["reject_reasons"] == ["name", "website", "source", "founded_year"]
    assert validate.valid_rows(df, 2024).count() == 0


def test_literals_of_signatures_are_lossless():
    import re

    for name, patterns in enrich.SIGNATURES.items():
        plain, regexes = enrich._probes(patterns)
        for p in patterns:
            sample = re.sub(r"\\", "", p).replace(".*", " ").replace("[0-9]", "7")
            assert re.search(p, sample)
            assert any(x in sample for x in plain) or any(re.search(x, sample) for x in regexes), p


def test_stream(spark, tmp_path, sf_small):
    from leadframe.plans.inputs import leads

    rows = leads(spark, sf_small).withColumn("score", F.lit(None).cast(S.SCORE))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = score_stream(stream, 2024, [enrich.size_enricher, enrich.region_enricher])
    q = out.writeStream.format("memory").queryName("scored_leads").start()
    q.processAllAvailable()
    q.stop()
    batch = score_stream(rows, 2024, [enrich.size_enricher, enrich.region_enricher])
    pick = lambda d: sorted(map(tuple, d.select("seq", "score.total_score").collect()))
    assert pick(spark.table("scored_leads")) == pick(batch)
