import random

from pyspark.sql import functions as F

from leadframe.functions import collections as C
from leadframe.functions import text as X


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_text(spark):
    cases = {
        "  Hello   World!  ": "Hello World!", "a  b\x85c": "a b c", "ñandú #1 $x": "ñandú 1 x",
        "a / b": "a  b", "": "", None: "", "x_y-z.(1)&?": "x_y-z.(1)&?", "日本 – ok": "日本  ok",
    }
    assert run(spark, cases, X.clean_text) == list(cases.values())


def test_clean_company_name(spark):
    cases = {
        "Example Inc.": "Example", "Foo Inc Co": "Foo Inc", "Foo Co Inc": "Foo", "Foo Inc ": "Foo Inc",
        "ACME GMBH": "ACME", "Inc": "Inc", "A S.A.": "A", "Zinc": "Zinc", None: "", "Bar Company": "Bar",
    }
    assert run(spark, cases, X.clean_company_name) == list(cases.values())


def test_contacts(spark):
    assert run(spark, ["Contact us at info@example.com", "none", None], X.extract_email) == [
        "info@example.com", None, None]
    assert run(spark, ["Call us at +1-234-567-8900", "no", None], X.extract_phone) == [
        "+1-234-567-8900", None, None]
    assert run(spark, ["info@example.com"], X.mask_email) == ["i***@example.com"]
    assert run(spark, ["+1-234-567-8900"], X.mask_digits) == ["+*-***-***-**00"]


def test_numbers(spark):
    assert run(spark, ["1,234 jobs", "none", "", None], X.digits_int) == [1234, 0, 0, 0]
    assert run(spark, [" 4.5 ", "x", "", None], X.float_or_null) == [4.5, None, None, None]
    assert run(spark, ["google-cloud", "mongodb"], X.title_name) == ["Google Cloud", "Mongodb"]


def test_chunks_and_lookup(spark):
    df = spark.createDataFrame([(["1", "2", "3", "4", "5"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(C.chunk_array("a", 2)).collect()] == [[["1", "2"], ["3", "4"], ["5"]], []]
    text = '{"a": {"b": {"c": 123}}, "z": 0, "e": ""}'
    got = spark.createDataFrame([(text,)], "t string").select(
        C.json_get("t", "a", "b", "c"), C.json_get("t", "a", "x", "y", default="0"),
        C.json_get("t", "z", default="9"), C.json_get("t", "e", default="9")).first()
    assert tuple(got) == ("123", "0", "0", "")


def test_positions_and_next_value(spark):
    rng = random.Random(1)
    rows = sorted({(rng.choice(["a", "b", None]), rng.randrange(400)) for _ in range(120)},
                  key=lambda r: (r[0] or "", r[1]))
    df = spark.createDataFrame(rows, "g string, o long").withColumn(
        "v", F.when(F.col("o") % 7 == 0, F.col("o")))
    for by in ("g", None):
        seen = {}
        want = {}
        for g, o in sorted(rows, key=lambda r: r[1]):
            k = g if by else 0
            if by is None and (o in [x[1] for x in want]):
                continue
            want[(g, o)] = seen.get(k, 0)
            seen[k] = want[(g, o)] + 1
        if by:
            got = {(r.g, r.o): r.position for r in C.global_position(df, "o", by).collect()}
            assert got == want
        else:
            unique = df.dropDuplicates(["o"])
            got = sorted((r.o, r.position) for r in C.global_position(unique, "o", None).collect())
            assert [p for _, p in got] == list(range(len(got)))
    got = {(r.g, r.o): r.n for r in C.next_value(df, "g", "o", F.col("v"), "n").collect()}
    for g, o in rows:
        later = [x for h, x in rows if h == g and x > o and x % 7 == 0]
        assert got[(g, o)] == (min(later) if later else None)


def test_positions_of_sparse_and_hot_orders(spark):
    """Order values all over the 64-bit range, and one group that holds most rows."""
    df = spark.range(5000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(-1).alias("g"), F.xxhash64("id").alias("o"))
    rows = sorted((r.g, r.o) for r in df.collect())
    got = {(r.g, r.o): r.position for r in C.global_position(df, "o", "g").collect()}
    first = {g: i for i, (g, _) in reversed(list(enumerate(rows)))}
    assert got == {x: i - first[x[0]] for i, x in enumerate(rows)}
    chunks = sorted((r.o, r.batch_id) for r in C.chunk_rows(df, "o", 7).collect())
    assert [b for _, b in chunks] == [i // 7 for i in range(5000)]
    after = {(r.g, r.o): r.n for r in C.next_value(df, "g", "o", F.when(F.col("o") % 500 == 0, F.col("o")), "n").collect()}
    want, seen = {}, {}
    for g, o in reversed(rows):
        want[g, o] = seen.get(g)
        if o % 500 == 0:
            seen[g] = o
    assert after == want
    assert C.global_position(df.limit(0), "o", "g").count() == 0
