"""What the similarity join writes and reads on its way."""

import os
import random

from pyspark.sql import functions as F

from leadframe.llm import ngram_join as J
from leadframe.session import work_dir

SCHEMA = "doc_id long, text string"


def near_copies(spark, n, seed=6):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = [" ".join(base[:k] + ["new"] + base[k:]) for k in rng.sample(range(120), n)]
    texts += [" ".join(f"u{rng.randrange(9000)}" for _ in range(40)) for _ in range(n)]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], SCHEMA)


def test_only_texts_of_chosen_sets_are_described(spark):
    docs = near_copies(spark, 8)
    scan = J._scan(docs, "text", False)
    sets = scan.where("doc_id < 3").select("set_id", F.col("key").alias("first_key"), F.lit(1).cast("long").alias("copies"))
    got = J._with_grams(docs, J.cut_lineage(sets), "text")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan.split("Join")[0] and "Python" not in plan.split("Join", 1)[1]
    assert got.columns == ["set_id", "copies", "grams"]
    assert {bytes(r["set_id"]) for r in got.collect()} == {bytes(r["set_id"]) for r in sets.collect()}


def test_a_key_of_two_texts_gives_each_set_its_own(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (None, None)], SCHEMA)
    sets = J._scan(docs, "text", False).where("n > 0").select("set_id", F.col("key").alias("first_key"), F.lit(1).cast("long").alias("copies"))
    got = J._with_grams(docs, J.cut_lineage(sets), "text").collect()
    assert len(got) == 2 and all(J.set_id(J.np.frombuffer(r["grams"], "<u8")) == bytes(r["set_id"]) for r in got)


def test_tables_of_the_rounds_are_gone(spark):
    # a local folder, as the tests set no other
    folder = work_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = J.joined(near_copies(spark, 12)).collect()
    assert sorted(r["n_links"] for r in rows) == [0] * 12 + [11] * 12
    left = [spark.read.parquet(f"{folder}/{x}").columns for x in set(os.listdir(folder)) - before]
    assert left and not [c for c in left if {"grams", "cell", "block"} & set(c) or "node" in c and "sid" in c]


def test_texts_of_other_documents_do_not_travel(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = docs.select(F.col("doc_id").alias("first_key"), "text")
    wanted = spark.createDataFrame([(k,) for k in range(0, 20_000, 400)], "first_key long")
    got = {r["first_key"] for r in J._perhaps(rows, "first_key", wanted).collect()}
    assert got >= set(range(0, 20_000, 400)) and len(got) < 60
    none = wanted.where("first_key < 0")
    assert J._perhaps(rows, "first_key", none).isEmpty()
    sets = wanted.select(F.lit(b"x").alias("set_id"), "first_key", F.lit(1).cast("long").alias("copies"))
    plan = J._with_grams(docs, J.cut_lineage(sets), "text")._jdf.queryExecution().optimizedPlan().toString()
    # the filter stands below the join by the key
    assert "getbit" in plan.split("Join", 1)[1]


def test_samples_are_fetched_once_and_tokens_move_where_they_are_compared(spark, monkeypatch):
    plans, write = [], J.cut_lineage

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(J, "cut_lineage", kept)
    monkeypatch.setattr(J, "BLOCK_SETS", 8)
    rows = J.joined(near_copies(spark, 60)).collect()
    assert sorted(r["n_links"] for r in rows) == [0] * 60 + [59] * 60
    # the recursion: one join of nodes with samples
    assert len([p for p in plans if "Join" in p and "follow(" in p]) == 1
    # a block's tokens come as they are written; those of other cells only from sets that take part
    moved = [p for p in plans if "grams" in p and "RepartitionByExpression" in p]
    assert len(moved) == 2 and "Join" not in moved[0] and "beside" in moved[1]


def test_two_levels_at_once_are_those_of_two_steps():
    grams = J.np.unique(J.mixed(J.np.arange(40, dtype=J._U)) >> J._U(32))
    nodes = J.mixed(J.np.arange(5, dtype=J._U))
    below, above = J.children(grams, nodes, 0.8)
    single = [J.children(grams, nodes[k : k + 1], 0.8)[0] for k in range(5)]
    assert [x for s in single for x in s] == list(below) and list(above) == sorted(above)
    batch = J.pd.DataFrame({"sid": [7], "sample": [grams.astype("<u4").tobytes()], "nodes": [nodes.view("i8")]})
    got = next(J._follow_twice(0.8)(iter([batch])))
    assert list(got["node"].to_numpy().view(J._U)) == list(below)
    want = [list(J.children(grams, below[k : k + 1], 0.8)[0].view("i8")) for k in range(len(below))]
    assert [list(x) for x in got["below"]] == want
