"""Pages travel in small batches, small tables in many parts."""

import pyarrow as pa

from leadframe.plans import inputs as I
from leadframe.sources import html as H


def test_nodes_leave_in_slices(monkeypatch):
    pages = [f"<p class=c{k}>a<b>{k}</b>" for k in range(50)] + [None, ""]
    whole = H._to_arrow([H.read_page(h) for h in pages]).to_pylist()
    monkeypatch.setattr(H, "_SLICE", 100)
    parts = list(H._in_slices(iter([pa.array(pages), pa.array([], pa.string())]), None))
    assert max(len(p) for p in parts) <= 101  # a null page has a length of one
    assert len(parts) > 5 and [n for p in parts for n in p.to_pylist()] == whole


def test_nodes_of_many_pages_keep_their_rows(spark, monkeypatch):
    rows = spark.range(0, 3000, 1, 2).selectExpr("id", "concat('<p>', repeat('x ', 1000), id, '</p>') AS html")
    got = rows.select("id", H.html_nodes("html").alias("n")).selectExpr("id", "n[1].text AS t").collect()
    assert len(got) == 3000 and all(r["t"].endswith(f" {r['id']}") for r in got)


def test_detail_pages_are_spread(spark):
    few = spark.range(1000).coalesce(1)
    got = I.spread(few)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert sorted(r["id"] for r in got.collect()) == list(range(1000))
