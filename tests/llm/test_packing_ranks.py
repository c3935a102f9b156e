"""Ranks of pieces, however many parts a length is dealt in."""

from leadframe.llm import packing


def test_a_length_is_ranked_in_as_many_parts_as_it_needs(spark, monkeypatch):
    """Ranks count through each length, whatever the size of the parts."""
    rows = [(d, 0, 5 if d % 3 else 7, d * 31 % 97, 9) for d in range(500)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    counts = {5: 333, 7: 167}
    for size in (1, 40, 10**6):
        monkeypatch.setattr(packing, "PART_ROWS", size)
        got = packing._ranked(pieces, counts).select("length", "rank").collect()
        for length, n in counts.items():
            assert sorted(r["rank"] for r in got if r["length"] == length) == list(range(n))
    assert packing.placed(pieces.limit(0)).count() == 0
