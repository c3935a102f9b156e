"""De-duplication against what earlier batches kept.

The kept records of all batches lie in two tables that are bucketed once: their keys by key, and
the block keys of their names by block key.  A new batch meets them there: its rows go to the buckets,
the old tables are not shuffled.  What is left is de-duplicated by itself and appended.  Batches
give what one pass over all of them in their order gives, as a dropped record never decides over
another one.

The order of tokens that makes block keys comparable is fixed by the first batch and kept with the
index.  Every row bears the id of its batch, and a batch counts once its id is written, last of
all: after a failure the rows of the lost batch are never read, and the batch can be added anew.

Defined cases: an empty first batch fixes an empty order, which is as good as any; an empty batch
changes nothing; rows without a key only match by name; names match whatever their key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadframe.operators.dedup import DEFAULT_THRESHOLD, kept_records, records_of
from leadframe.operators.similarity import Bounds, is_similar, signatures, token_ranks
from leadframe.session import cut_lineage


#: Batches of an index; one more is refused (write the kept rows to a new index then).
MAX_BATCHES = 100_000


class KeptIndex:
    """Kept records under a table name; one writer at a time."""

    def __init__(self, spark: SparkSession, name: str, threshold: float = DEFAULT_THRESHOLD, buckets: int = 200):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.bounds = Bounds(threshold)

    def _table(self, part: str) -> str:
        return f"{self.name}_{part}"

    def _committed(self, part: str) -> DataFrame:
        # at most MAX_BATCHES ids of 32 characters are broadcast, so the buckets stay as they are
        rows, batches = (self.spark.table(self._table(x)) for x in (part, "batches"))
        return rows.join(F.broadcast(batches), "batch", "left_semi")

    def _append(self, rows: DataFrame, part: str, by: str) -> None:
        rows.write.bucketBy(self.buckets, by).sortBy(by).mode("append").saveAsTable(self._table(part))

    @property
    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self._table("batches"))

    def add(self, batch: DataFrame) -> DataFrame:
        """``seq`` of the rows of a batch that are kept; all of them come after the earlier batches."""
        rows = cut_lineage(records_of(batch))
        if self.exists:
            if self.spark.table(self._table("batches")).count() >= MAX_BATCHES:
                raise ValueError(f"the index {self.name} has {MAX_BATCHES} batches")
            rank = {r["gram"]: r["rank"] for r in self.spark.table(self._table("ranks")).collect()}
            rows = cut_lineage(self._unknown(rows, rank))
        else:
            rank = token_ranks(rows.select("name").distinct(), self.bounds)
            order = self.spark.createDataFrame(list(rank.items()), "gram string, rank int")
            order.write.mode("overwrite").saveAsTable(self._table("ranks"))
        kept = cut_lineage(kept_records(rows, self.bounds))
        number = uuid.uuid4().hex
        mark = F.lit(number).alias("batch")
        self._append(kept.filter(F.col("key").isNotNull()).select("key", mark).distinct(), "keys", "key")
        names = kept.groupBy("name").agg(F.min("seq").alias("nid"))
        keys = F.explode(signatures("name", self.bounds, rank))
        self._append(names.select(keys.alias("g"), "nid", "name", F.length("name").alias("len"), mark), "blocks", "g")
        whole = names.select(F.xxhash64("name").alias("h"), "name", mark)
        self._append(whole, "names", "h")
        done = self.spark.createDataFrame([(number,)], "batch string")
        done.write.mode("append").saveAsTable(self._table("batches"))
        return kept.select("seq")

    def _unknown(self, rows: DataFrame, rank: dict[str, int]) -> DataFrame:
        """Rows whose key and name no kept record has, nor one of a similar name."""
        keys, names = self._committed("keys"), self._committed("names")
        rows = rows.join(keys.select("key"), "key", "left_anti")
        rows = rows.withColumn("h", F.xxhash64("name")).join(names.select("h", "name"), ["h", "name"], "left_anti")
        rows = cut_lineage(rows.drop("h"))
        new = rows.groupBy("name").agg(F.min("seq").alias("later"))
        keys = F.explode(signatures("name", self.bounds, rank))
        tokens = new.select("later", "name", F.length("name").alias("len"), keys.alias("g"))
        old = self._committed("blocks").select("g", F.col("name").alias("early_name"), F.col("len").alias("old_len"))
        r = self.bounds.ratio - 1e-9
        fits = (F.col("old_len") >= F.col("len") * r) & (F.col("len") >= F.col("old_len") * r)
        met = tokens.join(old, "g").filter(fits).select("name", "early_name").distinct()
        known = met.filter(is_similar("name", "early_name", self.bounds.t)).select("name").distinct()
        return rows.join(known, "name", "left_anti")

    def drop(self) -> None:
        """Delete the index."""
        for part in ("keys", "blocks", "names", "batches", "ranks"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(part)}")
