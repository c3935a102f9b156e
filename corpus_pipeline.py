"""From raw documents to packed training sequences, stage by stage.

Every stage works on all rows its predecessor kept.  Between stages the rows are written to the
shared folder and read again, so a lost executor costs a part of one stage.

Defined cases: a null or empty text fails the quality rules; very long texts go through whole; equal
texts are near copies, of which the least id stays (with a null id last), and of equal rows one;
rows with a null or repeated id stay if their text is the one kept of its class; the mix repeats
documents up to ``mixing.GROWTH`` times the tokens, and repeats are packed like other documents; an
empty table gives an empty result; further columns travel until packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadframe.llm import mixing, ngram_join, packing, pii, quality_rules
from leadframe.llm.common import documents, table
from leadframe.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_per_class(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the text; ``n_chars`` follows."""
    masked = pii.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target mix, within its bound; each stays once at least."""
    return mixing.mixed(docs, mixing.domains_of(docs, table(spark, sf_dir, "labels")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and where they stand in the sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing to target weights", mix),
    ("packing", pack),
]

#: Similarity joins, trained models and packing have no SQL; tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
