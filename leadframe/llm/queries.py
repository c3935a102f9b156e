"""Registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadframe.llm import (
    divergence, fingerprint, licenses, main_text, mixing, ngram_join, packing, pii, quality_model, quality_rules, secrets,
    url_filter, variants,
)
from leadframe.llm.common import documents, table


def _mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return mixing.rates(docs, mixing.domains_of(docs, table(spark, folder, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": lambda s, d: pii.found(documents(s, d)),
    "op2_packing": lambda s, d: packing.packed(documents(s, d)),
    "op3_main_text": lambda s, d: main_text.extracted(table(s, d, "pages")),
    "op4_fingerprint": lambda s, d: fingerprint.compared(documents(s, d)),
    "op5_url_filter": lambda s, d: url_filter.judged(table(s, d, "pages")),
    "op6_mixing": _mixing,
    "op7_secrets": lambda s, d: secrets.scanned(documents(s, d)),
    "op8_quality_rules": lambda s, d: quality_rules.judged(documents(s, d)),
    "op9_ngram_join": lambda s, d: ngram_join.joined(documents(s, d)),
    "op10_quality_model": lambda s, d: quality_model.scored(documents(s, d)),
    "op11_licenses": lambda s, d: licenses.scanned(documents(s, d)),
    "op12_variants": lambda s, d: variants.grouped_variants(documents(s, d)),
    "op13_divergence": lambda s, d: divergence.audited(documents(s, d)),
}

ORACLES: dict[str, str] = {
    "op5_url_filter": url_filter.sql(),
    "op8_quality_rules": quality_rules.sql(),
    "op13_divergence": divergence.sql(),
}
