"""JSON payloads of the organisation search as company records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadframe import schema as S
from leadframe.functions.text import clean_company_name, clean_text
from leadframe.functions.urls import canonical_url
from leadframe.operators.union import page_position

_S = T.StringType()
PROPERTIES = T.StructType(
    [
        T.StructField("name", _S),
        T.StructField("domain", _S),
        T.StructField("homepage_url", _S),
        T.StructField("short_description", _S),
        T.StructField("total_funding_usd", T.DoubleType()),
        T.StructField("city_name", _S),
        T.StructField("region_name", _S),
        T.StructField("country_code", _S),
    ]
)
PAYLOAD = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField(
                        "items",
                        T.ArrayType(T.StructType([T.StructField("properties", PROPERTIES)])),
                    )
                ]
            ),
        )
    ]
)


def payload_items(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per organisation; ``unreadable_payloads`` has those that give none."""
    keep = [c for c in payloads.columns if c != payload]
    parsed = payloads.select(*keep, F.from_json(payload, PAYLOAD).alias("j"))
    return parsed.select(*keep, F.posexplode("j.data.items").alias("item_pos", "i")).select(
        *keep, "item_pos", "i.properties.*"
    )


def unreadable_payloads(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads that no organisation can be read from, with the reason instead of the text.

    One parse per payload: ``empty`` (null or blank), ``malformed`` (no JSON, or a value of another
    type than the record has), ``no items`` (the list of organisations is missing).  A payload with
    an empty list is readable.  ``near`` is the first 80 characters.
    """
    keep = [c for c in payloads.columns if c != payload]
    kind = T.StructType([*PAYLOAD.fields, T.StructField("_corrupt", _S)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = payloads.withColumn("_j", F.from_json(payload, kind, options))
    reason = (
        F.when(F.col(payload).isNull() | F.col(payload).rlike(r"^\s*$"), "empty")
        .when(F.col("_j._corrupt").isNotNull(), "malformed")
        .when(F.col("_j.data.items").isNull(), "no items")
    )
    found = parsed.select(*keep, reason.alias("reason"), F.substring(payload, 1, 80).alias("near"))
    return found.filter(F.col("reason").isNotNull())


def read_organisations(
    payloads: DataFrame, page_order: str = "page_id", payload: str = "payload",
    query: str | None = None,
) -> DataFrame:
    """Company records of the payloads.

    ``query`` is the searched name or category the payloads answer: with a query
    column given, rows without a query give nothing.
    """
    if query is not None:
        payloads = payloads.filter(F.coalesce(F.col(query), F.lit("")) != "")
    items = payload_items(payloads.select(page_order, payload), payload)
    name = clean_company_name("name")
    url_ok = F.col("homepage_url").isNull() | canonical_url("homepage_url").isNotNull()
    items = items.filter((name != "") & url_ok)
    return S.companies(
        items,
        seq=page_position(page_order, "item_pos"),
        name=name,
        domain=F.col("domain"),
        website=canonical_url("homepage_url"),
        description=clean_text("short_description"),
        source="crunchbase",
        enrichment=S.build(
            S.ENRICHMENT,
            funding_info=S.build(
                S.FUNDING_INFO, total_funding=F.coalesce("total_funding_usd", F.lit(0.0))
            ),
            geographic_info=S.build(
                S.GEOGRAPHIC_INFO,
                city=F.col("city_name"),
                region=F.col("region_name"),
                country=F.col("country_code"),
            ),
        ),
    )
