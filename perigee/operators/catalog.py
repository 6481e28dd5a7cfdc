"""Catalog records: normalization, lookup, search and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from perigee import fixed_values as fixed
from perigee.functions import labels, parsing
from perigee.sources import payloads

BAD_ID = "norad_cat_id_not_an_integer"


def normalize(records: DataFrame, ingested_at: Column, keep: list[str] | None = None) -> DataFrame:
    """``record_text`` rows to CATALOG rows plus ``reject_reason`` (NULL when good).

    Keeps every copy and the full ingest instant. Ids follow integer parsing: a
    JSON number is cut to its whole part, text must be a whole number.
    """
    checked = payloads.check_shape(records)
    texts = {
        f"_{name}": parsing.json_field(F.col("record"), name)
        for name in ("OBJECT_NAME", "OBJECT_ID", "EPOCH", "MEAN_MOTION", "INCLINATION", "ECCENTRICITY")
    }
    out = checked.withColumns(texts).select(
        F.when(F.coalesce("_OBJECT_NAME", F.lit("")) == "", fixed.UNNAMED_OBJECT)
        .otherwise(F.col("_OBJECT_NAME"))
        .alias("object_name"),
        F.col("_OBJECT_ID").alias("object_id"),
        F.try_variant_get("record", "$.NORAD_CAT_ID", "bigint").alias("norad_cat_id"),
        parsing.epoch_or_null(F.col("_EPOCH")).alias("epoch"),
        parsing.plain_double_or_null(F.col("_MEAN_MOTION")).alias("mean_motion"),
        parsing.plain_double_or_null(F.col("_INCLINATION")).alias("inclination"),
        parsing.plain_double_or_null(F.col("_ECCENTRICITY")).alias("eccentricity"),
        F.struct(
            F.lit(fixed.SOURCE_NAME).alias("name"),
            F.lit(fixed.SOURCE_URL).alias("url"),
            F.lit(fixed.SOURCE_TYPE).alias("type"),
        ).alias("source"),
        F.to_json("record").alias("raw_record_json"),
        ingested_at.alias("ingested_at"),
        F.col("reject_reason").alias("_shape"),
        *(keep or []),
    )
    out = out.withColumn("epoch_age_hours", labels.age_hours_exact(F.col("epoch"), F.col("ingested_at")))
    return out.withColumns(
        {
            "freshness_status": labels.freshness(F.col("epoch_age_hours")),
            "reject_reason": F.coalesce(F.col("_shape"), F.when(F.col("norad_cat_id").isNull(), BAD_ID)),
        }
    ).drop("_shape")


def good(normalized: DataFrame, strict: bool = False) -> DataFrame:
    """CATALOG rows; ``strict`` fails the batch when any record was rejected."""
    if strict:
        guard = F.raise_error(F.concat(F.lit("catalog record: "), F.col("reject_reason")))
        checked = F.when(F.col("reject_reason").isNotNull(), guard.cast("bigint")).otherwise(F.col("norad_cat_id"))
        return normalized.withColumn("norad_cat_id", checked).drop("reject_reason")
    return normalized.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejects(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("reject_reason").isNotNull())


def last_per_id(catalog: DataFrame, order: list[Column | str]) -> DataFrame:
    """One row per id, the last in ``order``.

    The rank filter lets Spark keep one row per id and map task before the
    shuffle, so an id with very many copies does not load one task.
    """
    last = Window.partitionBy("norad_cat_id").orderBy(*[F.desc(c) for c in order])
    return catalog.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") == 1).drop("_rank")


def lookup(catalog: DataFrame, norad_cat_id: int, order: list[Column | str]) -> DataFrame:
    """The record of one id; the filter reaches the scan because it is the window key."""
    return last_per_id(catalog, order).where(F.col("norad_cat_id") == norad_cat_id)


def bounded(catalog: DataFrame, include_raw: bool = False) -> DataFrame:
    """Hide the raw payload unless asked for; always say whether there is one."""
    raw = F.col("raw_record_json")
    out = catalog.withColumn("raw_record_available", F.coalesce((raw != "") & (raw != "{}"), F.lit(False)))
    if include_raw:
        return out
    return out.drop("raw_record_json")


def to_response_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row, NULL fields left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("body"))


def search(
    catalog: DataFrame, query: str, order: list[Column | str], limit: int | None = fixed.SEARCH_LIMIT
) -> DataFrame:
    """Records whose name, id and object id contain the text, first ``limit`` in order."""
    wanted = query.strip().lower()
    if wanted:
        text = F.concat_ws(
            " ", "object_name", F.col("norad_cat_id").cast("string"), F.coalesce("object_id", F.lit(""))
        )
        catalog = catalog.where(F.lower(text).contains(wanted))
    ordered = catalog.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def totals(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count(F.lit(1)).alias("total_records"), F.max("ingested_at").alias("last_ingested_at")
    )
