"""Landed catalog payloads: JSON arrays or JSON lines to one row per record text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from perigee.operators.joins import computed_once

POSITION = "record_position"
NOT_A_LIST = "payload_not_a_list"
NOT_AN_OBJECT = "item_not_an_object"


def read_payload_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row ``payload`` per landed download.

    A download is one bounded catalog response, so files are the unit of
    parallelism. Feeds too large for that land as JSON lines (``read_record_lines``),
    which Spark splits.
    """
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def read_record_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row ``record_text`` per line of JSON-lines files (splittable).

    ``record_position`` grows along the lines of a file; it has gaps.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "record_text")
    return lines.withColumn(POSITION, F.monotonically_increasing_id()).where(F.trim("record_text") != "")


def explode_payloads(payloads: DataFrame) -> DataFrame:
    """One row per array item with ``record_text``; a payload that is no array stays
    one row with a reason, so nothing is lost. An empty array is a valid download.
    ``record_position`` is the item's place in its payload."""
    others = [c for c in payloads.columns if c != "payload"]
    parsed = computed_once(payloads, _items=F.from_json("payload", "array<string>"))
    is_list = F.coalesce(F.ltrim("payload").startswith("[") & F.col("_items").isNotNull(), F.lit(False))
    return parsed.select(
        *others,
        F.posexplode(F.when(is_list, F.col("_items")).otherwise(F.array("payload"))).alias("_place", "record_text"),
        F.when(~is_list, F.lit(NOT_A_LIST)).alias("reject_reason"),
    ).select(*others, "record_text", "reject_reason", F.col("_place").cast("bigint").alias(POSITION))


def check_shape(records: DataFrame) -> DataFrame:
    """Append ``record`` (variant, NULL when rejected) and ``reject_reason``."""
    before = F.col("reject_reason") if "reject_reason" in records.columns else F.lit(None).cast("string")
    parsed = records.withColumn("_parsed", F.try_parse_json("record_text"))
    # text that parses and opens with a brace is an object
    is_object = F.col("_parsed").isNotNull() & F.ltrim("record_text").startswith("{")
    reason = F.coalesce(before, F.when(~is_object, F.lit(NOT_AN_OBJECT)))
    return computed_once(
        parsed, record=F.when(is_object & before.isNull(), F.col("_parsed")), reject_reason=reason
    ).drop("_parsed")


def accepted(checked: DataFrame, strict: bool = False) -> DataFrame:
    """Well-shaped records; ``strict`` fails the job on the first bad one."""
    if strict:
        guard = F.raise_error(F.concat(F.lit("catalog payload: "), F.col("reject_reason")))
        checked = checked.withColumn(
            "record", F.when(F.col("reject_reason").isNotNull(), guard.cast("variant")).otherwise(F.col("record"))
        ).where(F.col("record").isNotNull())
        return checked.drop("reject_reason")
    return checked.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNotNull()).drop("record")
