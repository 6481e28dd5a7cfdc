"""Landed payloads to the three layers, and the reporting queries over gold."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from perigee.operators import layers, metrics
from perigee.operators.params import utc
from perigee.session import configure
from perigee.sources import arrays, payloads, tables


def run_medallion(
    spark: SparkSession,
    input_path: str,
    output_root: str,
    ingested_at: datetime,
    lines: bool = False,
    strict: bool = True,
    mode: str = "overwrite",
) -> dict[str, str]:
    """Write bronze, silver and gold and return their paths.

    Each layer is read back before the next is built, so nothing is computed twice
    and a lost executor repeats one layer's tasks only. ``strict`` fails on the first
    misshaped record; otherwise these go to a table of rejects with their reasons.
    """
    configure(spark)
    if lines:
        records = payloads.read_record_lines(spark, input_path)
    else:
        records = arrays.read_record_arrays(spark, input_path)
    bronze = layers.build_bronze(records, F.lit(utc(ingested_at)), strict=strict)
    paths = {"bronze": tables.write_layer(bronze, "bronze", output_root, mode)}
    if not strict:
        paths["rejects"] = tables.write_layer(layers.build_rejects(records), "rejects", output_root, mode)
    silver = layers.build_silver(tables.read_layer(spark, "bronze", output_root))
    paths["silver"] = tables.write_layer(silver, "silver", output_root, mode)
    gold = layers.build_gold(tables.read_layer(spark, "silver", output_root))
    paths["gold"] = tables.write_layer(gold, "gold", output_root, mode)
    return paths


def gold_kpis(gold: DataFrame) -> dict[str, DataFrame]:
    return {
        "freshness_by_date": metrics.freshness_by_date(gold),
        "quality_by_date": metrics.quality_by_date(gold),
        "freshness_pivot": metrics.freshness_pivot(gold),
    }
