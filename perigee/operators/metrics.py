"""Gold contract, gold load and the reporting queries over gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from perigee.schemas import GOLD
from perigee.sources.tables import conform


def contract_violations(gold: DataFrame) -> DataFrame:
    """One row per contract column: type expected and found, NULLs not allowed there.

    One aggregation pass over the table; the type check reads only the schema.
    """
    found = {f.name: f.dataType.simpleString() for f in gold.schema.fields}
    present = [f for f in GOLD.fields if f.name in found]
    counts = gold.agg(
        *[
            (F.lit(0) if f.nullable else F.count_if(F.col(f.name).isNull())).cast("bigint").alias(f.name)
            for f in present
        ]
    )
    lines = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("expected_type"),
            F.lit(found.get(f.name, "missing")).alias("found_type"),
            (F.col(f.name) if f.name in found else F.lit(None).cast("bigint")).alias("null_violations"),
        )
        for f in GOLD.fields
    ]
    return (
        counts.select(F.explode(F.array(*lines)).alias("line"))
        .select("line.*")
        .withColumn(
            "passed",
            (F.col("expected_type") == F.col("found_type"))
            & (F.coalesce(F.col("null_violations"), F.lit(1)) == 0),
        )
    )


def require_contract(gold: DataFrame) -> DataFrame:
    """Raise unless the table meets the contract. Looks at eight rows at most."""
    failed = contract_violations(gold).where(~F.col("passed")).take(len(GOLD.fields))
    if failed:
        raise ValueError("gold contract: " + "; ".join(str(row.asDict()) for row in failed))
    return gold


def gold_load_rows(staged: DataFrame) -> DataFrame:
    """Typed field-by-field projection of staged gold plus the load time."""
    return conform(staged, GOLD).withColumn("loaded_at", F.current_timestamp().cast("timestamp_ntz"))


def load_gold(staged: DataFrame, path: str) -> DataFrame:
    """Load staged gold into the reporting table after the contract check.

    The table is partitioned by metric_date; the dates staged replace what the table
    had of them, so that a second load of the same rows changes nothing.
    """
    rows = gold_load_rows(require_contract(staged))
    columns = rows.columns
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric_date").parquet(path)
    return staged.sparkSession.read.schema(rows.schema).parquet(path).select(*columns)


def freshness_by_date(gold: DataFrame) -> DataFrame:
    return (
        gold.groupBy("metric_date", "freshness_status")
        .agg(F.sum("satellite_count").alias("satellite_count"))
        .orderBy("metric_date", "freshness_status")
    )


def quality_by_date(gold: DataFrame) -> DataFrame:
    """``avg_epoch_age_hours`` is the plain mean of the group means; the weighted
    column beside it counts every satellite once."""
    aged = F.when(F.col("avg_epoch_age_hours").isNotNull(), F.col("satellite_count"))
    weighted = F.try_divide(
        F.sum(F.col("avg_epoch_age_hours") * F.col("satellite_count")), F.sum(aged)
    )
    return (
        gold.groupBy("metric_date", "quality_status")
        .agg(
            F.sum("satellite_count").alias("satellite_count"),
            F.round(F.avg("avg_epoch_age_hours"), 2).alias("avg_epoch_age_hours"),
            F.round(weighted, 2).alias("weighted_avg_epoch_age_hours"),
        )
        .orderBy("metric_date", "quality_status")
    )


def freshness_pivot(gold: DataFrame) -> DataFrame:
    def total(status: str):
        return F.sum(
            F.when(F.col("freshness_status") == status, F.col("satellite_count")).otherwise(F.lit(0))
        ).alias(f"{status}_satellites")

    return (
        gold.groupBy("metric_date")
        .agg(
            total("fresh"),
            total("stale"),
            total("unknown"),
            F.sum("satellite_count").alias("total_satellites"),
        )
        .orderBy(F.col("metric_date").desc())
    )
