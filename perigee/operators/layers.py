"""Raw records to bronze, silver and gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from perigee import fixed_values as fixed
from perigee.functions import labels, parsing
from perigee.schemas import BRONZE, GOLD, SILVER
from perigee.sources import payloads


def with_lineage(df: DataFrame, ingested_at: Column) -> DataFrame:
    """Append source lineage and the ingest instant, cut to whole seconds."""
    return df.withColumns(
        {
            "source_name": F.lit(fixed.SOURCE_NAME),
            "source_url": F.lit(fixed.SOURCE_URL),
            "source_type": F.lit(fixed.SOURCE_TYPE),
            "ingested_at": F.date_trunc("second", ingested_at),
        }
    ).withColumn("ingestion_date", F.to_date("ingested_at"))


def build_bronze(
    records: DataFrame, ingested_at: Column, strict: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """``record_text`` rows to BRONZE: source-shaped strings plus lineage.

    Narrow: one parse per record, no shuffle. Blank numbers become NULL; blank
    names, ids and epochs stay as they came. ``keep`` carries extra columns.
    """
    accepted = payloads.accepted(payloads.check_shape(records), strict=strict)
    kept = keep or []
    fields = ("OBJECT_NAME", "OBJECT_ID", "NORAD_CAT_ID", "EPOCH", "MEAN_MOTION", "INCLINATION", "ECCENTRICITY")
    texts = accepted.withColumns({f"_{name}": parsing.json_field(F.col("record"), name) for name in fields})
    shaped = texts.select(
        F.col("_OBJECT_NAME").alias("object_name"),
        F.col("_OBJECT_ID").alias("object_id"),
        F.col("_NORAD_CAT_ID").alias("norad_cat_id"),
        F.col("_EPOCH").alias("epoch_raw"),
        parsing.blank_to_null(F.col("_MEAN_MOTION")).alias("mean_motion_raw"),
        parsing.blank_to_null(F.col("_INCLINATION")).alias("inclination_raw"),
        parsing.blank_to_null(F.col("_ECCENTRICITY")).alias("eccentricity_raw"),
        F.to_json("record").alias("raw_record_json"),
        ingested_at.alias("_ingested_raw"),
        *kept,
    )
    bronze = with_lineage(shaped, F.col("_ingested_raw")).drop("_ingested_raw")
    return bronze.select(*BRONZE.fieldNames(), *kept)


def build_rejects(records: DataFrame) -> DataFrame:
    """The records bronze leaves out, with the reason."""
    return payloads.rejected(payloads.check_shape(records))


def build_silver(bronze: DataFrame, tie_break: list[Column] | None = None, keep: list[str] | None = None) -> DataFrame:
    """BRONZE to SILVER: typed, one row per (typed id, raw epoch text), labelled.

    The survivor of a duplicate group is the newest ingest, then ``tie_break``
    (raw record text by default). Spark trims each map task to its first row per
    key before the shuffle (window group limit), so a group of copies holding a
    third of the input still arrives as one row per map task. ``keep`` carries extra columns.
    """
    order = [F.col("ingested_at").desc(), *(tie_break or [F.col("raw_record_json").asc()])]
    typed = bronze.withColumn("norad_cat_id", parsing.long_or_null(F.col("norad_cat_id")))
    key = Window.partitionBy("norad_cat_id", "epoch_raw").orderBy(*order)
    return (
        typed.withColumn("_rank", F.row_number().over(key))
        .where(F.col("_rank") == 1)
        .withColumns(
            {
                "epoch": F.try_to_timestamp(F.col("epoch_raw")),
                "mean_motion": parsing.double_or_null(F.col("mean_motion_raw")),
                "inclination": parsing.double_or_null(F.col("inclination_raw")),
                "eccentricity": parsing.double_or_null(F.col("eccentricity_raw")),
            }
        )
        .withColumn("epoch_age_hours", labels.age_hours_whole_seconds(F.col("epoch"), F.col("ingested_at")))
        .withColumns(
            {
                "freshness_status": labels.freshness(F.col("epoch_age_hours")),
                "quality_status": labels.quality(F.col("epoch"), F.col("norad_cat_id")),
            }
        )
        .select(*SILVER.fieldNames(), *(keep or []))
    )


def build_gold(silver: DataFrame) -> DataFrame:
    """SILVER to GOLD: counts and age statistics per date, source and label.

    Partial aggregation leaves a handful of rows per map task. Unordered: readers
    sort with ``ordered_gold``.
    """
    return (
        silver.withColumn("metric_date", F.col("ingestion_date"))
        .groupBy("metric_date", "source_name", "freshness_status", "quality_status")
        .agg(
            F.count(F.lit(1)).alias("satellite_count"),
            F.avg("epoch_age_hours").alias("avg_epoch_age_hours"),
            F.min("epoch_age_hours").alias("min_epoch_age_hours"),
            F.max("epoch_age_hours").alias("max_epoch_age_hours"),
        )
    )


LABELS = ["metric_date", "source_name", "freshness_status", "quality_status"]
GOLD_STATE = T.StructType(
    [
        *[f for f in GOLD.fields if f.name in LABELS],
        T.StructField("satellite_count", T.LongType()),
        T.StructField("aged_count", T.LongType()),
        T.StructField("age_sum", T.DoubleType()),
        T.StructField("age_min", T.DoubleType()),
        T.StructField("age_max", T.DoubleType()),
        T.StructField("batch", T.StringType()),
    ]
)


def gold_state(silver: DataFrame) -> DataFrame:
    """What gold needs of the silver rows of a ``batch``, per label: mergeable figures."""
    age = "epoch_age_hours"
    return (
        silver.withColumn("metric_date", F.col("ingestion_date"))
        .groupBy(*LABELS, "batch")
        .agg(
            F.count(F.lit(1)).alias("satellite_count"),
            F.count(age).alias("aged_count"),
            F.sum(age).alias("age_sum"),
            F.min(age).alias("age_min"),
            F.max(age).alias("age_max"),
        )
        .select(*GOLD_STATE.fieldNames())
    )


def folded_gold(state: DataFrame) -> DataFrame:
    """GOLD from the states of any number of batches."""
    return state.groupBy(*LABELS).agg(
        F.sum("satellite_count").alias("satellite_count"),
        F.try_divide(F.sum("age_sum"), F.sum("aged_count")).alias("avg_epoch_age_hours"),
        F.min("age_min").alias("min_epoch_age_hours"),
        F.max("age_max").alias("max_epoch_age_hours"),
    )


def ordered_gold(gold: DataFrame) -> DataFrame:
    return gold.orderBy("metric_date", "source_name", "freshness_status", "quality_status")
