"""Ingestion runs, latest snapshot and first/last seen."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from perigee import fixed_values as fixed
from perigee.operators.params import require_between
from perigee.schemas import SATELLITE


def success_run(run_id: int, at: Column, snapshots: DataFrame) -> DataFrame:
    """The log row of a finished run, its count taken from the stored snapshots."""
    return snapshots.agg(F.count(F.lit(1)).cast("int").alias("record_count")).select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(fixed.SOURCE_NAME).alias("source_name"),
        F.lit(fixed.SOURCE_URL).alias("source_url"),
        at.alias("started_at"),
        at.alias("completed_at"),
        F.lit("success").alias("status"),
        F.lit(None).cast("int").alias("http_status"),
        "record_count",
        F.lit(None).cast("string").alias("error_message"),
    )


def failed_run(spark, run_id: int, at: datetime, message: str, http_status: int | None = None) -> DataFrame:
    return spark.range(1).select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(fixed.SOURCE_NAME).alias("source_name"),
        F.lit(fixed.SOURCE_URL).alias("source_url"),
        F.lit(at).alias("started_at"),
        F.lit(at).alias("completed_at"),
        F.lit("error").alias("status"),
        F.lit(http_status).cast("int").alias("http_status"),
        F.lit(0).alias("record_count"),
        F.lit(message).alias("error_message"),
    )


def successful(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "success")


def latest_successful_run(runs: DataFrame) -> DataFrame:
    """At most one row; equal completion times go to the higher run id."""
    return successful(runs).orderBy(F.col("completed_at").desc_nulls_last(), F.col("run_id").desc()).limit(1)


def latest_catalog(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Snapshots of the latest successful run.

    The run side is a single row by construction (limit 1), so it is broadcast;
    with snapshots stored by ``run_id`` the scan prunes to one directory.
    """
    latest = latest_successful_run(runs).select("run_id")
    return snapshots.join(F.broadcast(latest), "run_id", "left_semi")


def recent_runs(runs: DataFrame, limit: int = fixed.RUN_LIST_DEFAULT) -> DataFrame:
    require_between("limit", limit, *fixed.RUN_LIST_LIMIT)
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def ingest_due(runs: DataFrame, now: Column, ttl_hours: float = fixed.REUSE_WITHIN_HOURS) -> DataFrame:
    """One row: the latest success (if any), its age and whether a new ingest is due."""
    micros = F.unix_micros(now) - F.unix_micros("completed_at")
    recent = micros <= F.lit(int(round(ttl_hours * 3600e6)))
    return latest_successful_run(runs).agg(
        F.max("run_id").alias("run_id"),
        F.max("completed_at").alias("completed_at"),
        F.max(micros / F.lit(3600e6)).alias("age_hours"),
        F.coalesce(~F.bool_or(recent), F.lit(True)).alias("ingest_due"),
    )


def satellites_seen(snapshots: DataFrame, order: list[Column]) -> DataFrame:
    """First and last ingest per satellite with the latest name, object id and source."""
    latest = F.max_by(F.struct("object_name", "object_id", "source_name"), F.struct(*order))
    return (
        snapshots.groupBy("norad_cat_id")
        .agg(
            F.min("ingested_at").alias("first_seen_at"),
            F.max("ingested_at").alias("last_seen_at"),
            latest.alias("_latest"),
        )
        .select("norad_cat_id", "_latest.*", "first_seen_at", "last_seen_at")
    )


def upsert_satellites(existing: DataFrame, batch: DataFrame, order: list[Column]) -> DataFrame:
    """The satellite table after a run: new ids inserted, known ids updated except
    for their first sighting. Both sides hold one row per id before the join."""
    new = satellites_seen(batch, order).select(
        "norad_cat_id",
        F.struct("object_name", "object_id", "source_name", "first_seen_at", "last_seen_at").alias("new"),
    )
    old = existing.select(
        "norad_cat_id",
        F.struct("object_name", "object_id", "source_name", "first_seen_at", "last_seen_at").alias("old"),
    )
    pick = F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col("old"))
    return (
        old.join(new, "norad_cat_id", "full_outer")
        .withColumn("_row", pick)
        .select(
            "norad_cat_id",
            "_row.object_name",
            "_row.object_id",
            "_row.source_name",
            F.coalesce("old.first_seen_at", "new.first_seen_at").alias("first_seen_at"),
            "_row.last_seen_at",
        )
    )


SATELLITE_BUCKETS = 64


def bucket_of(norad_cat_id: Column) -> Column:
    return F.pmod(F.xxhash64(norad_cat_id), F.lit(SATELLITE_BUCKETS)).cast("int")


def sightings(snapshots: DataFrame, order: list[Column]) -> DataFrame:
    """A run's contribution to the satellite table: SATELLITE rows, one per id it holds."""
    runs = snapshots.groupBy("norad_cat_id").agg(F.max("run_id").alias("last_run_id"))
    seen = satellites_seen(snapshots, order).join(runs.withColumnRenamed("norad_cat_id", "_id"), F.col("norad_cat_id").eqNullSafe(F.col("_id")))
    return seen.withColumn("bucket", bucket_of(F.col("norad_cat_id"))).select(*SATELLITE.fieldNames())


def merged_sightings(rows: DataFrame) -> DataFrame:
    """SATELLITE rows of any number of runs as one row per id: the first and last sighting
    of all, the names of the run that saw it last (of equal instants the higher run).

    The order of the runs and the grouping of earlier merges don't matter, so runs may
    add their rows side by side.
    """
    names = F.max_by(F.struct("object_name", "object_id", "source_name", "last_run_id"), F.struct("last_seen_at", "last_run_id"))
    merged = rows.groupBy("norad_cat_id", "bucket").agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), names.alias("_names")
    )
    return merged.select("*", "_names.*").select(*SATELLITE.fieldNames())


def stored_row(catalog: DataFrame) -> DataFrame:
    """CATALOG rows as stored: the source struct as JSON text."""
    return catalog.withColumn("source_json", F.to_json("source")).drop("source")


def restored_row(stored: DataFrame) -> DataFrame:
    """Stored rows back to CATALOG."""
    source = F.from_json("source_json", "name string, url string, type string")
    return stored.withColumn("source", source).drop("source_json")
