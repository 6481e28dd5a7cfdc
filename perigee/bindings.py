"""The shared test tables seen as orbit records, runs, telemetry, states and stations.

Every adapter keeps all rows of its table; odd values are put in by rule so that
each branch of the jobs is met.
"""

from __future__ import annotations

from datetime import datetime, timezone
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from perigee.functions import frames
from perigee.operators import timegrid
from perigee.operators.alerts import policy_table

INGESTED_AT = datetime(2024, 2, 1, tzinfo=timezone.utc)
GRID_START = datetime(2024, 1, 1, 0, 0, tzinfo=timezone.utc)
GRID_END = datetime(2024, 1, 1, 2, 0, tzinfo=timezone.utc)
GRID_STEP_SECONDS = 60
MU_KM3_S2 = 398600.4418


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def raw_orbit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as catalog record texts; every tenth event comes twice."""
    ev = events(spark, sf_dir)
    record = F.struct(
        F.col("event_type").alias("OBJECT_NAME"),
        F.concat(F.lit("U-"), F.col("user_id")).alias("OBJECT_ID"),
        F.when(F.col("event_id") % 23 == 0, "abc").otherwise(F.col("user_id").cast("string")).alias("NORAD_CAT_ID"),
        F.when(
            F.col("event_id") % 17 != 0,
            F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss"),
        ).alias("EPOCH"),
        F.when(F.col("event_id") % 19 == 0, "").otherwise(F.col("value").cast("string")).alias("MEAN_MOTION"),
        (F.col("user_id") % 180).alias("INCLINATION"),
        F.when(F.col("event_id") % 7 == 0, "n/a").otherwise("0.0005").alias("ECCENTRICITY"),
    )
    copies = F.sequence(F.lit(1), F.when(F.col("event_id") % 10 == 0, 2).otherwise(1))
    return ev.select("event_id", F.to_json(record).alias("record_text"), F.explode(copies).alias("copy"))


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as landed payload texts, some of them misshaped."""
    n = F.col("event_id")
    payload = (
        F.when(n % 11 == 0, F.col("props"))
        .when(n % 13 == 0, F.concat(F.lit("["), F.col("props"), F.lit(", "), n, F.lit("]")))
        .when(n % 7 == 0, F.concat(F.lit("["), F.col("props")))
        .when(n % 5 == 0, F.concat(F.lit("["), F.col("props"), F.lit(", "), F.col("props"), F.lit("]")))
        .otherwise(F.concat(F.lit("["), F.col("props"), F.lit("]")))
    )
    return events(spark, sf_dir).select("event_id", payload.alias("payload"))


def ingestion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per day of the month; every seventh day failed."""
    failed = F.col("run_id") % 7 == 0
    return (
        events(spark, sf_dir)
        .groupBy(F.dayofmonth("ts").cast("bigint").alias("run_id"))
        .agg(
            F.min("ts").alias("started_at"),
            F.max("ts").alias("completed_at"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            "run_id",
            F.lit("events").alias("source_name"),
            F.lit("events.parquet").alias("source_url"),
            "started_at",
            "completed_at",
            F.when(failed, "error").otherwise("success").alias("status"),
            F.when(failed, 503).alias("http_status"),
            F.when(failed, 0).otherwise(F.col("n")).cast("int").alias("record_count"),
            F.when(failed, "request failed").alias("error_message"),
        )
    )


def orbit_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as catalog snapshots of their day's run."""
    return events(spark, sf_dir).select(
        F.dayofmonth("ts").cast("bigint").alias("run_id"),
        F.col("event_id").alias("snapshot_id"),
        F.col("user_id").alias("norad_cat_id"),
        F.col("event_type").alias("object_name"),
        F.concat(F.lit("U-"), F.col("user_id")).alias("object_id"),
        F.lit("events").alias("source_name"),
        F.col("ts").alias("ingested_at"),
        F.col("value").alias("mean_motion"),
        F.col("props").alias("raw_record_json"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as telemetry: the user is the entity, the type metric and subsystem.

    Every third event belongs to a second scenario, and every 97th lost its value.
    """
    return events(spark, sf_dir).select(
        F.col("user_id").alias("entity_id"),
        F.when(F.col("event_id") % 3 == 0, "storm").otherwise("nominal").alias("scenario"),
        F.unix_micros("ts").alias("sequence_count"),
        F.col("event_id").alias("sample_ordinal"),
        F.col("ts").alias("source_event_time"),
        F.col("event_type").alias("subsystem"),
        F.col("event_type").alias("measurement_name"),
        F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("measurement_value"),
    )


def telemetry_policies(spark: SparkSession) -> DataFrame:
    """Three policies over the event types; clicks and views are not watched."""
    bounds = {
        "conservative_ops": ((60.0, 100.0), (15.0, 5.0), 1),
        "balanced_ops": ((80.0, 120.0), (10.0, 3.0), 2),
        "relaxed_ops": ((100.0, 160.0), (5.0, 1.0), 3),
    }
    rows = []
    for policy, (high, low, persistence) in bounds.items():
        rows.append((policy, "error", "high", *high, persistence, f"act on {policy}", policy))
        for metric in ("purchase", "signup"):
            rows.append((policy, metric, "low", *low, persistence, f"act on {policy}", policy))
    return policy_table(spark, rows)


def circular_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One circular orbit per supplier: radius, inclination, node, start angle, rate."""
    k = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .select(
            k.alias("norad_cat_id"),
            F.col("s_name").alias("object_name"),
            F.col("s_nationkey").alias("nation_key"),
            (F.lit(6700.0) + k * 131 % 1300).alias("radius_km"),
            (F.lit(30.0) + k * 17 % 69).alias("inclination_deg"),
            (k * 37 % 360).cast("double").alias("node_deg"),
            (k * 53 % 360).cast("double").alias("start_deg"),
        )
        .withColumn(
            "rate_rad_s",
            F.sqrt(F.lit(MU_KM3_S2) / (F.col("radius_km") * F.col("radius_km") * F.col("radius_km"))),
        )
    )


def circular_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orbit states over the test grid, from the closed form of a circular orbit."""
    grid = timegrid.with_grid(circular_orbits(spark, sf_dir), GRID_START, GRID_END, GRID_STEP_SECONDS)
    seconds = F.col("sequence") * F.lit(float(GRID_STEP_SECONDS))
    df = grid.withColumns(
        {
            "_u": frames.radians(F.col("start_deg")) + F.col("rate_rad_s") * seconds,
            "_o": frames.radians(F.col("node_deg")),
            "_i": frames.radians(F.col("inclination_deg")),
        }
    )
    df = df.withColumns(
        {
            "_along": F.col("radius_km") * F.cos("_u"),
            "_across": F.col("radius_km") * F.sin("_u"),
        }
    )
    df = df.withColumns(
        {
            "x_km": F.col("_along") * F.cos("_o") - F.col("_across") * F.sin("_o") * F.cos("_i"),
            "y_km": F.col("_along") * F.sin("_o") + F.col("_across") * F.cos("_o") * F.cos("_i"),
            "z_km": F.col("_across") * F.sin("_i"),
        }
    )
    return df.select(
        "norad_cat_id", "object_name", "nation_key", "sequence", "requested_at", "x_km", "y_km", "z_km"
    )


def circular_geodetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.with_geodetic(circular_states(spark, sf_dir), "requested_at", "x_km", "y_km", "z_km")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("station"),
        (F.lit(-84.0) + k * 7).alias("latitude_deg"),
        (k * 37 % 360 - F.lit(180.0)).alias("longitude_deg"),
        (k * 10).cast("double").alias("altitude_m"),
        k.alias("nation_key"),
    )


def station_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each satellite is tracked by its own nation's station."""
    owners = circular_orbits(spark, sf_dir).select("norad_cat_id", "nation_key")
    return owners.join(stations(spark, sf_dir), "nation_key").select("norad_cat_id", "station")


def element_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circular orbits, made slightly eccentric, as catalog element records.

    Every eleventh record lacks one of three elements in turn.
    """
    k = F.col("norad_cat_id")
    orbit = circular_orbits(spark, sf_dir)

    def unless_dropped(turn: int, value):
        return F.when((k % 11 != 0) | (k % 3 != turn), value)

    record = F.struct(
        F.col("object_name").alias("OBJECT_NAME"),
        F.concat(F.lit("S-"), k).alias("OBJECT_ID"),
        k.alias("NORAD_CAT_ID"),
        F.concat(
            F.lit("2023-12-31T"), F.format_string("%02d:%02d:30.250000", k % 24, k % 60)
        ).alias("EPOCH"),
        F.round(F.col("rate_rad_s") * F.lit(86400.0 / (2 * pi)), 8).alias("MEAN_MOTION"),
        F.col("inclination_deg").alias("INCLINATION"),
        F.round((k * 7 % 400) / F.lit(10000.0), 4).alias("ECCENTRICITY"),
        unless_dropped(0, F.col("node_deg")).alias("RA_OF_ASC_NODE"),
        unless_dropped(1, (k * 29 % 360).cast("double")).alias("ARG_OF_PERICENTER"),
        unless_dropped(2, F.col("start_deg")).alias("MEAN_ANOMALY"),
        F.when(k % 5 != 0, F.round((k % 50) / F.lit(100000.0), 5)).alias("BSTAR"),
    )
    return orbit.select(F.to_json(record).alias("record_text"))


def position_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as requests for a satellite's position at the event's instant."""
    return events(spark, sf_dir).select(
        F.col("user_id").alias("norad_cat_id"), F.col("event_id").alias("request_id"), F.col("ts").alias("requested_at")
    )


def landed_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as landed station rows, some of them out of range or without a value."""
    k = F.col("n_nationkey").cast("bigint")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("station"),
        (F.lit(-84.0) + k * 9).alias("latitude_deg"),
        F.when(k % 11 != 5, (k * 37 % 400 - F.lit(180.0))).alias("longitude_deg"),
        F.when(k % 7 == 3, F.lit(float("nan"))).otherwise((k * 500).cast("double")).alias("altitude_m"),
    )


RECORDS_PER_FILE = 50_000


def landed_array_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Orbit records of the events as files of one JSON array each, of bounded size."""
    records = raw_orbit_records(spark, sf_dir).where(F.col("copy") == 1)
    marked = records.withColumn("file", F.floor(F.col("event_id") / RECORDS_PER_FILE))
    with_id = F.concat(F.lit('{"EVENT_ID": '), "event_id", F.lit(", "), F.expr("substring(record_text, 2)"))
    in_file = Window.partitionBy("file").orderBy("event_id")
    first = F.row_number().over(in_file) == 1
    last = F.lead("event_id").over(in_file).isNull()
    line = F.concat(F.when(first, "[").otherwise(" ,"), with_id, F.when(last, "]").otherwise(""))
    marked.select("file", line.alias("value")).write.partitionBy("file").text(folder)


def circular_motion(orbits: DataFrame, seconds: Column) -> DataFrame:
    """Positions and velocities on circular orbits, ``seconds`` after the grid's start."""
    df = orbits.withColumns(
        {
            "_u": frames.radians(F.col("start_deg")) + F.col("rate_rad_s") * seconds,
            "_o": frames.radians(F.col("node_deg")),
            "_i": frames.radians(F.col("inclination_deg")),
        }
    )

    def axes(prefix: str, unit: str, size: Column, along: Column, across: Column) -> dict[str, Column]:
        return {
            f"{prefix}x_{unit}": size * (F.cos("_o") * along - F.sin("_o") * across * F.cos("_i")),
            f"{prefix}y_{unit}": size * (F.sin("_o") * along + F.cos("_o") * across * F.cos("_i")),
            f"{prefix}z_{unit}": size * across * F.sin("_i"),
        }

    radius = F.col("radius_km")
    places = axes("", "km", radius, F.cos("_u"), F.sin("_u"))
    speeds = axes("v", "km_s", radius * F.col("rate_rad_s"), -F.sin("_u"), F.cos("_u"))
    return df.withColumns({**places, **speeds}).drop("_u", "_o", "_i")


def moving_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States with velocities over the test grid; epochs lie up to a day before it."""
    grid = timegrid.with_grid(circular_orbits(spark, sf_dir), GRID_START, GRID_END, GRID_STEP_SECONDS)
    moved = circular_motion(grid, F.col("sequence") * F.lit(float(GRID_STEP_SECONDS)))
    epoch = F.timestamp_micros(F.unix_micros(F.lit(GRID_START)) - F.col("norad_cat_id") % 24 * 3_600_000_000)
    return moved.withColumn("source_epoch", epoch)


def instant_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as requests for a position within the two hours of the grid and a minute more."""
    since = F.unix_micros("ts") % 7_260_000_000
    return events(spark, sf_dir).select(
        F.col("user_id").alias("norad_cat_id"),
        F.col("event_id").alias("request_id"),
        F.timestamp_micros(F.unix_micros(F.lit(GRID_START)) + since).alias("requested_at"),
        (since / F.lit(1e6)).alias("seconds"),
    )
