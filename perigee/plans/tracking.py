"""Positions, orbit tracks and contact windows for whole catalogs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from perigee import fixed_values as fixed
from perigee.operators import catalog as cat, checks, ephemeris, timegrid, visibility
from perigee.operators.params import require_between


def prepared(catalog: DataFrame) -> DataFrame:
    """One propagation-ready row per satellite; of several copies the last counts:
    the newest, then the later one in the payload where positions were kept.

    Every later stage generates rows per satellite, so copies must not multiply them.
    """
    return ephemeris.prepare(_last_copies(catalog))


def _last_copies(catalog: DataFrame) -> DataFrame:
    order = ["ingested_at", *[c for c in ("record_position",) if c in catalog.columns], "object_name", "raw_record_json"]
    return cat.last_per_id(catalog, order)


def unprepared(catalog: DataFrame) -> DataFrame:
    """One row per satellite that ``prepared`` leaves out; ``status`` says what it lacks."""
    rows = ephemeris.not_ready(ephemeris.with_elements(_last_copies(catalog)))
    return rows.select(*ephemeris.LABELS, F.col("reason").alias("status")).withColumnRenamed("epoch", "source_epoch")


def positions(catalog: DataFrame, instants: list[datetime]) -> DataFrame:
    """States of every satellite at the given instants; those that lack an epoch or
    elements have a status and no position."""
    states = ephemeris.with_states(timegrid.with_instants(prepared(catalog), instants))
    return states.unionByName(timegrid.with_instants(unprepared(catalog), instants), allowMissingColumns=True)


def requested_positions(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """States for rows (norad_cat_id, requested_at) of satellites that can be propagated;
    requests of one satellite may be any share of the table: the skew join splits them.
    ``answered_requests`` keeps the others too."""
    asked = requests.join(prepared(catalog), ["norad_cat_id"])
    return ephemeris.with_states(asked)


def answered_requests(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """``requested_positions`` with every request: without a position where ``status`` is
    unknown_id, missing_epoch or missing_elements."""
    rest = requests.join(prepared(catalog).select("norad_cat_id"), ["norad_cat_id"], "left_anti")
    rest = rest.join(unprepared(catalog), ["norad_cat_id"], "left")
    rest = rest.withColumn("status", F.coalesce("status", F.lit("unknown_id")))
    return requested_positions(catalog, requests).unionByName(rest, allowMissingColumns=True)


def orbit_tracks(
    catalog: DataFrame,
    start: datetime,
    end: datetime,
    step_seconds: int = 120,
    max_points: int = fixed.MAX_TRACK_POINTS,
) -> DataFrame:
    """Track points of every satellite, the end instant always included."""
    require_between("step_seconds", step_seconds, *fixed.TRACK_STEP_SECONDS)
    grid = timegrid.with_track_grid(prepared(catalog), start, end, step_seconds, max_points)
    return ephemeris.with_states(grid).withColumn("visualization_mode", F.lit(fixed.TRACK_MODE))


def nest_tracks(points: DataFrame) -> DataFrame:
    """One row per satellite with its ordered points, as many as ``orbit_tracks`` was allowed."""
    item = F.struct("sequence", "requested_at", "position_km", "velocity_km_s", "approximate_geodetic")
    return (
        ephemeris.nested(points)
        .groupBy("norad_cat_id", "object_name", "source_epoch", "freshness_status", "epoch_age_hours")
        .agg(F.count(F.lit(1)).alias("sample_count"), F.sort_array(F.collect_list(item)).alias("points"))
    )


def catalog_contact_windows(
    catalog: DataFrame,
    stations: DataFrame,
    start: datetime,
    end: datetime,
    step_seconds: int = 60,
    min_elevation_deg: float = fixed.DEFAULT_MIN_ELEVATION_DEG,
) -> DataFrame:
    """Contact windows of every satellite over every station; ``catalog_contact_summary``
    has what gave none. Stations out of range have none: ``checks.quarantined`` lists them."""
    stations, _ = checks.quarantined(stations)
    states = _contact_states(catalog, start, end, step_seconds)
    return visibility.contact_windows(states.where(F.col("status") == "ok"), stations, min_elevation_deg)


def _contact_states(catalog: DataFrame, start: datetime, end: datetime, step_seconds: int) -> DataFrame:
    require_between("step_seconds", step_seconds, *fixed.CONTACT_STEP_SECONDS)
    narrow = prepared(catalog).drop("object_name", "freshness_status", "epoch_age_hours")
    return ephemeris.with_states(timegrid.with_grid(narrow, start, end, step_seconds))


def catalog_contact_summary(
    catalog: DataFrame,
    stations: DataFrame,
    start: datetime,
    end: datetime,
    step_seconds: int = 60,
    min_elevation_deg: float = fixed.DEFAULT_MIN_ELEVATION_DEG,
) -> DataFrame:
    """One row per satellite of the catalog, with or without windows: what it lacks or ok
    (``status``), how many instants were tried and failed, and the windows' summary."""
    windows = catalog_contact_windows(catalog, stations, start, end, step_seconds, min_elevation_deg)
    tried = _contact_states(catalog, start, end, step_seconds).groupBy("norad_cat_id").agg(
        F.lit("ok").alias("status"),
        F.count(F.lit(1)).alias("instants"),
        F.count_if(F.col("status") != "ok").alias("failed_instants"),
    )
    none = F.lit(0).cast("bigint")
    lacking = unprepared(catalog).select("norad_cat_id", "status", none.alias("instants"), none.alias("failed_instants"))
    return visibility.contact_summary(tried.unionByName(lacking), windows)
