"""Ground-station visibility: elevations, contact windows and their summaries.

States are rows with norad_cat_id, sequence, requested_at, latitude_deg,
longitude_deg, altitude_km. Stations are rows of ``schemas.STATION``.
"""

from __future__ import annotations

from datetime import datetime
from math import acos, cos, degrees, radians, sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from perigee import fixed_values as fixed
from perigee.functions import frames
from perigee.operators.joins import shuffled
from perigee.operators.params import require_between, utc_micros

# Cells of the sub-satellite point used as a join key, and the altitude bands a
# station's reach is computed for (the last one has no upper end).
CELL_DEG = 10
BAND_TOPS_KM = [450.0, 700.0, 1000.0, 1500.0, 2500.0, 6000.0, 14000.0, 26000.0]
# geodetic against geocentric verticals at both ends and at the horizon
VERTICAL_SLACK_DEG = 0.7
SEGMENT_STEPS = 4096

STATION_COLUMNS = ["station", "latitude_deg", "longitude_deg", "altitude_m"]


def station_vectors(stations: DataFrame) -> DataFrame:
    """Station name with its earth-fixed axes and horizon sines and cosines."""
    placed = frames.with_ecef(
        stations.select(*STATION_COLUMNS),
        "latitude_deg",
        "longitude_deg",
        "altitude_m / 1000D",
        "gs_",
    )
    return placed.drop("altitude_m")


def satellite_vectors(states: DataFrame) -> DataFrame:
    """States with earth-fixed axes, never NULL (NaN for states without a position).

    Were they nullable, the planner would add IS NOT NULL tests on them below the
    join and evaluate the whole frame chain a second time for those tests.
    """
    placed = frames.with_ecef(states, "latitude_deg", "longitude_deg", "altitude_km", "sat_")
    known = {f"sat_{a}": F.coalesce(f"sat_{a}", F.lit(float("nan"))) for a in ("x", "y", "z")}
    return placed.withColumns(known).drop("sat_sin_lat", "sat_cos_lat", "sat_sin_lon", "sat_cos_lon")


def elevations(states: DataFrame, passes: DataFrame, stations: DataFrame) -> DataFrame:
    """Elevation of every state over the stations its satellite is assigned to.

    ``passes`` holds (norad_cat_id, station) assignments, so the work is the number
    of assigned pairs and never satellites times stations. States and assignments are
    shuffled by satellite; neither is broadcast.
    """
    places = station_vectors(stations).drop("latitude_deg", "longitude_deg")
    assigned = passes.select("norad_cat_id", "station").join(places, ["station"])
    paired = satellite_vectors(states).join(shuffled(assigned), ["norad_cat_id"])
    return _drop_vectors(frames.with_elevation(paired, "sat_", "gs_"))


def _drop_vectors(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("sat_", "gs_"))])


def reach_deg(altitude_km: float | None, min_elevation_deg: float) -> float:
    """Largest ground angle between a station and the sub-satellite point of a
    satellite no higher than ``altitude_km`` seen at the minimum elevation."""
    elevation = radians(min_elevation_deg - VERTICAL_SLACK_DEG)
    lowest = fixed.EARTH_RADIUS_KM * (1 - fixed.EARTH_FLATTENING) + fixed.ALTITUDE_M[0] / 1000.0
    ratio = 0.0 if altitude_km is None else lowest / (fixed.EARTH_RADIUS_KM + altitude_km)
    return degrees(acos(ratio * cos(elevation)) - elevation) + 2 * VERTICAL_SLACK_DEG


ROWS, COLUMNS = 180 // CELL_DEG, 360 // CELL_DEG


def _cell(latitude: str, longitude: str) -> Column:
    """Cell number of a sub-satellite point; states without a position fall into none."""
    row = f"least(floor(({latitude} + 90D) / {CELL_DEG}D), {ROWS - 1})"
    column = f"least(floor(({longitude} + 180D) / {CELL_DEG}D), {COLUMNS - 1})"
    return F.expr(f"coalesce(cast({row} * {COLUMNS} + {column} as int), -1)")


def _band(altitude_km: str) -> Column:
    tops = " ".join(f"WHEN {altitude_km} <= {top}D THEN {band}" for band, top in enumerate(BAND_TOPS_KM))
    return F.expr(f"CASE {tops} ELSE {len(BAND_TOPS_KM)} END")


def coverage(stations: DataFrame, min_elevation_deg: float) -> DataFrame:
    """Cells and altitude bands each station can see into, a superset by a margin.

    A cell is kept when its centre lies within the band's reach plus half a cell
    diagonal. At most bands x cells rows per station.
    """
    half_diagonal = sqrt(2) * CELL_DEG / 2
    bands = ", ".join(
        f"struct({band} AS band, {min(180.0, reach_deg(top, min_elevation_deg) + half_diagonal)}D AS reach)"
        for band, top in enumerate([*BAND_TOPS_KM, None])
    )
    centre_lat = f"radians((floor(cell / {COLUMNS}D) + 0.5D) * {CELL_DEG}D - 90D)"
    centre_lon = f"radians((pmod(cell, {COLUMNS}) + 0.5D) * {CELL_DEG}D - 180D)"
    cosine = "gs_sin_lat * sin(_clat) + gs_cos_lat * cos(_clat) * cos(_clon - radians(longitude_deg))"
    return (
        station_vectors(stations)
        .selectExpr("*", f"explode(sequence(0, {ROWS * COLUMNS - 1})) AS cell")
        .selectExpr("*", f"{centre_lat} AS _clat", f"{centre_lon} AS _clon")
        .selectExpr("*", f"degrees(acos(greatest(-1D, least(1D, {cosine})))) AS _angle")
        .selectExpr("*", f"inline(array({bands}))")
        .where("_angle <= reach")
        .drop("_clat", "_clon", "_angle", "reach", "latitude_deg", "longitude_deg")
    )


def visible_samples(
    states: DataFrame, stations: DataFrame, min_elevation_deg: float = fixed.DEFAULT_MIN_ELEVATION_DEG
) -> DataFrame:
    """States seen at or above the minimum elevation, with the station seeing them.

    An equi-join on (altitude band, ground cell) instead of all pairs: a state meets
    only stations whose reach covers its cell, and the exact elevation test decides.
    """
    require_between("min_elevation_deg", min_elevation_deg, *fixed.ELEVATION_DEG)
    placed = satellite_vectors(states).withColumns(
        {"cell": _cell("latitude_deg", "longitude_deg"), "band": _band("altitude_km")}
    )
    near = placed.join(coverage(stations, min_elevation_deg), ["band", "cell"])
    seen = frames.with_elevation(near, "sat_", "gs_").where(
        F.col("elevation_deg") >= F.lit(float(min_elevation_deg))
    )
    return _drop_vectors(seen).drop("cell", "band")


def contact_windows(
    states: DataFrame,
    stations: DataFrame,
    min_elevation_deg: float = fixed.DEFAULT_MIN_ELEVATION_DEG,
    segment_steps: int = SEGMENT_STEPS,
) -> DataFrame:
    """Stretches of consecutive visible grid instants per satellite and station.

    Only visible samples are shuffled. They are grouped within pieces of the grid
    (``segment_steps`` instants), so one pair over a long grid is many tasks; the
    resulting few rows per pair are then joined where a stretch crosses a piece
    boundary. Peak ties go to the earliest instant.
    """
    visible = visible_samples(states, stations, min_elevation_deg).select(
        "norad_cat_id",
        "station",
        F.col("sequence").cast("bigint").alias("sequence"),
        "requested_at",
        "elevation_deg",
    )
    pieces = visible.withColumn("piece", F.floor(F.col("sequence") / F.lit(float(segment_steps))))
    place = ["norad_cat_id", "station", "piece"]
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("sequence"))
    stretches = (
        pieces.withColumn("_island", F.col("sequence") - rank)
        .groupBy(*place, "_island")
        .agg(
            F.min("sequence").alias("first"),
            F.max("sequence").alias("last"),
            F.min("requested_at").alias("start"),
            F.max("requested_at").alias("end"),
            F.max(F.struct("elevation_deg", -F.unix_micros("requested_at"))).alias("peak"),
        )
    )
    pair = Window.partitionBy("norad_cat_id", "station").orderBy("first")
    opens = F.coalesce(F.col("first") != F.lag("last").over(pair) + 1, F.lit(True))
    return (
        stretches.withColumn("_opens", opens)
        .withColumn(
            "_window",
            F.count_if("_opens").over(pair.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
        .groupBy("norad_cat_id", "station", "_window")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("peak").alias("peak"))
        .select(
            "norad_cat_id",
            "station",
            "start",
            "end",
            F.timestamp_micros(-F.col("peak.col2")).alias("peak_at"),
            ((F.unix_micros("end") - F.unix_micros("start")) / F.lit(1e6)).alias("duration_seconds"),
            F.col("peak.elevation_deg").alias("max_elevation_deg"),
        )
    )


def contact_summary(satellites: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows per satellite; satellites never seen keep a row with zero."""
    per_satellite = windows.groupBy("norad_cat_id").agg(
        F.count(F.lit(1)).alias("window_count"),
        F.sum("duration_seconds").alias("total_seconds"),
        F.max("max_elevation_deg").alias("max_elevation_deg"),
        F.min("start").alias("first_start"),
    )
    return satellites.join(per_satellite, "norad_cat_id", "left").withColumns(
        {
            "window_count": F.coalesce("window_count", F.lit(0)),
            "total_seconds": F.coalesce("total_seconds", F.lit(0.0)),
        }
    )


def nest_windows(windows: DataFrame) -> DataFrame:
    """Ordered window list per satellite and station, for the response edge.

    A pair has at most one window for every two instants of the job's grid, whatever
    the number of satellites and stations.
    """
    item = F.struct("start", "end", "peak_at", "duration_seconds", "max_elevation_deg")
    return windows.groupBy("norad_cat_id", "station").agg(
        F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list(item)).alias("windows")
    )


def page_windows(windows: DataFrame, origin: datetime, page_seconds: int) -> DataFrame:
    """Ordered window lists per satellite, station and page of time, for responses of any
    length: page ``n`` holds the windows that start in the n-th ``page_seconds`` from
    ``origin`` on. A row holds one window for every two instants of its page at most,
    however long the job's grid is; a hot pair is spread over its pages.
    """
    if page_seconds <= 0:
        raise ValueError("a page needs more than zero seconds")
    since = F.unix_micros("start") - F.lit(utc_micros(origin))
    page = F.floor(since / F.lit(page_seconds * 1_000_000)).cast("bigint")
    item = F.struct("start", "end", "peak_at", "duration_seconds", "max_elevation_deg")
    return windows.groupBy("norad_cat_id", "station", page.alias("page")).agg(
        F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list(item)).alias("windows")
    )
