"""Positions at any instant from a table of given states, by columns alone.

States are rows (norad_cat_id, requested_at, position and velocity axes, source_epoch) at
instants of any spacing. Two neighbouring states of a satellite span an interval; a request
meets the interval that holds its instant through an equi-join on satellite and stretch of
time, and a cubic through both positions and velocities gives the position between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from perigee import fixed_values as fixed
from perigee.functions import frames
from perigee.operators.joins import shuffled

AXES = ("x_km", "y_km", "z_km")
SPEEDS = ("vx_km_s", "vy_km_s", "vz_km_s")
# neighbouring states farther apart leave a gap; an interval touches two stretches at most
LARGEST_GAP_SECONDS = 600
METHOD = "cubic between given states"


def intervals(states: DataFrame, largest_gap_seconds: int = LARGEST_GAP_SECONDS) -> DataFrame:
    """(norad_cat_id, source_epoch, first, last, stretch): neighbouring states, in each
    stretch of time they touch. States of one instant count once (the first in order of
    their axes); a gap above ``largest_gap_seconds`` gives no interval."""
    point = F.struct(F.unix_micros("requested_at").alias("at"), *AXES, *SPEEDS)
    rows = states.groupBy("norad_cat_id", "requested_at").agg(F.min(F.struct(*AXES, *SPEEDS, "source_epoch")).alias("_s"))
    rows = rows.select("norad_cat_id", "requested_at", "_s.*").select("norad_cat_id", "source_epoch", point.alias("first"))
    ordered = Window.partitionBy("norad_cat_id").orderBy("first.at")
    pairs = rows.withColumn("last", F.lead("first").over(ordered))
    # the last state of all is an interval of its own, of no length
    pairs = pairs.withColumn("last", F.when(F.col("last.at") - F.col("first.at") <= largest_gap_seconds * 1_000_000, F.col("last")).otherwise(F.col("first")))
    width = F.lit(largest_gap_seconds * 1_000_000)
    place = lambda end: F.floor(F.col(f"{end}.at") / width)
    return pairs.withColumn("stretch", F.explode(F.array_distinct(F.array(place("first"), place("last")))))


def positions_at(requests: DataFrame, states: DataFrame, largest_gap_seconds: int = LARGEST_GAP_SECONDS) -> DataFrame:
    """Every request (norad_cat_id, requested_at, further columns) with its position.

    ``status`` is ok, ``unknown_id`` where no state has the satellite, or
    ``outside_states`` where its instant lies before, behind or in a gap of them; those
    have no position. Minutes from the source epoch and provenance are attached. Requests
    may repeat and may ask for one satellite in any share: the skew join splits them.
    States are shuffled like the requests, never broadcast.
    """
    found = intervals(states, largest_gap_seconds).withColumnRenamed("norad_cat_id", "_id")
    at = F.unix_micros("requested_at")
    asked = requests.withColumn("_stretch", F.floor(at / F.lit(largest_gap_seconds * 1_000_000)))
    inside = (at >= F.col("first.at")) & ((at < F.col("last.at")) | ((at == F.col("first.at")) & (F.col("first.at") == F.col("last.at"))))
    on = (F.col("norad_cat_id") == F.col("_id")) & (F.col("_stretch") == F.col("stretch")) & inside
    joined = asked.join(shuffled(found), on, "left").drop("_id", "stretch", "_stretch")
    known = states.select(F.col("norad_cat_id").alias("_known")).distinct()
    joined = joined.join(shuffled(known), F.col("norad_cat_id") == F.col("_known"), "left")
    status = F.when(F.col("first").isNotNull(), "ok").when(F.col("_known").isNull(), "unknown_id").otherwise("outside_states")
    axes = {name: _between(name, speed, at) for name, speed in zip(AXES, SPEEDS, strict=True)}
    placed = joined.withColumns({"status": status, **axes}).drop("first", "last", "_known")
    return frames.with_geodetic(placed, "requested_at", *AXES).withColumns(
        {
            "time_delta_minutes_from_epoch": (at - F.unix_micros("source_epoch")) / F.lit(6e7),
            "propagator": F.lit(METHOD),
            "coordinate_frame": F.lit(fixed.COORDINATE_FRAME),
            "is_approximate": F.lit(True),
        }
    )


def _between(axis: str, speed: str, at: Column) -> Column:
    """The cubic through two positions and velocities; a state's own position at its instant."""
    seconds = (F.col("last.at") - F.col("first.at")) / F.lit(1e6)
    u = F.try_divide((at - F.col("first.at")) / F.lit(1e6), seconds)
    p, q, v, w = F.col(f"first.{axis}"), F.col(f"last.{axis}"), F.col(f"first.{speed}"), F.col(f"last.{speed}")
    rest = F.lit(1.0) - u
    value = rest * rest * ((F.lit(1.0) + u * 2.0) * p + u * seconds * v) + u * u * ((F.lit(3.0) - u * 2.0) * q - rest * seconds * w)
    return F.when(seconds == 0, p).otherwise(value)
