"""Time grids: one row per satellite and instant."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from perigee import fixed_values as fixed
from perigee.operators.params import require_range, require_step, utc_micros
from perigee.session import fan_out

BLOCK = 1024


def sample_count(start: datetime, end: datetime, step_seconds: int, pin_end: bool = False) -> int:
    require_step(step_seconds)
    first, last = require_range(start, end)
    whole, rest = divmod(last - first, step_seconds * 1_000_000)
    return whole + 1 + (1 if pin_end and rest else 0)


def with_grid(
    satellites: DataFrame, start: datetime, end: datetime, step_seconds: int, pin_end: bool = False
) -> DataFrame:
    """Append ``sequence`` and ``requested_at``: start, start+step, … up to end.

    ``pin_end`` adds end itself when the step misses it. A catalog is few bytes but
    its grid is not: satellites first fan out into blocks of instants, the blocks
    are spread over all tasks by hash, and rows are generated there. Nothing about
    the instants is shuffled.
    """
    count = sample_count(start, end, step_seconds, pin_end)
    first, last = require_range(start, end)
    blocks = -(-count // BLOCK)
    lower = F.col("_block") * F.lit(BLOCK)
    upper = F.least(lower + F.lit(BLOCK), F.lit(count)) - F.lit(1)
    micros = F.lit(first) + F.col("sequence").cast("bigint") * F.lit(step_seconds * 1_000_000)
    return (
        satellites.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .repartition(fan_out(satellites.sparkSession), "norad_cat_id", "_block")
        .withColumn("sequence", F.explode(F.sequence(lower, upper)))
        .drop("_block")
        .withColumn("requested_at", F.timestamp_micros(F.least(micros, F.lit(last))))
    )


def with_track_grid(
    satellites: DataFrame,
    start: datetime,
    end: datetime,
    step_seconds: int,
    max_points: int = fixed.MAX_TRACK_POINTS,
) -> DataFrame:
    """Track grid: the end instant is always the last point; too long a track is refused."""
    count = sample_count(start, end, step_seconds, pin_end=True)
    if count > max_points:
        raise ValueError(f"a track of {count} points is over the {max_points} allowed")
    return with_grid(satellites, start, end, step_seconds, pin_end=True)


def with_instants(satellites: DataFrame, instants: list[datetime]) -> DataFrame:
    """Append the given instants in order."""
    if not instants:
        raise ValueError("at least one instant is needed")
    micros = F.array(*[F.lit(utc_micros(i)) for i in instants])
    return (
        satellites.repartition(fan_out(satellites.sparkSession), "norad_cat_id")
        .select("*", F.posexplode(micros).alias("sequence", "_micros"))
        .withColumn("requested_at", F.timestamp_micros("_micros"))
        .drop("_micros")
    )
