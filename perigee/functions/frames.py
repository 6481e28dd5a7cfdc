"""Time scales and reference frames as native column arithmetic."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, functions as F

from perigee.fixed_values import EARTH_FLATTENING, EARTH_RADIUS_KM, GEODETIC_PASSES

ECC_SQUARED = EARTH_FLATTENING * (2 - EARTH_FLATTENING)
MICROS_PER_DAY = 86_400_000_000
UNIX_EPOCH_JD = 2440587.5
J2000_JD = 2451545.0


def julian_day_start(ts: Column) -> Column:
    """Julian date of the UTC midnight before ``ts``."""
    return F.floor(F.unix_micros(ts) / MICROS_PER_DAY) + UNIX_EPOCH_JD


def day_fraction(ts: Column) -> Column:
    return F.pmod(F.unix_micros(ts), F.lit(MICROS_PER_DAY)) / 1e6 / 86400.0


def julian_date(ts: Column) -> Column:
    return julian_day_start(ts) + day_fraction(ts)


def gmst_degrees(jd: Column) -> Column:
    """Greenwich mean sidereal angle in [0, 360)."""
    days = jd - J2000_JD
    t = days / 36525.0
    # sums in the published order: the angle is millions of degrees before the wrap
    angle = 280.46061837 + 360.98564736629 * days + 0.000387933 * t * t - t * t * t / 38710000.0
    return F.pmod(angle, F.lit(360.0))


def radians(deg: Column) -> Column:
    return deg * (pi / 180.0)


def wrap_longitude(deg: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(deg + 180.0, F.lit(360.0)) - 180.0


def axes(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def with_geodetic(states: DataFrame, at: str, x: str, y: str, z: str) -> DataFrame:
    """Append ``latitude_deg``, ``longitude_deg``, ``altitude_km`` for TEME axes.

    A fixed number of latitude passes, iterated on the tangent of the latitude: in
    that form a pass reads its input once, so the whole is one expression of linear
    size, without trigonometry per pass, and filters on it push down cheaply. The
    distance from the axis does not change under the sidereal rotation, which
    therefore only shifts the longitude.
    """
    distance = f"hypot({x}, {y})"

    def across(tangent: str) -> str:
        """Distance of the ellipsoid point from the axis."""
        return f"({EARTH_RADIUS_KM}D / sqrt(1D + {1.0 - ECC_SQUARED}D * pow({tangent}, 2D)))"

    entering = tangent = f"try_divide({z}, {distance} * {1.0 - ECC_SQUARED}D)"
    for _ in range(GEODETIC_PASSES):
        entering = tangent
        tangent = f"try_divide({z}, {distance} - {ECC_SQUARED}D * {across(tangent)})"
    inertial = F.expr(f"degrees(atan2({y}, {x}))")
    # the tangent entering the last pass is used twice: its own projection
    staged = states.withColumns({"_jd": julian_date(F.col(at)), "_t": F.expr(entering)})
    return staged.withColumns(
        {
            "latitude_deg": F.expr(f"degrees(atan({tangent}))"),
            "longitude_deg": wrap_longitude(inertial - gmst_degrees(F.col("_jd"))),
            "altitude_km": F.expr(f"sqrt(1D + pow(_t, 2D)) * ({distance} - {across('_t')})"),
        }
    ).drop("_jd", "_t")


def with_ecef(df: DataFrame, latitude: str, longitude: str, altitude_km: str, prefix: str) -> DataFrame:
    """Append earth-fixed ``{prefix}x/y/z`` and the sines and cosines behind them."""
    p = prefix
    df = df.withColumns(
        {
            f"{p}sin_lat": F.expr(f"sin(radians({latitude}))"),
            f"{p}cos_lat": F.expr(f"cos(radians({latitude}))"),
            f"{p}sin_lon": F.expr(f"sin(radians({longitude}))"),
            f"{p}cos_lon": F.expr(f"cos(radians({longitude}))"),
        }
    )
    vertical = f"{EARTH_RADIUS_KM}D / sqrt(1D - {ECC_SQUARED}D * {p}sin_lat * {p}sin_lat)"
    df = df.withColumn(f"{p}n", F.expr(vertical))
    return df.withColumns(
        {
            f"{p}x": F.expr(f"({p}n + {altitude_km}) * {p}cos_lat * {p}cos_lon"),
            f"{p}y": F.expr(f"({p}n + {altitude_km}) * {p}cos_lat * {p}sin_lon"),
            f"{p}z": F.expr(f"({p}n * {1.0 - ECC_SQUARED}D + {altitude_km}) * {p}sin_lat"),
        }
    ).drop(f"{p}n")


def with_elevation(df: DataFrame, satellite: str, station: str) -> DataFrame:
    """Append ``elevation_deg`` of the satellite above the station's horizon."""
    s, g = satellite, station
    df = df.withColumns({f"_d{a}": F.expr(f"{s}{a} - {g}{a}") for a in ("x", "y", "z")})
    # along the station's meridian plane, outward from the axis
    df = df.withColumn("_out", F.expr(f"{g}cos_lon * _dx + {g}sin_lon * _dy"))
    df = df.withColumns(
        {
            "_east": F.expr(f"{g}cos_lon * _dy - {g}sin_lon * _dx"),
            "_north": F.expr(f"{g}cos_lat * _dz - {g}sin_lat * _out"),
            "_up": F.expr(f"{g}cos_lat * _out + {g}sin_lat * _dz"),
        }
    )
    return df.withColumn("elevation_deg", F.expr("degrees(atan2(_up, hypot(_east, _north)))")).drop(
        "_dx", "_dy", "_dz", "_out", "_east", "_north", "_up"
    )
