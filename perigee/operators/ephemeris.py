"""Orbit elements from catalog rows and their states over instants."""

from __future__ import annotations

from math import pi

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from perigee import fixed_values as fixed
from perigee.functions import deep_space, frames, parsing, sgp4
from perigee.operators.joins import computed_once

# the propagation code travels with the job: executors need only numpy and pyarrow
for _module in (sgp4, deep_space):
    cloudpickle.register_pickle_by_value(_module)

# element -> field of the raw record, None where the catalog column is used
REQUIRED_ELEMENTS = {
    "mean_motion": None,
    "inclination": None,
    "eccentricity": None,
    "ra_of_asc_node": "RA_OF_ASC_NODE",
    "arg_of_pericenter": "ARG_OF_PERICENTER",
    "mean_anomaly": "MEAN_ANOMALY",
}
OPTIONAL_ELEMENTS = {
    "bstar": "BSTAR",
    "mean_motion_dot": "MEAN_MOTION_DOT",
    "mean_motion_ddot": "MEAN_MOTION_DDOT",
}
MINUTES_PER_DAY = 1440.0


def with_elements(catalog: DataFrame) -> DataFrame:
    """Append ``el_*`` elements in source units and ``missing_elements`` (ordered).

    One parse of the raw record per satellite. Optional elements default to zero.
    """
    fields = {**{e: f for e, f in REQUIRED_ELEMENTS.items() if f}, **OPTIONAL_ELEMENTS}
    df = catalog.withColumn("_record", F.try_parse_json("raw_record_json"))
    df = df.withColumns({f"_{e}": parsing.json_field(F.col("_record"), f) for e, f in fields.items()})
    df = df.withColumns({f"_{e}": parsing.plain_double_or_null(F.col(f"_{e}")) for e in fields})

    def value(element: str) -> Column:
        parsed = F.col(f"_{element}")
        if element in OPTIONAL_ELEMENTS:
            return F.coalesce(parsing.finite_or_null(parsed), F.lit(0.0))
        return parsing.finite_or_null(parsed) if element in fields else F.col(element)

    elements = {f"el_{e}": value(e) for e in [*REQUIRED_ELEMENTS, *OPTIONAL_ELEMENTS]}
    df = computed_once(df, **elements).drop("_record", *[f"_{e}" for e in fields])
    missing = F.array(*[F.when(F.col(f"el_{e}").isNull(), F.lit(e)) for e in REQUIRED_ELEMENTS])
    return df.withColumn("missing_elements", F.array_compact(missing))


def ready(elements: DataFrame) -> DataFrame:
    """Rows that can be propagated: an epoch and all required elements."""
    return elements.where(F.col("epoch").isNotNull() & (F.size("missing_elements") == 0)).drop("missing_elements")


def not_ready(elements: DataFrame) -> DataFrame:
    reason = F.when(F.col("epoch").isNull(), "missing_epoch").otherwise("missing_elements")
    return elements.where(F.col("epoch").isNull() | (F.size("missing_elements") > 0)).withColumn("reason", reason)


def in_propagation_units(elements: DataFrame) -> DataFrame:
    """Degrees to radians, revolutions per day to radians per minute and derivatives."""
    turn = 2 * pi
    columns = {
        f"el_{e}": frames.radians(F.col(f"el_{e}"))
        for e in ("inclination", "ra_of_asc_node", "arg_of_pericenter", "mean_anomaly")
    }
    columns["el_mean_motion"] = F.col("el_mean_motion") * turn / MINUTES_PER_DAY
    columns["el_mean_motion_dot"] = F.col("el_mean_motion_dot") * turn / MINUTES_PER_DAY**2
    columns["el_mean_motion_ddot"] = F.col("el_mean_motion_ddot") * turn / MINUTES_PER_DAY**3
    return elements.withColumns(columns)


# what a state row says about its satellite; wider catalog columns join back by id
LABELS = ["norad_cat_id", "object_name", "epoch", "freshness_status", "epoch_age_hours"]


def prepare(catalog: DataFrame) -> DataFrame:
    """Satellites ready to fan out over instants, one row each.

    Only labels and elements: every column here is repeated per instant and crosses
    the Arrow boundary, where nothing can be pruned.
    """
    elements = in_propagation_units(ready(with_elements(catalog)))
    epoch_days = frames.julian_date(F.col("epoch")) - F.lit(2433281.5)
    return elements.select(
        *LABELS,
        *[f"el_{e}" for e in sgp4.ELEMENTS if e != "epoch_days"],
        epoch_days.alias("el_epoch_days"),
        (F.floor(epoch_days) + F.lit(2433281.5)).alias("epoch_jd"),
        (epoch_days - F.floor(epoch_days)).alias("epoch_fraction"),
    )


def with_states(prepared: DataFrame) -> DataFrame:
    """Append the TEME state, the approximate geodetic position and provenance.

    ``prepared`` is one row per satellite and ``requested_at``. Failures of single
    instants show in ``status`` and leave the position NULL. One Arrow round trip;
    everything around it is native.
    """
    at = F.col("requested_at")
    minutes = (
        (frames.julian_day_start(at) - F.col("epoch_jd")) * F.lit(MINUTES_PER_DAY)
        + (frames.day_fraction(at) - F.col("epoch_fraction")) * F.lit(MINUTES_PER_DAY)
    )
    asked = prepared.withColumn("minutes", minutes).drop("epoch_jd", "epoch_fraction")
    passed = [f for f in asked.schema.fields if not f.name.startswith("el_") and f.name != "minutes"]
    schema = T.StructType(
        [
            *passed,
            *[T.StructField(name, T.DoubleType()) for name in sgp4.AXES],
            T.StructField("status", T.StringType()),
        ]
    )
    moved = asked.mapInArrow(sgp4.state_batches, schema)
    return frames.with_geodetic(moved, "requested_at", "x_km", "y_km", "z_km").withColumns(
        {
            "time_delta_minutes_from_epoch": (F.unix_micros(at) - F.unix_micros("epoch")) / F.lit(6e7),
            "propagator": F.lit(fixed.PROPAGATOR),
            "coordinate_frame": F.lit(fixed.COORDINATE_FRAME),
            "is_approximate": F.lit(True),
        }
    ).withColumnRenamed("epoch", "source_epoch")


def nested(states: DataFrame) -> DataFrame:
    """The flat axes as nested vectors, as the response edge shows them."""
    return states.withColumns(
        {
            "position_km": frames.axes(F.col("x_km"), F.col("y_km"), F.col("z_km")),
            "velocity_km_s": frames.axes(F.col("vx_km_s"), F.col("vy_km_s"), F.col("vz_km_s")),
            "approximate_geodetic": F.struct("latitude_deg", "longitude_deg", "altitude_km"),
        }
    ).drop(
        "x_km", "y_km", "z_km", "vx_km_s", "vy_km_s", "vz_km_s", "latitude_deg", "longitude_deg", "altitude_km"
    )
