"""The registered queries: every operator over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from perigee import bindings
from perigee.functions import frames
from perigee.operators import alerts, catalog, checks, codec, ephemeris, history, layers, metrics, states, timegrid, visibility
from perigee.operators.joins import shuffled
from perigee.plans import operations, tracking
from perigee.plans.layered import LayerStore
from perigee.session import configure
from perigee.sources import arrays, payloads, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(fn(configure(spark), sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def comparable(df: DataFrame) -> DataFrame:
    """Instants as zone-less UTC timestamps, the form the test tables use."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType == T.TimestampType() else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Rounded columns; zero has no sign."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def ingested_at():
    return F.lit(bindings.INGESTED_AT)


# --- layers -----------------------------------------------------------------
def _bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = bindings.raw_orbit_records(spark, sf_dir)
    return layers.build_bronze(records, ingested_at(), keep=["event_id"])


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.build_silver(_bronze(spark, sf_dir), tie_break=[F.col("event_id")])


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.build_gold(_silver(spark, sf_dir))


AGES = ("avg_epoch_age_hours", "min_epoch_age_hours", "max_epoch_age_hours")


@query
def bronze_orbit_records(spark, sf_dir):
    return _bronze(spark, sf_dir).drop("raw_record_json")


@query
def bronze_rejects(spark, sf_dir):
    records = payloads.explode_payloads(bindings.raw_payloads(spark, sf_dir))
    return layers.build_rejects(records).select("event_id", "record_text", "reject_reason")


@query
def landed_array_items(spark, sf_dir):
    """Items of landed JSON arrays with their places, cut by byte ranges."""
    folder = tables.scratch_folder(spark)
    bindings.landed_array_files(spark, sf_dir, folder)
    items = arrays.read_record_arrays(spark, f"{folder}/file=*")
    field = lambda name: F.get_json_object("record_text", f"$.{name}")
    return items.select(
        field("EVENT_ID").cast("bigint").alias("event_id"),
        "record_position",
        field("NORAD_CAT_ID").alias("norad_cat_id"),
        field("EPOCH").alias("epoch_raw"),
        field("MEAN_MOTION").alias("mean_motion_raw"),
        "reject_reason",
    )


@query
def canonical_records(spark, sf_dir):
    return codec.canonical_records(bindings.raw_orbit_records(spark, sf_dir), ["event_id", "copy"])


@query
def stored_row_round_trip(spark, sf_dir):
    return codec.round_trips(_catalog(spark, sf_dir), ["event_id", "copy"])


@query
def silver_orbit_snapshots(spark, sf_dir):
    return rounded(_silver(spark, sf_dir).drop("raw_record_json"), 6, "epoch_age_hours")


@query
def gold_freshness_metrics(spark, sf_dir):
    return layers.ordered_gold(rounded(_gold(spark, sf_dir), 6, *AGES))


@query
def kpi_freshness_by_date(spark, sf_dir):
    return metrics.freshness_by_date(_gold(spark, sf_dir))


@query
def kpi_quality_by_date(spark, sf_dir):
    return metrics.quality_by_date(_gold(spark, sf_dir))


@query
def kpi_freshness_pivot(spark, sf_dir):
    return metrics.freshness_pivot(_gold(spark, sf_dir))


@query
def gold_incremental(spark, sf_dir):
    """Gold of three batches that share copies, landed one after the other, the second
    one twice: once with the records of the third."""
    records = bindings.raw_orbit_records(spark, sf_dir)
    store = LayerStore(spark, tables.scratch_folder(spark))
    part = lambda k: records.where(F.col("event_id") % 3 == k)
    for batch, rows in (("first", part(0)), ("second", part(2)), ("third", part(2)), ("second", part(1))):
        store.land(rows, bindings.INGESTED_AT, batch)
    return layers.ordered_gold(rounded(store.gold(), 6, *AGES))


@query
def gold_load_contract(spark, sf_dir):
    return rounded(metrics.gold_load_rows(_gold(spark, sf_dir)).drop("loaded_at"), 6, *AGES)


@query
def gold_contract_check(spark, sf_dir):
    return metrics.contract_violations(_gold(spark, sf_dir))


# --- catalog and history ----------------------------------------------------
def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = bindings.raw_orbit_records(spark, sf_dir)
    return catalog.normalize(records, ingested_at(), keep=["event_id", "copy"])


@query
def catalog_normalized(spark, sf_dir):
    df = _catalog(spark, sf_dir).drop("raw_record_json")
    return rounded(df.select("*", "source.name", "source.url", "source.type").drop("source"), 6, "epoch_age_hours")


@query
def catalog_latest(spark, sf_dir):
    latest = history.latest_catalog(
        bindings.orbit_snapshots(spark, sf_dir), bindings.ingestion_runs(spark, sf_dir)
    )
    return latest.drop("raw_record_json").orderBy("object_name", "norad_cat_id", "snapshot_id")


@query
def ingestion_run_history(spark, sf_dir):
    return history.recent_runs(bindings.ingestion_runs(spark, sf_dir), 20)


@query
def ingest_due(spark, sf_dir):
    due = history.ingest_due(bindings.ingestion_runs(spark, sf_dir), ingested_at(), 2.0)
    return rounded(due, 6, "age_hours")


@query
def catalog_lookup(spark, sf_dir):
    order = [F.col("ingested_at"), F.col("snapshot_id")]
    return catalog.bounded(catalog.last_per_id(bindings.orbit_snapshots(spark, sf_dir), order))


@query
def catalog_search(spark, sf_dir):
    order = [F.col("object_name"), F.col("norad_cat_id"), F.col("snapshot_id")]
    found = catalog.search(bindings.orbit_snapshots(spark, sf_dir), "  PurCHase 1", order)
    return found.drop("raw_record_json")


@query
def catalog_totals(spark, sf_dir):
    return catalog.totals(bindings.orbit_snapshots(spark, sf_dir))


@query
def satellite_seen(spark, sf_dir):
    good = history.successful(bindings.ingestion_runs(spark, sf_dir)).select("run_id")
    snapshots = bindings.orbit_snapshots(spark, sf_dir).join(good, "run_id", "left_semi")
    return history.satellites_seen(snapshots, [F.col("ingested_at"), F.col("snapshot_id")])


@query
def satellite_upsert(spark, sf_dir):
    """The satellite table before the latest run, brought up to date with that run."""
    runs = history.successful(bindings.ingestion_runs(spark, sf_dir))
    snapshots = bindings.orbit_snapshots(spark, sf_dir)
    latest = F.broadcast(history.latest_successful_run(runs).select("run_id"))
    order = [F.col("ingested_at"), F.col("snapshot_id")]
    earlier = snapshots.join(runs.select("run_id"), "run_id", "left_semi").join(latest, "run_id", "left_anti")
    batch = snapshots.join(latest, "run_id", "left_semi")
    rows = history.sightings(earlier, order).unionByName(history.sightings(batch, order))
    return history.merged_sightings(rows).drop("last_run_id", "bucket")


# --- telemetry alerts -------------------------------------------------------
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.threshold_events(bindings.telemetry(spark, sf_dir), bindings.telemetry_policies(spark))


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.policy_comparison(
        bindings.telemetry(spark, sf_dir), _events(spark, sf_dir), bindings.telemetry_policies(spark)
    )


@query
def telemetry_status(spark, sf_dir):
    return alerts.with_status(bindings.telemetry(spark, sf_dir), bindings.telemetry_policies(spark))


@query
def latest_per_subsystem(spark, sf_dir):
    return alerts.latest_per_subsystem(bindings.telemetry(spark, sf_dir))


@query
def threshold_events(spark, sf_dir):
    return _events(spark, sf_dir)


@query
def threshold_events_sliced(spark, sf_dir):
    """The events of three slices of time, one after the other."""
    root = tables.scratch_folder(spark)
    telemetry = bindings.telemetry(spark, sf_dir)
    policies = bindings.telemetry_policies(spark)
    day = F.dayofmonth("source_event_time")
    slices = [day <= 10, (day > 10) & (day <= 20), day > 20]
    events = [operations.continue_events(telemetry.where(part), policies, root, k + 1) for k, part in enumerate(slices)]
    return events[0].unionByName(events[1]).unionByName(events[2])


@query
def policy_comparison(spark, sf_dir):
    return _comparison(spark, sf_dir)


@query
def runbook_summary(spark, sf_dir):
    return alerts.runbook_summary(_comparison(spark, sf_dir))


# --- grids, frames and visibility -------------------------------------------
@query
def time_grid(spark, sf_dir):
    satellites = bindings.circular_orbits(spark, sf_dir).select("norad_cat_id")
    return timegrid.with_grid(satellites, bindings.GRID_START, bindings.GRID_END, bindings.GRID_STEP_SECONDS)


@query
def track_grid(spark, sf_dir):
    satellites = bindings.circular_orbits(spark, sf_dir).select("norad_cat_id")
    return timegrid.with_track_grid(satellites, bindings.GRID_START, bindings.GRID_END, 7 * 60)


@query
def gmst(spark, sf_dir):
    df = bindings.events(spark, sf_dir).select("event_id", "ts")
    jd = df.withColumn("julian_date", frames.julian_date(F.col("ts")))
    return rounded(jd.withColumn("gmst_deg", frames.gmst_degrees(F.col("julian_date"))), 6, "gmst_deg")


@query
def ephemeris_geodetic(spark, sf_dir):
    df = bindings.circular_geodetic(spark, sf_dir).drop("nation_key")
    return rounded(df, 5, "x_km", "y_km", "z_km", "latitude_deg", "longitude_deg", "altitude_km")


@query
def station_elevation(spark, sf_dir):
    elevated = visibility.elevations(
        bindings.circular_geodetic(spark, sf_dir).select(
            "norad_cat_id", "sequence", "requested_at", "latitude_deg", "longitude_deg", "altitude_km"
        ),
        bindings.station_assignments(spark, sf_dir),
        bindings.stations(spark, sf_dir),
    )
    return rounded(
        elevated.select("norad_cat_id", "station", "sequence", "requested_at", "elevation_deg"), 5, "elevation_deg"
    )


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.contact_windows(
        bindings.circular_geodetic(spark, sf_dir), bindings.stations(spark, sf_dir), 10.0
    )


@query
def contact_windows(spark, sf_dir):
    return rounded(_windows(spark, sf_dir), 5, "max_elevation_deg")


@query
def nested_windows(spark, sf_dir):
    """Contact windows in pages of half an hour: their sizes and both ends."""
    pages = visibility.page_windows(_windows(spark, sf_dir), bindings.GRID_START, 1800)
    ends = [F.element_at("windows", place).getField("start") for place in (1, -1)]
    return pages.select(
        "norad_cat_id",
        "station",
        "page",
        "count",
        F.size("windows").cast("bigint").alias("list_size"),
        ends[0].alias("first_start"),
        ends[1].alias("last_start"),
        F.element_at("windows", -1).getField("end").alias("last_end"),
    )


@query
def station_quarantine(spark, sf_dir):
    """Stations in range and those put aside, with the counts they come to."""
    landed = bindings.landed_stations(spark, sf_dir)
    kept, rejected = checks.quarantined(landed)
    rows = kept.withColumn("status", F.lit(checks.OK)).unionByName(rejected)
    counts = checks.reconciled(landed, kept, rejected)
    return rows.select("station", "status").crossJoin(F.broadcast(counts))


@query
def contact_summary(spark, sf_dir):
    satellites = bindings.circular_orbits(spark, sf_dir).select("norad_cat_id", "object_name")
    return rounded(visibility.contact_summary(satellites, _windows(spark, sf_dir)), 5, "max_elevation_deg")


@query
def instant_positions(spark, sf_dir):
    """Every request with its position between given states, or why there is none, and
    whether it lies within a metre of the orbit's own form."""
    found = states.positions_at(bindings.instant_requests(spark, sf_dir), bindings.moving_states(spark, sf_dir))
    orbits = bindings.circular_orbits(spark, sf_dir).withColumnRenamed("norad_cat_id", "_id")
    paired = found.select("request_id", "norad_cat_id", "seconds", *[F.col(a).alias(f"_{a}") for a in states.AXES]).join(
        shuffled(orbits), F.col("norad_cat_id") == F.col("_id")
    )
    true = bindings.circular_motion(paired, F.col("seconds"))
    off = F.sqrt(sum((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in states.AXES))
    errors = true.select("request_id", (off < 0.001).alias("within_a_metre"))
    out = found.join(shuffled(errors), "request_id", "left").drop("seconds")
    return rounded(rounded(out, 3, *states.AXES, "altitude_km"), 4, "latitude_deg", "longitude_deg")


# --- elements and propagation -----------------------------------------------
def _element_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = bindings.element_records(spark, sf_dir)
    return catalog.good(catalog.normalize(records, ingested_at()))


ELEMENTS = [*ephemeris.REQUIRED_ELEMENTS, *ephemeris.OPTIONAL_ELEMENTS]


@query
def element_readiness(spark, sf_dir):
    elements = ephemeris.in_propagation_units(ephemeris.with_elements(_element_catalog(spark, sf_dir)))
    missing = F.concat_ws(", ", "missing_elements").alias("missing_elements")
    return elements.select(
        "norad_cat_id",
        "epoch",
        missing,
        (F.col("epoch").isNotNull() & (F.size("missing_elements") == 0)).alias("ready"),
        *[F.round(f"el_{e}", 9).alias(e) for e in ELEMENTS],
    )


def _sgp4_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = timegrid.with_grid(
        ephemeris.prepare(_element_catalog(spark, sf_dir)),
        bindings.GRID_START,
        bindings.GRID_END,
        bindings.GRID_STEP_SECONDS,
    )
    return ephemeris.with_states(grid)


STATE_COLUMNS = [
    "x_km", "y_km", "z_km", "vx_km_s", "vy_km_s", "vz_km_s", "latitude_deg", "longitude_deg", "altitude_km",
]


@query
def sgp4_ephemeris(spark, sf_dir):
    states = _sgp4_states(spark, sf_dir).select(
        "norad_cat_id",
        "object_name",
        "source_epoch",
        "requested_at",
        "sequence",
        "time_delta_minutes_from_epoch",
        *STATE_COLUMNS,
        "freshness_status",
        "status",
        "propagator",
        "coordinate_frame",
        "is_approximate",
    )
    return rounded(states, 4, *STATE_COLUMNS)


@query
def requested_positions(spark, sf_dir):
    """Positions up to thirty days from epoch, for the requests that have one."""
    asked = tracking.requested_positions(
        _element_catalog(spark, sf_dir), bindings.position_requests(spark, sf_dir)
    )
    states = asked.select(
        "norad_cat_id", "request_id", "requested_at", "status", "time_delta_minutes_from_epoch", *STATE_COLUMNS
    )
    return rounded(states, 4, *STATE_COLUMNS)


@query
def answered_requests(spark, sf_dir):
    """Every request with its position, or with the reason that it has none."""
    asked = tracking.answered_requests(
        _element_catalog(spark, sf_dir), bindings.position_requests(spark, sf_dir)
    )
    states = asked.select(
        "norad_cat_id", "request_id", "requested_at", "status", "time_delta_minutes_from_epoch", *STATE_COLUMNS
    )
    return rounded(states, 4, *STATE_COLUMNS)


@query
def sgp4_contact_windows(spark, sf_dir):
    states = _sgp4_states(spark, sf_dir).where(F.col("status") == "ok")
    windows = visibility.contact_windows(states, bindings.stations(spark, sf_dir), 10.0)
    return rounded(windows, 4, "max_elevation_deg")
