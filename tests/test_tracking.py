from __future__ import annotations

import json
import math
import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee import schemas
from perigee.functions import frames, sgp4
from perigee.operators import catalog, checks, ephemeris, params, timegrid, visibility
from perigee.plans import tracking
from tests.samples import INGESTED, ISS_ELEMENTS, OLD, STATIONS, record_rows, utc


def iss_catalog(spark, **changes):
    return catalog.good(catalog.normalize(record_rows(spark, {**ISS_ELEMENTS, **changes}), F.lit(INGESTED)))


def stations(spark, rows=STATIONS):
    return spark.createDataFrame(rows, schemas.STATION)


# --- grids ------------------------------------------------------------------
def grid_times(spark, fn, seconds, step):
    one = spark.createDataFrame([(1,)], "norad_cat_id long")
    start = utc(2026, 5, 28, 3)
    rows = fn(one, start, start + timedelta(seconds=seconds), step).orderBy("sequence").collect()
    assert [r["sequence"] for r in rows] == list(range(len(rows)))
    return [int((r["requested_at"].replace(tzinfo=start.tzinfo) - start).total_seconds()) for r in rows]


@pytest.mark.parametrize(("seconds", "step"), [(600, 300), (605, 300), (100, 300), (300, 300), (3601, 60)])
def test_grids(spark, seconds, step):
    plain = list(range(0, seconds + 1, step))
    pinned = plain if plain[-1] == seconds else [*plain, seconds]
    assert grid_times(spark, timegrid.with_grid, seconds, step) == plain
    assert grid_times(spark, timegrid.with_track_grid, seconds, step) == pinned


def test_grid_longer_than_a_block(spark):
    assert len(grid_times(spark, timegrid.with_grid, 3 * timegrid.BLOCK, 1)) == 3 * timegrid.BLOCK + 1


def test_parameter_domains(spark):
    one = spark.createDataFrame([(1,)], "norad_cat_id long")
    start = utc(2026, 5, 28)
    with pytest.raises(ValueError, match="not later than its start"):
        timegrid.with_grid(one, start, start, 60)
    with pytest.raises(ValueError, match="above zero"):
        timegrid.with_grid(one, start, start + timedelta(hours=1), 0)
    with pytest.raises(ValueError, match="over the 360 allowed"):
        timegrid.with_track_grid(one, start, start + timedelta(hours=48), 10)
    with pytest.raises(ValueError, match="step_seconds"):
        tracking.orbit_tracks(iss_catalog(spark), start, start + timedelta(hours=1), 5)
    with pytest.raises(ValueError, match="latitude"):
        params.require_station(91, 0, 0)
    with pytest.raises(ValueError, match="unknown scenario"):
        params.require_known("scenario", "x", ["nominal"])
    with pytest.raises(ValueError, match="duration"):
        params.require_telemetry_range(10, 1200)
    with pytest.raises(ValueError, match="ISO-8601"):
        params.parse_instant("soon")
    assert params.parse_instant("2026-05-28T02:00:00Z") == params.parse_instant("2026-05-28T04:00:00+02:00")


# --- propagation ------------------------------------------------------------
# published verification cases: elements (epoch days from 1949-12-31) and, per
# minute from epoch, position in km and velocity in km/s
DAY_2000, DAY_1980, DAY_2006 = 18262.0, 10957.0, 20454.0
CASES = {
    "near earth, 00005": (
        (10.82419157, 34.2682, 0.1859667, 348.7242, 331.7664, 19.3264, 2.8098e-5, DAY_2000 + 179.78495062),
        {
            0.0: (7022.46529266, -1400.08296755, 0.03995155, 1.893841015, 6.405893759, 4.534807250),
            360.0: (-7154.03120202, -3783.17682504, -3536.19412294, 4.741887409, -4.151817765, -2.093935425),
            720.0: (-7134.59340119, 6531.68641334, 3260.27186483, -4.113793027, -2.911922039, -2.557327851),
            1080.0: (5568.53901181, 4492.06992591, 3863.87641983, -4.209106476, 5.159719888, 2.744852980),
            1440.0: (-938.55923943, -6268.18748831, -4294.02924751, 7.536105209, -0.427127707, 0.989878080),
        },
    ),
    "deep space, 11801": (
        (2.28537848, 46.7916, 0.7318036, 230.4354, 47.4722, 10.4117, 0.014311, DAY_1980 + 230.29629788),
        {
            0.0: (7473.37102491, 428.94748312, 5828.74846783, 5.107155391, 6.444680305, -0.186133297),
            360.0: (-3305.22148694, 32410.84323331, -24697.16974954, -1.301137319, -1.151315600, -0.283335823),
            720.0: (14271.29083858, 24110.44309009, -4725.76320143, -0.320504528, 2.679841539, -2.084054355),
            1080.0: (-9990.05800009, 22717.34212448, -23616.88515553, -1.016674392, -2.290267981, 0.728923337),
            1440.0: (9787.87836256, 33753.32249667, -15030.79874625, -1.094251553, 0.923589906, -1.522311008),
        },
    ),
    "half-day resonance, 08195": (
        (2.00491383, 64.1586, 0.6877146, 279.0717, 264.7651, 20.2257, 0.00011873, DAY_2006 + 176.33215444),
        {0.0: (2349.89483350, -14785.93811562, 0.02119378, 2.721488096, -3.256811655, 4.498416672)},
    ),
    "synchronous, 28626": (
        (1.00270176, 0.0019, 0.0000335, 286.9433, 13.7918, 55.6504, 1.0e-4, DAY_2006 + 176.46683397),
        {
            0.0: (42080.71852213, -2646.86387436, 0.81851294, 0.193105177, 3.068688251, 0.000438449),
            120.0: (37740.00085593, 18802.76872802, 3.45512584, -1.371035206, 2.752105932, 0.000336883),
        },
    ),
}


def radian_elements(n, incl, ecc, node, argp, m, bstar, epoch):
    deg = math.radians
    return np.array([n * 2 * math.pi / 1440, deg(incl), ecc, deg(node), deg(argp), deg(m), bstar, epoch])


@pytest.mark.parametrize("case", CASES)
def test_published_vectors(case):
    elements, vectors = CASES[case]
    t = np.array(list(vectors))
    el = np.repeat(radian_elements(*elements)[:, None], len(t), axis=1)
    status, axes = sgp4.propagate(sgp4.orbit_constants(el), t)
    assert not status.any()
    expected = np.array(list(vectors.values())).T
    assert np.abs(np.array(axes[:3]) - expected[:3]).max() < 5e-4
    assert np.abs(np.array(axes[3:]) - expected[3:]).max() < 5e-7


def test_statuses():
    el = radian_elements(15.0, 57.0, 0.001, 57.0, 57.0, 57.0, 0.01, DAY_2006)
    columns = np.repeat(el[:, None], 3, axis=1)
    columns[0, 1] = -1.0
    columns[2, 2] = 1.2
    with np.errstate(all="ignore"):
        status, _ = sgp4.propagate(sgp4.orbit_constants(columns), np.array([5e5, 0.0, 0.0]))
    names = [str(sgp4.STATUSES[s]) for s in status]
    assert names[0] != sgp4.OK
    assert names[1:] == [sgp4.BAD_MEAN_MOTION, sgp4.BAD_ECCENTRICITY]


@pytest.mark.parametrize("case", ["half-day resonance, 08195", "synchronous, 28626"])
def test_resonance_is_smooth_across_its_steps(case):
    """Velocity equals the slope of position on both sides of a 720-minute step."""
    el = np.repeat(radian_elements(*CASES[case][0])[:, None], 40, axis=1)
    t = np.repeat([-1440.0, -720.0, 720.0, 2160.0], 10) + np.tile(np.linspace(-0.09, 0.09, 10), 4)
    _, axes = sgp4.propagate(sgp4.orbit_constants(el), t)
    position, velocity = np.array(axes[:3]).reshape(3, 4, 10), np.array(axes[3:]).reshape(3, 4, 10)
    slope = np.diff(position, axis=2) / (0.02 * 60)
    middle = (velocity[..., 1:] + velocity[..., :-1]) / 2
    assert np.abs(slope - middle).max() < 2e-3


def test_position_metadata(spark):
    row = tracking.positions(iss_catalog(spark), [utc(2026, 5, 28, 3)]).collect()[0]
    assert row["status"] == "ok" and row["propagator"] == "SGP4" and row["coordinate_frame"] == "TEME"
    assert abs(row["latitude_deg"]) <= 52 and -180 <= row["longitude_deg"] < 180
    assert 350 < row["altitude_km"] < 480
    assert row["time_delta_minutes_from_epoch"] == pytest.approx(9.914609, abs=1e-6)


def test_requested_positions_follow_their_requests(spark):
    requests = spark.createDataFrame(
        [(25544, utc(2026, 5, 28, 3)), (25544, utc(2026, 5, 28, 4)), (1, utc(2026, 5, 28, 3))],
        "norad_cat_id long, requested_at timestamp",
    )
    rows = tracking.requested_positions(iss_catalog(spark), requests).collect()
    assert len(rows) == 2
    direct = tracking.positions(iss_catalog(spark), [utc(2026, 5, 28, 3), utc(2026, 5, 28, 4)]).collect()
    assert {r["x_km"] for r in rows} == {r["x_km"] for r in direct}


def test_missing_elements_are_listed_and_left_out(spark):
    elements = ephemeris.with_elements(iss_catalog(spark, ARG_OF_PERICENTER=None, MEAN_MOTION=""))
    row = ephemeris.not_ready(elements).collect()[0]
    assert row["missing_elements"] == ["mean_motion", "arg_of_pericenter"]
    assert ephemeris.ready(elements).count() == 0
    odd = ephemeris.with_elements(iss_catalog(spark, RA_OF_ASC_NODE="nan", BSTAR="1e400")).collect()[0]
    assert odd["missing_elements"] == ["ra_of_asc_node"] and odd["el_bstar"] == 0.0


def test_track_points_and_nesting(spark):
    start = utc(2026, 5, 28, 3)
    points = tracking.orbit_tracks(iss_catalog(spark), start, start + timedelta(minutes=10), 300)
    nested = tracking.nest_tracks(points).collect()
    assert len(nested) == 1 and nested[0]["sample_count"] == 3
    assert [p["sequence"] for p in nested[0]["points"]] == [0, 1, 2]
    assert [p["requested_at"].minute for p in nested[0]["points"]] == [0, 5, 10]
    assert nested[0]["points"][0]["position_km"]["x"] is not None


# --- visibility -------------------------------------------------------------
def test_published_contact_window(spark):
    start = utc(2026, 5, 28, 2, 45)
    windows = tracking.catalog_contact_windows(
        iss_catalog(spark), stations(spark, STATIONS[:1]), start, start + timedelta(minutes=35), 60, 10.0
    ).collect()
    assert len(windows) == 1
    w = windows[0]
    assert (w["start"].minute, w["end"].minute, w["peak_at"].minute) == (57, 3, 0)
    assert w["duration_seconds"] == 360.0
    assert w["max_elevation_deg"] == pytest.approx(89.97014741275501, abs=1e-6)
    nested = visibility.nest_windows(
        tracking.catalog_contact_windows(
            iss_catalog(spark), stations(spark), start, start + timedelta(minutes=35), 30, 10.0
        )
    ).collect()
    assert all(n["count"] == len(n["windows"]) for n in nested)


def test_satellite_never_seen_keeps_its_row(spark):
    cat = iss_catalog(spark)
    start = utc(2026, 5, 28, 2, 45)
    windows = tracking.catalog_contact_windows(
        cat, stations(spark, [("north", 80.0, 0.0, 0.0)]), start, start + timedelta(minutes=35), 60, 80.0
    )
    rows = visibility.contact_summary(cat.select("norad_cat_id"), windows).collect()
    assert [(r["norad_cat_id"], r["window_count"], r["total_seconds"]) for r in rows] == [(25544, 0, 0.0)]


def random_states(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        altitude = rng.choice([rng.uniform(150, 2000), rng.uniform(2000, 30000), rng.uniform(30000, 60000)])
        latitude = rng.choice([rng.uniform(-90, 90), 89.9, -89.99, 0.0])
        rows.append((i, 0, latitude, rng.choice([rng.uniform(-180, 180), 179.999, -180.0]), altitude))
    df = spark.createDataFrame(
        rows, "norad_cat_id long, sequence int, latitude_deg double, longitude_deg double, altitude_km double"
    )
    return df.withColumn("requested_at", F.lit(INGESTED))


@pytest.mark.parametrize("min_elevation", [0.0, 10.0, 60.0])
def test_cell_join_finds_every_visible_pair(spark, min_elevation):
    rng = random.Random(5)
    sites = [(f"s{i}", rng.uniform(-90, 90), rng.uniform(-180, 180), rng.uniform(-500, 10000)) for i in range(20)]
    sites += [("pole", 90.0, 0.0, 0.0), ("south", -90.0, 10.0, 2800.0), ("line", 0.0, 180.0, 0.0)]
    states, ground = random_states(spark, 11, 600), stations(spark, sites)
    found = visibility.visible_samples(states, ground, min_elevation).select("norad_cat_id", "station").collect()
    pairs = visibility.elevations(
        states,
        states.select("norad_cat_id", F.explode(F.array(*[F.lit(s[0]) for s in sites])).alias("station")),
        ground,
    )
    expected = pairs.where(F.col("elevation_deg") >= min_elevation).select("norad_cat_id", "station").collect()
    assert len(expected) > 100
    assert sorted(found) == sorted(expected)


@pytest.mark.parametrize("segment_steps", [4096, 7, 1])
def test_islands_equal_the_loop(spark, segment_steps, monkeypatch):
    rng = random.Random(3)
    start = utc(2026, 5, 28)
    masks = {s: [rng.random() < 0.7 for _ in range(60)] for s in range(12)}
    rows, expected = [], []
    for sat, mask in masks.items():
        open_run = []
        for i, seen in enumerate([*mask, False]):
            if seen:
                elevation = rng.choice([20.0, 30.0, 40.0])
                rows.append((sat, "s", i, start + timedelta(seconds=60 * i), elevation))
                open_run.append((i, elevation))
            elif open_run:
                peak = max(open_run, key=lambda s: s[1])
                expected.append((sat, open_run[0][0], open_run[-1][0], peak[0], peak[1]))
                open_run = []
    visible = spark.createDataFrame(
        rows, "norad_cat_id long, station string, sequence int, requested_at timestamp, elevation_deg double"
    )
    monkeypatch.setattr(visibility, "visible_samples", lambda *a: visible)
    minute = lambda t: int((t.replace(tzinfo=start.tzinfo) - start).total_seconds() // 60)
    found = [
        (w["norad_cat_id"], minute(w["start"]), minute(w["end"]), minute(w["peak_at"]), w["max_elevation_deg"])
        for w in visibility.contact_windows(None, None, 10.0, segment_steps).collect()
    ]
    assert sorted(found) == sorted(expected)


def test_plan_has_no_pairwise_join(spark):
    states, ground = random_states(spark, 1, 10), stations(spark)
    plan = visibility.contact_windows(states, ground)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_longitude_wrap_and_gmst(spark):
    row = spark.range(1).select(
        frames.wrap_longitude(F.lit(-200.0)).alias("w"),
        frames.wrap_longitude(F.lit(180.0)).alias("edge"),
        frames.gmst_degrees(F.lit(2451545.0)).alias("g"),
    ).collect()[0]
    assert (row["w"], row["edge"]) == (160.0, -180.0)
    assert row["g"] == pytest.approx(280.46061837)


def test_synchronous_satellite_stays_in_place(spark):
    cat = iss_catalog(spark, MEAN_MOTION=1.00270176, INCLINATION=0.05, ECCENTRICITY=0.0001)
    rows = tracking.positions(cat, [utc(2026, 5, 28, 3), utc(2026, 5, 29, 15)]).collect()
    assert {r["status"] for r in rows} == {"ok"}
    assert all(35600 < r["altitude_km"] < 35950 and abs(r["latitude_deg"]) < 0.3 for r in rows)
    assert abs(rows[0]["longitude_deg"] - rows[1]["longitude_deg"]) < 1


def test_noaa_without_elements_is_not_ready(spark):
    rows = catalog.good(catalog.normalize(record_rows(spark, OLD), F.lit(INGESTED)))
    assert json.loads(rows.first()["raw_record_json"])["OBJECT_NAME"] == "KESTREL 4"
    assert ephemeris.not_ready(ephemeris.with_elements(rows)).first()["reason"] == "missing_elements"


def test_copies_of_a_satellite_give_one_track(spark):
    rows = record_rows(spark, ISS_ELEMENTS, {**ISS_ELEMENTS, "OBJECT_NAME": "ZZ"}, ISS_ELEMENTS)
    cat = catalog.good(catalog.normalize(rows, F.lit(INGESTED)))
    out = tracking.positions(cat, [utc(2026, 5, 28, 3)]).collect()
    assert [r["object_name"] for r in out] == ["ZZ"]


def test_table_checks(spark):
    rows = [*STATIONS, ("bad", 95.0, 0.0, 0.0), ("deep", 0.0, 0.0, -900.0), ("none", None, 0.0, 0.0)]
    status = {r["station"]: r["status"] for r in checks.with_station_status(stations(spark, rows)).collect()}
    assert [status[k] for k in ("bad", "deep", "none")] == [
        "latitude_deg_out_of_range", "altitude_m_out_of_range", "latitude_deg_out_of_range",
    ]
    assert all(status[s[0]] == "ok" for s in STATIONS)
    names = spark.createDataFrame([("nominal",), ("odd",), ("odd",), (None,)], "scenario string")
    bad = {r["scenario"]: r["row_count"] for r in checks.unknown_names(names, "scenario", ["nominal"]).collect()}
    assert bad == {"odd": 2, None: 1}


def test_altitude_is_exact_over_the_pole(spark):
    """A state within rounding of the axis: the distance to the polar radius."""
    row = spark.createDataFrame([(4.4e-13, 0.0, 7150.0), (0.0, 3.0, -7000.0)], "x double, y double, z double")
    placed = frames.with_geodetic(row.withColumn("at", F.lit(INGESTED)), "at", "x", "y", "z").collect()
    polar = 6378.137 * (1 - 1 / 298.257223563)
    assert placed[0]["altitude_km"] == pytest.approx(7150.0 - polar, abs=1e-6)
    assert placed[0]["latitude_deg"] == 90.0
    assert placed[1]["altitude_km"] == pytest.approx(7000.0 - polar, abs=1e-2)


def test_nothing_asked_is_lost_without_a_status(spark):
    rows = record_rows(
        spark, ISS_ELEMENTS, {**ISS_ELEMENTS, "NORAD_CAT_ID": 2, "EPOCH": None}, {**ISS_ELEMENTS, "NORAD_CAT_ID": 3, "MEAN_ANOMALY": None}
    )
    # a record without an epoch does not pass as good, but a catalog may hold one
    cat = catalog.normalize(rows, F.lit(INGESTED))
    assert cat.count() == 3
    start = utc(2026, 5, 28, 3)
    asked = [(25544, start), (2, start), (3, start), (3, start), (77, start), (None, start)]
    requests = spark.createDataFrame(asked, "norad_cat_id long, requested_at timestamp")
    out = tracking.answered_requests(cat, requests).collect()
    assert sorted(((r["norad_cat_id"], r["status"], r["x_km"] is None) for r in out), key=str) == sorted(
        [
            (25544, "ok", False),
            (2, "missing_epoch", True),
            (3, "missing_elements", True),
            (3, "missing_elements", True),
            (77, "unknown_id", True),
            (None, "unknown_id", True),
        ],
        key=str,
    )
    states = {r["norad_cat_id"]: r["status"] for r in tracking.positions(cat, [start]).collect()}
    assert states == {25544: "ok", 2: "missing_epoch", 3: "missing_elements"}
    north = stations(spark, [("north", 80.0, 0.0, 0.0)])
    summary = tracking.catalog_contact_summary(cat, north, start, start + timedelta(minutes=10), 60, 80.0).collect()
    assert {r["norad_cat_id"]: (r["status"], r["instants"], r["failed_instants"], r["window_count"]) for r in summary} == {
        25544: ("ok", 11, 0, 0),
        2: ("missing_epoch", 0, 0, 0),
        3: ("missing_elements", 0, 0, 0),
    }
