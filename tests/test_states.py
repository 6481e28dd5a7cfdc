"""Positions between given states against a closed form, a loop and odd inputs."""

from __future__ import annotations

import math
from datetime import timedelta

import pytest
from perigee.operators import states
from tests.samples import utc

START = utc(2026, 5, 28)
COLUMNS = "norad_cat_id long, requested_at timestamp, x_km double, y_km double, z_km double, vx_km_s double, vy_km_s double, vz_km_s double, source_epoch timestamp"
RADIUS, RATE = 7000.0, 0.00108


def state(number, seconds):
    u = RATE * seconds
    place = (RADIUS * math.cos(u), RADIUS * math.sin(u), 0.0)
    speed = (-RADIUS * RATE * math.sin(u), RADIUS * RATE * math.cos(u), 0.0)
    return (number, START + timedelta(seconds=seconds), *place, *speed, START - timedelta(hours=2))


def asked(spark, rows, given, **options):
    requests = spark.createDataFrame([(i, START + timedelta(seconds=s), k) for k, (i, s) in enumerate(rows)], "norad_cat_id long, requested_at timestamp, k int")
    frame = spark.createDataFrame(given, COLUMNS)
    return {r["k"]: r for r in states.positions_at(requests, frame, **options).collect()}


def test_instants_between_uneven_states_lie_on_the_orbit(spark):
    times = [0, 13, 60, 61.5, 150, 299]
    rows = [(1, t) for t in (0, 5.25, 13, 40, 60.000001, 61, 149.5, 298.9, 299)]
    found = asked(spark, rows, [state(1, t) for t in times])
    for k, (_, t) in enumerate(rows):
        _, _, x, y, z, *_ = state(1, t)
        r = found[k]
        assert r["status"] == "ok" and math.dist((r["x_km"], r["y_km"], r["z_km"]), (x, y, z)) < 0.02
        assert r["time_delta_minutes_from_epoch"] == pytest.approx(120 + t / 60)
        assert (r["coordinate_frame"], r["is_approximate"], r["altitude_km"] > 500) == ("TEME", True, True)


def test_every_request_is_answered(spark):
    given = [state(1, t) for t in (0, 60, 60, 2000, 2060)] + [state(2, 30)]
    rows = [(1, -1), (1, 30), (1, 1000), (1, 2030), (1, 2061), (9, 0), (None, 0), (2, 30), (2, 31), (1, 30)]
    found = asked(spark, rows, given)
    want = ["outside_states", "ok", "outside_states", "ok", "outside_states", "unknown_id", "unknown_id", "ok", "outside_states", "ok"]
    assert [found[k]["status"] for k in range(len(rows))] == want
    assert all((r["x_km"] is None) == (r["status"] != "ok") for r in found.values())
    wide = asked(spark, rows, given, largest_gap_seconds=3000)
    assert [wide[k]["status"] for k in (0, 2, 4)] == ["outside_states", "ok", "outside_states"]
    assert asked(spark, [], given) == {}
    assert {r["status"] for r in asked(spark, rows, []).values()} == {"unknown_id"}
