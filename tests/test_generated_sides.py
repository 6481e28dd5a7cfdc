"""Sides generated from few bytes are never broadcast, however small Spark takes them for."""

from __future__ import annotations

from perigee.operators import states, visibility
from perigee.queries import QUERIES
from tests import test_states

FOLDER = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_given_states_are_not_broadcast(spark):
    given = spark.createDataFrame([test_states.state(1, t) for t in (0, 60)], test_states.COLUMNS)
    requests = given.select("norad_cat_id", "requested_at")
    found = plan(states.positions_at(requests, given))
    assert found.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in found


def test_instant_positions_broadcasts_nothing(spark):
    assert "BroadcastHashJoin" not in plan(QUERIES["instant_positions"](spark, FOLDER))


def test_states_over_assigned_stations_are_not_broadcast(spark):
    place = ("0.0D AS latitude_deg", "0.0D AS longitude_deg")
    seen = spark.range(5).selectExpr("id AS norad_cat_id", *place, "700.0D AS altitude_km")
    passes = spark.range(5).selectExpr("id AS norad_cat_id", "'a' AS station")
    stations = spark.range(1).selectExpr("'a' AS station", *place, "0.0D AS altitude_m")
    elevated = visibility.elevations(seen, passes, stations)
    assert plan(elevated).count("SortMergeJoin") == 1
    assert [round(r["elevation_deg"]) for r in elevated.collect()] == [90] * 5


def test_station_elevation_broadcasts_stations_alone(spark):
    # one row a nation: joined to the satellites by nation, and to their stations by name
    found = plan(QUERIES["station_elevation"](spark, FOLDER))
    assert found.count("BroadcastHashJoin") == 2 and found.count("SortMergeJoin") == 1
