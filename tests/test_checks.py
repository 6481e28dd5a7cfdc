"""Rows put aside by domain checks, canonical texts, and pages of windows."""

from __future__ import annotations

import json
from datetime import timedelta

import pytest
from perigee.operators import alerts, catalog, checks, codec, visibility
from perigee.plans.operations import compare_policies
from pyspark.sql import functions as F
from tests.samples import INGESTED, ISS, OLD, record_rows, utc

START = utc(2026, 5, 28)


def test_stations_out_of_range_are_put_aside_and_counted(spark):
    rows = [("a", 90.0, -180.0, -500.0), ("b", 90.1, 0.0, 0.0), ("c", 0.0, 181.0, 0.0), ("d", 0.0, 0.0, float("nan")), ("e", None, 0.0, 0.0), ("a", 1.0, 1.0, 1.0)]
    stations = spark.createDataFrame(rows, "station string, latitude_deg double, longitude_deg double, altitude_m double")
    kept, rejected = checks.quarantined(stations)
    assert kept.columns == stations.columns and [r["station"] for r in kept.collect()] == ["a", "a"]
    assert {r["station"]: r["status"].split("_")[0] for r in rejected.collect()} == {"b": "latitude", "c": "longitude", "d": "altitude", "e": "latitude"}
    assert checks.reconciled(stations, kept, rejected).first().asDict() == {"row_count": 6, "kept_count": 2, "rejected_count": 4, "complete": True}
    assert checks.reconciled(stations, kept, kept).first()["complete"] is False
    empty = stations.where("false")
    assert checks.reconciled(empty, *checks.quarantined(empty)).first()["complete"] is True


def test_policies_that_cannot_be_judged_by_take_no_part(spark):
    rows = [
        ("good", "temp", "high", 10.0, 20.0, 1, "a", "n"),
        ("sideways", "temp", "up", 10.0, 20.0, 1, "a", "n"),
        ("upside", "temp", "high", 20.0, 10.0, 1, "a", "n"),
        ("never", "temp", "low", 20.0, 10.0, 0, "a", "n"),
        ("blank", "temp", "low", float("nan"), 10.0, 1, "a", "n"),
    ]
    columns = "entity_id long, scenario string, sequence_count long, sample_ordinal long, source_event_time timestamp, subsystem string, measurement_name string, measurement_value double"
    samples = spark.createDataFrame([(1, "s", 0, 0, START, "t", "temp", 25.0)], columns)
    found = compare_policies(samples, alerts.policy_table(spark, rows))
    assert [(r["policy"], r["event_count"]) for r in found["comparison"].collect()] == [("good", 1)]
    assert {r["policy"]: r["status"] for r in found["rejected_policies"].collect()} == {
        "sideways": "direction_unknown",
        "upside": "thresholds_out_of_order",
        "never": "persistence_out_of_range",
        "blank": "threshold_missing",
    }


def test_one_content_has_one_canonical_text(spark):
    text = json.dumps(ISS)
    turned = json.dumps(dict(reversed(ISS.items())), indent=3)
    frame = spark.createDataFrame([(1, text), (2, turned), (3, "[1]"), (4, '{"b": {"z": 1, "a": [2, {"y": null, "x": 1.50}]}}')], "n int, record_text string")
    rows = {r["n"]: r for r in codec.canonical_records(frame, ["n"]).collect()}
    assert rows[1]["canonical_text"] == rows[2]["canonical_text"] and rows[1]["digest"] == rows[2]["digest"]
    assert json.loads(rows[1]["canonical_text"]) == ISS
    assert (rows[3]["canonical_text"], rows[3]["digest"], rows[3]["drifts"]) == (None, None, False) and rows[3]["reject_reason"]
    assert rows[4]["canonical_text"] == '{"b":{"a":[2,{"x":1.5,"y":null}],"z":1}}'
    assert not any(r["drifts"] for r in rows.values())


def test_stored_rows_come_back_as_they_were(spark):
    rows = catalog.good(catalog.normalize(record_rows(spark, ISS, {**OLD, "OBJECT_NAME": 'a "b" \\ é'}), F.lit(INGESTED), keep=["position"]))
    assert {(r["position"], r["same"]) for r in codec.round_trips(rows, ["position"]).collect()} == {(0, True), (1, True)}


def test_pages_hold_the_windows_that_start_in_them(spark):
    rows = [(1, "s", START + timedelta(minutes=m), START + timedelta(minutes=m + 5), START + timedelta(minutes=m + 2), 300.0, 20.0) for m in (29, 0, 30, 59, 300)]
    windows = spark.createDataFrame(rows, "norad_cat_id long, station string, start timestamp, end timestamp, peak_at timestamp, duration_seconds double, max_elevation_deg double")
    pages = {r["page"]: r for r in visibility.page_windows(windows, START, 1800).collect()}
    assert {page: r["count"] for page, r in pages.items()} == {0: 2, 1: 2, 10: 1}
    assert [w["start"].minute for w in pages[0]["windows"]] == [0, 29]
    whole = visibility.nest_windows(windows).first()["windows"]
    assert [w for page in sorted(pages) for w in pages[page]["windows"]] == whole
    with pytest.raises(ValueError):
        visibility.page_windows(windows, START, 0)
