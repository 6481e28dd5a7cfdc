from __future__ import annotations

import random
from datetime import timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perigee.functions import parsing
from perigee.operators import alerts
from perigee.plans.operations import compare_policies, continue_events
from tests.samples import utc

START = utc(2026, 5, 28, 2, 50, 5)
COLUMNS = (
    "entity_id long, scenario string, sequence_count long, sample_ordinal long, source_event_time timestamp, "
    "subsystem string, measurement_name string, measurement_value double"
)


def samples(spark, rows):
    """rows: (entity, sequence, ordinal, subsystem, metric, value)"""
    data = [(e, "thermal_drift", s, o, START + timedelta(seconds=300 * s), sub, m, float(v)) for e, s, o, sub, m, v in rows]
    return spark.createDataFrame(data, COLUMNS)


def loop_events(rows, policies):
    """The rule one sample at a time."""
    out = []
    names = {p[0] for p in policies}
    for entity in sorted({r[0] for r in rows}):
        for policy in names:
            table = {p[1]: p for p in policies if p[0] == policy}
            counts, last, number = {}, {}, 0
            for _, seq, ordinal, _, metric, value in sorted(r for r in rows if r[0] == entity):
                if metric not in table:
                    continue
                _, _, direction, warning, critical, need = table[metric][:6]
                worse = (lambda b: value >= b) if direction == "high" else (lambda b: value <= b)
                level = "critical" if worse(critical) else "warning" if worse(warning) else "info"
                if level == "info":
                    counts[metric, "warning"] = counts[metric, "critical"] = 0
                    last.pop(metric, None)
                    continue
                counts[metric, level] = counts.get((metric, level), 0) + 1
                if counts[metric, level] >= need and last.get(metric) != level:
                    last[metric] = level
                    number += 1
                    out.append((entity, policy, number, seq, ordinal, metric, level))
    return sorted(out)


def spark_events(df, policies, rows, **options):
    events = alerts.threshold_events(df, policies, **options).select(
        "entity_id", "policy", "event_no", "event_time", "triggered_by", "severity"
    )
    where = {(r[0], START + timedelta(seconds=300 * r[1]), r[4]): (r[1], r[2]) for r in rows}
    found = []
    for e in events.collect():
        at = e["event_time"].replace(tzinfo=START.tzinfo)
        seq, ordinal = where[e["entity_id"], at, e["triggered_by"]]
        found.append((e["entity_id"], e["policy"], e["event_no"], seq, ordinal, e["triggered_by"], e["severity"]))
    return sorted(found)


POLICIES = [
    ("eager", "temp", "high", 10.0, 20.0, 1, "a", "n"),
    ("eager", "volt", "low", 5.0, 2.0, 1, "a", "n"),
    ("calm", "temp", "high", 10.0, 20.0, 2, "a", "n"),
    ("calm", "volt", "low", 5.0, 2.0, 4, "a", "n"),
]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("segment_rows", [1_000_000, 40, 7])
def test_windows_equal_the_loop_whole_and_cut(spark, seed, segment_rows):
    rng = random.Random(seed)
    # entity 1 holds most rows; long alerting stretches cross the cuts
    rows, ordinal = [], 0
    for entity, steps in ((1, 120), (2, 30), (3, 4)):
        hot = 0
        for seq in range(steps):
            hot = hot - 1 if hot else (rng.randint(5, 25) if rng.random() < 0.2 else 0)
            for metric in ("temp", "volt", "ignored"):
                level = rng.choice("wc" if hot else "iwc")
                value = {"i": 7, "w": 12, "c": 25}[level] if metric == "temp" else {"i": 7, "w": 4, "c": 1}[level]
                rows.append((entity, seq, ordinal, metric, metric, value))
                ordinal += 1
    policies = alerts.policy_table(spark, POLICIES)
    expected = loop_events(rows, POLICIES)
    assert len(expected) > 50
    assert spark_events(samples(spark, rows), policies, rows, segment_rows=segment_rows) == expected


@pytest.mark.parametrize(("seed", "segment_rows"), [(4, 1_000_000), (5, 11)])
def test_slices_of_time_give_the_events_of_one_pass(spark, tmp_path, seed, segment_rows):
    rng = random.Random(seed)
    rows, ordinal = [], 0
    for entity, steps in ((1, 60), (2, 24), (3, 4)):
        hot = 0
        for seq in range(steps):
            hot = hot - 1 if hot else (rng.randint(5, 25) if rng.random() < 0.2 else 0)
            for metric in ("temp", "volt"):
                level = rng.choice("wc" if hot else "iwc")
                value = {"i": 7, "w": 12, "c": 25}[level] if metric == "temp" else {"i": 7, "w": 4, "c": 1}[level]
                rows.append((entity, seq, ordinal, metric, metric, value))
                ordinal += 1
    policies = alerts.policy_table(spark, POLICIES)
    pick = ["entity_id", "policy", "event_no", "event_id", "event_time", "triggered_by", "severity"]
    expected = alerts.threshold_events(samples(spark, rows), policies).select(*pick).collect()
    found = []
    # the second slice has no sample of entity 3, and the fourth none of entity 2
    for number, (low, high) in enumerate(((0, 9), (9, 13), (13, 30), (30, 60))):
        part = samples(spark, [r for r in rows if low <= r[1] < high])
        found += continue_events(part, policies, str(tmp_path), number + 1, segment_rows).select(*pick).collect()
    assert sorted(found) == sorted(expected) and len(expected) == len(loop_events(rows, POLICIES)) > 30
    state = spark.read.parquet(f"{tmp_path}/alert_state/slice=4")
    assert state.where("measurement_name is not null").count() == 3 * 4


def test_slices_are_stored_and_repeated(spark, tmp_path):
    policies = alerts.policy_table(spark, POLICIES)
    rows = [(1, k, k, "t", "temp", (7, 12, 25)[k * 7 % 3]) for k in range(30)]
    expected = sorted(alerts.threshold_events(samples(spark, rows), policies).collect())
    part = lambda a, b: samples(spark, rows[a:b])
    run = lambda number, a, b: continue_events(part(a, b), policies, str(tmp_path), number)
    first = run(1, 0, 11).collect()
    with pytest.raises(ValueError, match="has not been run"):
        run(3, 11, 30)
    second = run(2, 11, 30).collect()
    assert sorted(first + second) == expected
    assert sorted(first + run(2, 11, 30).collect()) == expected
    with pytest.raises(ValueError, match="late"):
        run(3, 29, 30)
    assert run(3, 0, 0).count() == 0


def test_guidance_is_one_row_a_policy(spark):
    policies = alerts.policy_table(spark, [(*p[:7], f"note {k}") for k, p in enumerate(POLICIES[:2])])
    frame = samples(spark, [(1, 0, 0, "t", "temp", 25.0)])
    rows = alerts.policy_comparison(frame, alerts.threshold_events(frame, policies), policies).collect()
    assert [(r["policy"], r["notes"], r["event_count"]) for r in rows] == [("eager", "note 0", 1)]


@pytest.mark.parametrize("segment_rows", [1_000_000, 5])
def test_scenarios_are_series_of_their_own(spark, segment_rows):
    rng = random.Random(11)
    by = {name: [(1, i, i, "temp", "temp", rng.choice((7, 12, 25))) for i in range(30)] for name in ("a", "b")}
    policies = alerts.policy_table(spark, POLICIES)
    frames = [samples(spark, rows).withColumn("scenario", F.lit(name)) for name, rows in by.items()]
    both = frames[0].unionAll(frames[1])
    for (name, rows), alone in zip(by.items(), frames, strict=True):
        pick = ["event_id", "event_no", "event_time", "severity"]
        expected = alerts.threshold_events(alone, policies, segment_rows=segment_rows).select(*pick).collect()
        found = alerts.threshold_events(both, policies, segment_rows=segment_rows).where(F.col("scenario") == name)
        assert sorted(found.select(*pick).collect()) == sorted(expected) != []
        assert len(expected) == len(loop_events(rows, POLICIES))
    assert {r["scenario"] for r in alerts.latest_per_subsystem(both).collect()} == {"a", "b"}


def test_nan_reaches_no_threshold(spark):
    rows = [(1, 0, 0, "t", "temp", float("nan")), (1, 1, 1, "v", "volt", float("nan")), (1, 2, 2, "t", "temp", 25.0)]
    policies = alerts.policy_table(spark, POLICIES[:2])
    events = alerts.threshold_events(samples(spark, rows), policies).collect()
    assert [(e["triggered_by"], e["measurement_value"]) for e in events] == [("temp", 25.0)]
    status = alerts.with_status(samples(spark, rows), policies, "eager").orderBy("sequence_count").collect()
    assert [r["status"] for r in status] == ["info", "info", "critical"]


def test_unknown_direction_is_refused(spark):
    policies = alerts.policy_table(spark, [("p", "temp", "up", 1.0, 2.0, 1, "a", "n")])
    with pytest.raises(Exception, match="neither high nor low"):
        alerts.threshold_events(samples(spark, [(1, 0, 0, "t", "temp", 3.0)]), policies).collect()


def test_one_sequence_number_is_cut_evenly(spark):
    df = samples(spark, [(1, 5, i, "t", "temp", 1.0) for i in range(1000)])
    bounds = [r["sample_ordinal"] for r in alerts.cuts(df, 100).first()["_cuts"]]
    sizes = [b - a for a, b in zip([0, *bounds], [*bounds, 1000], strict=True)]
    assert len(sizes) >= 8 and max(sizes) <= 220


@pytest.mark.parametrize(
    ("levels", "expected"),
    [
        ("wcw", [(2, "warning")]),
        ("wwccw", [(1, "warning"), (3, "critical"), (4, "warning")]),
        ("wwiw", [(1, "warning")]),
        ("wiwi", []),
    ],
)
@pytest.mark.parametrize("segment_rows", [1000, 1])
def test_state_machine_edges(spark, levels, expected, segment_rows):
    value = {"i": 1.0, "w": 12.0, "c": 25.0}
    rows = [(9, i, i, "thermal", "temp", value[c]) for i, c in enumerate(levels)]
    policies = alerts.policy_table(spark, [("two", "temp", "high", 10.0, 20.0, 2, "a", "n")])
    found = spark_events(samples(spark, rows), policies, rows, segment_rows=segment_rows)
    assert [(f[3], f[6]) for f in found] == expected


def ramp(spark, entity=25544):
    metrics = [
        ("power", "bus_voltage_v", lambda k: 28.2),
        ("thermal", "battery_temperature_c", lambda k: round(24 + 38 * k / 12, 3)),
        ("communications", "downlink_margin_db", lambda k: 8.4),
        ("payload", "payload_current_a", lambda k: 1.8),
        ("attitude_mode", "pointing_error_deg", lambda k: 0.05),
    ]
    return samples(spark, [(entity, k, i, s, m, f(k)) for k in range(13) for i, (s, m, f) in enumerate(metrics)])


def test_thermal_ramp_under_the_standing_policies(spark, tmp_path):
    out = compare_policies(ramp(spark), events_path=str(tmp_path / "events"))
    rows = {r["policy"]: r for r in out["comparison"].collect()}
    minutes = lambda t: None if t is None else (t.replace(tzinfo=START.tzinfo) - START).seconds // 60
    facts = {
        p: (r["event_count"], minutes(r["first_warning_time"]), minutes(r["first_critical_time"]), r["top_affected_subsystem"])
        for p, r in rows.items()
    }
    assert facts == {
        "conservative_ops": (2, 15, 30, "thermal"),
        "balanced_ops": (2, 25, 45, "thermal"),
        "relaxed_ops": (1, 45, None, "thermal"),
    }
    event = out["events"].where("policy = 'relaxed_ops'").collect()[0]
    assert event["event_id"] == "SIM-25544-thermal_drift-relaxed_ops-001"
    assert event["summary"] == "Warning simulated thermal event: battery_temperature_c reached 52.5."
    assert event["recommended_operator_check"].startswith("Focused check: Review thermal trend")
    assert event["threshold"] == 44.0
    runbook = {r["policy"]: r["runbook_summary"] for r in out["runbook"].collect()}
    assert runbook["relaxed_ops"] == (
        "Simulated spacecraft telemetry for scenario 'thermal_drift' produced 1 event(s) under relaxed_ops; "
        "first affected subsystem is thermal at 2026-05-28T03:35:05Z. Critical events: 0. "
        "Recommended action: Monitor for sustained degradation before interrupting the nominal plan."
    )


def test_quiet_series_reports_zero_for_every_policy(spark):
    quiet = ramp(spark).where("measurement_name <> 'battery_temperature_c'")
    out = compare_policies(quiet)
    assert out["events"].count() == 0
    rows = out["runbook"].collect()
    assert len(rows) == 3 and all(r["event_count"] == 0 for r in rows)
    assert all("Continue nominal review" in r["runbook_summary"] for r in rows)


def test_top_subsystem_tie_goes_to_the_first(spark):
    rows = [(1, 0, 0, "b", "volt", 1.0), (1, 0, 1, "a", "temp", 25.0)]
    policies = alerts.policy_table(spark, [r for r in POLICIES if r[0] == "eager"])
    df = samples(spark, rows)
    comparison = alerts.policy_comparison(df, alerts.threshold_events(df, policies), policies).collect()
    assert [r["top_affected_subsystem"] for r in comparison] == ["b"]


def test_status_uses_the_unrounded_value(spark):
    rows = [(1, 0, 0, "thermal", "battery_temperature_c", 35.9996), (1, 0, 1, "payload", "payload_current_a", 1.23456)]
    out = {r["measurement_name"]: r for r in alerts.with_status(samples(spark, rows), alerts.default_policies(spark)).collect()}
    assert (out["battery_temperature_c"]["status"], out["battery_temperature_c"]["measurement_value"]) == ("info", 36.0)
    assert (out["payload_current_a"]["status"], out["payload_current_a"]["measurement_value"]) == ("info", 1.235)


def test_event_numbers_pad_and_grow(spark):
    rows = [(1, i, i, "thermal", "temp", 25.0 if i % 2 else 12.0) for i in range(1002)]
    policies = alerts.policy_table(spark, [("eager", "temp", "high", 10.0, 20.0, 1, "a", "n")])
    ids = [r["event_id"] for r in alerts.threshold_events(samples(spark, rows), policies).orderBy("event_no").collect()]
    assert (ids[0][-4:], ids[998][-4:], ids[1001][-5:]) == ("-001", "-999", "-1002")


def test_latest_per_subsystem(spark):
    rows = [(1, 0, 0, "a", "m", 1), (1, 2, 5, "a", "m", 2), (1, 2, 6, "a", "n", 3), (1, 1, 1, "b", "m", 4)]
    out = {r["subsystem"]: r["measurement_value"] for r in alerts.latest_per_subsystem(samples(spark, rows)).collect()}
    assert out == {"a": 3.0, "b": 4.0}


def test_samples_shuffle_once_before_the_policy_fan_out(spark):
    table = pa.table({"entity_id": [1, 2], "scenario": ["n", "n"], "sequence_count": [1, 2], "sample_ordinal": [1, 2]})
    df = spark.createDataFrame(table).withColumns(
        {
            "source_event_time": F.lit(START),
            "subsystem": F.lit("thermal"),
            "measurement_name": F.lit("temp"),
            "measurement_value": F.rand(1) * 30,
        }
    )
    policies = alerts.policy_table(spark, POLICIES)
    plan = alerts.threshold_events(df, policies)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    # cut series: the other exchanges carry per-segment summaries only
    cut = alerts.threshold_events(df, policies, segment_rows=0.5)._jdf.queryExecution().executedPlan().toString()
    placed = cut.count("REPARTITION_BY_COL")
    assert placed >= 1
    for part in cut.split("Exchange hashpartitioning")[1:]:
        keys = part[: part.index(")")]
        assert "REPARTITION_BY_COL" in part[:160] or "segment" not in keys or "measurement_name" not in keys


def test_number_text_has_six_significant_digits(spark):
    values = [0.0, 0.001, 36.123, 36.12, 52.5, 24.0, 100.0, -7.25, 999.999, 1234.567, 12345.678, 123456.789, 999999.7, 1e6, 1234567.0, 2.5e8]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(parsing.number_text(F.col("v")).alias("t"))
    assert [r["t"] for r in df.collect()] == [f"{v:g}" for v in values]


def test_iso_text(spark):
    df = spark.createDataFrame([(utc(2026, 5, 28, 2, 50, 5, 123456),), (START,)], "t timestamp")
    assert [r[0] for r in df.select(parsing.iso_utc(F.col("t"))).collect()] == [
        "2026-05-28T02:50:05.123456Z", "2026-05-28T02:50:05Z",
    ]
