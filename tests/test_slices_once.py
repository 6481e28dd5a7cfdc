"""A slice of telemetry is worked through once for its events and once for its state."""

from __future__ import annotations

import pytest
from perigee.operators import alerts
from perigee.plans.operations import continue_events
from tests.test_alerts import POLICIES, samples


def passes(frame) -> int:
    """How often the plan places the graded samples."""
    return frame._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL")


def parts(spark):
    rows = [(entity, k, 3 * k + entity, "t", "temp", (7, 12, 25)[k * (entity + 4) % 3]) for entity in (1, 2) for k in range(40)]
    policies = alerts.policy_table(spark, POLICIES)
    early, late = (samples(spark, [r for r in rows if (r[1] < 17) == first]) for first in (True, False))
    return samples(spark, rows), early, late, policies


def test_events_behind_a_state_place_the_samples_once(spark):
    whole, early, late, policies = parts(spark)
    events = alerts.threshold_events(early, policies)
    state = alerts.alert_state(early, policies, events).localCheckpoint()
    more = alerts.threshold_events(late, policies, state=state)
    assert passes(more) == 1
    assert sorted(events.collect() + more.collect()) == sorted(alerts.threshold_events(whole, policies).collect())


@pytest.mark.parametrize("segment_rows", [1_000_000, 5])
def test_segment_ends_are_stored_for_events_and_state(spark, tmp_path, segment_rows):
    whole, early, late, policies = parts(spark)
    found = [continue_events(part, policies, str(tmp_path), n + 1, segment_rows) for n, part in enumerate((early, late))]
    expected = alerts.threshold_events(whole, policies).collect()
    assert sorted(found[0].collect() + found[1].collect()) == sorted(expected) != []
    ends = spark.read.parquet(f"{tmp_path}/alert_ends/slice=2")
    state = spark.read.parquet(f"{tmp_path}/alert_state/slice=2").where("measurement_name is not null")
    assert ends.select(*alerts.SERIES).distinct().count() == state.count() == 4
    assert passes(alerts.alert_state(late, policies, found[1], None, segment_rows, ends)) == 0
