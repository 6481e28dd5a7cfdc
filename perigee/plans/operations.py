"""Telemetry to alerts, comparison and runbook."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from perigee.operators import alerts, checks
from perigee.sources import tables


def compare_policies(
    samples: DataFrame, policies: DataFrame | None = None, events_path: str | None = None
) -> dict[str, DataFrame]:
    """Events, comparison and runbook for telemetry under the given policies.

    Policy rows that can't be judged by take no part and are returned with what is wrong
    (``rejected_policies``). With ``events_path`` the events are written there once and read back for the
    rest, so the telemetry is not worked through again for each result.
    """
    spark = samples.sparkSession
    policies = policies if policies is not None else alerts.default_policies(spark)
    checked = checks.with_policy_status(policies)
    policies = checked.where(F.col("status") == checks.OK).drop("status")
    events = alerts.threshold_events(samples, policies)
    if events_path is not None:
        events.write.mode("overwrite").parquet(events_path)
        events = spark.read.parquet(events_path)
    comparison = alerts.policy_comparison(samples, events, policies)
    return {
        "events": events,
        "comparison": comparison,
        "runbook": alerts.runbook_summary(comparison),
        "rejected_policies": checked.where(F.col("status") != checks.OK),
    }


def continue_events(
    samples: DataFrame, policies: DataFrame, root: str, slice_number: int, segment_rows: int = alerts.SEGMENT_ROWS
) -> DataFrame:
    """Events of the next slice of telemetry, numbered and judged as in one pass over all.

    Slices come in order of time, from 1 on. Each one stores its events and the state of
    all series behind it; the state of the slice before is all that is read of the past.
    What the series carry over their segments is worked out once and stored for both.
    Running a slice again replaces what it stored. Samples that should have been in an
    earlier slice are an error, as the events behind them are out already.
    """
    spark = samples.sparkSession
    state_path, events_path = f"{root.rstrip('/')}/alert_state", f"{root.rstrip('/')}/alert_events"
    state = None
    if slice_number > 1:
        before = f"{state_path}/slice={slice_number - 1}"
        if not tables.names_in(spark, before):
            raise ValueError(f"slice {slice_number - 1} has not been run")
        state = spark.read.schema(alerts.STATE).parquet(before)
        late = alerts.late_samples(samples, state).limit(1).count()
        if late:
            raise ValueError("samples come late: their series was judged beyond them")
    path = f"{events_path}/slice={slice_number}"
    ends_path = f"{root.rstrip('/')}/alert_ends/slice={slice_number}"
    ends = alerts.segment_ends(samples, policies, state, segment_rows)
    ends.write.mode("overwrite").parquet(ends_path)
    ends = spark.read.schema(ends.schema).parquet(ends_path)
    events = alerts.threshold_events(samples, policies, segment_rows, state, ends)
    events.write.mode("overwrite").parquet(path)
    events = spark.read.schema(events.schema).parquet(path)
    behind = alerts.alert_state(samples, policies, events, state, segment_rows, ends)
    behind.write.mode("overwrite").parquet(f"{state_path}/slice={slice_number}")
    return events
