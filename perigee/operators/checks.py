"""Domain checks on tables: flag or list rows instead of failing the job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from perigee import fixed_values as fixed

OK = "ok"


def with_station_status(stations: DataFrame) -> DataFrame:
    """Append ``status``: the first coordinate outside its range, or ``ok``."""
    status = F.lit(OK)
    ranges = {
        "altitude_m": fixed.ALTITUDE_M,
        "longitude_deg": fixed.LONGITUDE_DEG,
        "latitude_deg": fixed.LATITUDE_DEG,
    }
    for name, (low, high) in ranges.items():
        inside = F.coalesce(F.col(name).between(low, high), F.lit(False))
        status = F.when(~inside, F.lit(f"{name}_out_of_range")).otherwise(status)
    return stations.withColumn("status", status)


def unknown_names(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Names in the column that are not allowed, with their row counts."""
    found = df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    return found.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def quarantined(stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stations whose coordinates are in range, the others with what is wrong as status)."""
    checked = with_station_status(stations)
    return checked.where(F.col("status") == OK).drop("status"), checked.where(F.col("status") != OK)


def with_policy_status(policies: DataFrame) -> DataFrame:
    """Append ``status``: why a policy row can't be judged by, or ``ok``.

    A direction has to be high or low, thresholds to be numbers with the critical one
    beyond the warning one or equal to it, and persistence one sample at least.
    """
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    beyond = F.when(F.col("direction") == "high", F.col("critical") >= F.col("warning")).otherwise(F.col("critical") <= F.col("warning"))
    tests = [
        ("policy_missing", F.col("policy").isNotNull() & F.col("measurement_name").isNotNull()),
        ("direction_unknown", F.col("direction").isin("high", "low")),
        ("threshold_missing", number("warning") & number("critical")),
        ("thresholds_out_of_order", beyond),
        ("persistence_out_of_range", F.col("required_persistence") >= 1),
    ]
    status = F.lit(OK)
    for name, passed in reversed(tests):
        status = F.when(~F.coalesce(passed, F.lit(False)), F.lit(name)).otherwise(status)
    return policies.withColumn("status", status)


def reconciled(rows: DataFrame, kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: how many rows came, stayed and were put aside, and whether none was lost."""
    count = lambda frame, name: frame.agg(F.count(F.lit(1)).alias(name))
    joined = count(rows, "row_count").crossJoin(count(kept, "kept_count")).crossJoin(count(rejected, "rejected_count"))
    return joined.withColumn("complete", F.col("row_count") == F.col("kept_count") + F.col("rejected_count"))
