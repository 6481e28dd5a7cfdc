"""Age, freshness, quality and severity labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from perigee.fixed_values import FRESH_WITHIN_HOURS


def age_hours_whole_seconds(epoch: Column, at: Column) -> Column:
    """Layer age: whole seconds on both sides, negative for future epochs."""
    return (F.unix_timestamp(at) - F.unix_timestamp(epoch)) / F.lit(3600.0)


def age_hours_exact(epoch: Column, at: Column) -> Column:
    """Catalog age: microseconds, never below zero; NULL without an epoch."""
    micros = F.unix_micros(at) - F.unix_micros(epoch)
    return F.when(epoch.isNotNull(), F.greatest(F.lit(0.0), micros / F.lit(1e6) / F.lit(3600.0)))


def freshness(age_hours: Column) -> Column:
    return (
        F.when(age_hours.isNull(), "unknown")
        .when(age_hours <= F.lit(FRESH_WITHIN_HOURS), "fresh")
        .otherwise("stale")
    )


def quality(epoch: Column, norad_cat_id: Column) -> Column:
    return (
        F.when(epoch.isNull(), "invalid_missing_epoch")
        .when(norad_cat_id.isNull(), "invalid_missing_norad_cat_id")
        .otherwise("valid")
    )


def severity(value: Column, direction: Column, warning: Column, critical: Column) -> Column:
    """``info``, ``warning`` or ``critical``; the bounds themselves count as reached.

    NaN, as a value or a bound, reaches nothing (Spark orders it above all numbers). A
    direction that is neither high nor low fails the job.
    """
    unknown = direction.isNotNull() & ~direction.isin("high", "low")

    def reached(bound: Column) -> Column:
        number = ~F.isnan(value) & ~F.isnan(bound)
        return number & F.when(direction == "high", value >= bound).when(direction == "low", value <= bound)

    refused = F.raise_error(F.concat(F.lit("direction is neither high nor low: "), direction)).cast("string")
    return F.when(unknown, refused).when(reached(critical), "critical").when(reached(warning), "warning").otherwise("info")


def threshold_hit(severity_label: Column, warning: Column, critical: Column) -> Column:
    return F.when(severity_label == "critical", critical).when(severity_label == "warning", warning)
