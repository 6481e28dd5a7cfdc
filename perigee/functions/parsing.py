"""Lenient text-to-value columns.

ANSI mode stays on, so every conversion of source text goes through a
``try_`` form: bad text becomes NULL and never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def long_or_null(text: Column) -> Column:
    """Integer text, or decimal text cut to its whole part."""
    return text.try_cast("decimal(20,4)").try_cast("bigint")


def double_or_null(text: Column) -> Column:
    return text.try_cast("double")


def plain_double_or_null(text: Column) -> Column:
    """As ``double_or_null`` but without the JVM's ``1.5d`` / ``1.5f`` suffixes."""
    return F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), double_or_null(text))


def finite_or_null(value: Column) -> Column:
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def epoch_or_null(text: Column) -> Column:
    """ISO text with or without zone as a timestamp; text that is not a full date is NULL."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def iso_utc(ts: Column) -> Column:
    """UTC ISO-8601 text ending in ``Z``, microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(
        whole, F.when(micros != 0, F.format_string(".%06d", micros)).otherwise(F.lit("")), F.lit("Z")
    )


def json_field(variant: Column, name: str) -> Column:
    return F.try_variant_get(variant, f"$.{name}", "string")


def number_text(value: Column) -> Column:
    """Number text of up to six significant digits without trailing zeros."""
    size = F.abs(value)
    plain = (
        F.when(size < 1e3, value)
        .when(size < 1e4, F.round(value, 2))
        .when(size < 1e5, F.round(value, 1))
        .otherwise(F.round(value, 0))
        .cast("decimal(20,3)")
        .cast("string")
    )
    large = F.regexp_replace(F.format_string("%.5e", value), r"\.?0*e", "e")
    return F.when(size >= 999999.5, large).otherwise(F.regexp_replace(plain, r"\.?0+$", ""))
