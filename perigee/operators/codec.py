"""Canonical record texts and stored rows, each checked by decoding and encoding again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from perigee.operators import history
from perigee.sources import payloads


def canonical_records(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``record_text`` rows with their canonical text, its SHA-256 and whether it drifts.

    Canonical is the compact text with the keys of every object in order, so two records
    with the same content have one digest whatever their layout. A text ``drifts`` if
    reading it and writing it again gives another one. Rows that are no object have no
    text, and a reason.
    """
    checked = payloads.check_shape(records)
    texts = checked.withColumn("canonical_text", F.to_json("record"))
    again = F.to_json(F.try_parse_json("canonical_text"))
    return texts.select(
        *(keep or []),
        "canonical_text",
        F.sha2("canonical_text", 256).alias("digest"),
        (F.col("canonical_text").isNotNull() & ~again.eqNullSafe(F.col("canonical_text"))).alias("drifts"),
        "reject_reason",
    )


def round_trips(catalog: DataFrame, keep: list[str]) -> DataFrame:
    """CATALOG rows as stored, read back and compared field by field: what was stored of
    the source, and whether every field came back as it was (``same``)."""
    names = [c for c in catalog.columns if c not in keep]
    original = F.struct(*names).alias("_original")
    stored = history.stored_row(catalog.select("*", original))
    back = history.restored_row(stored.withColumn("_stored", F.col("source_json")))
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"_original.{name}"))
    return back.select(*keep, F.col("_stored").alias("source_json"), same.alias("same"))
