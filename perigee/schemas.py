"""Table schemas shared by the jobs."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*columns: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(c[0], c[1], c[2] if len(c) == 3 else True) for c in columns])


_s, _l, _i, _d = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_ts, _date = T.TimestampType(), T.DateType()

BRONZE = _schema(
    ("object_name", _s),
    ("object_id", _s),
    ("norad_cat_id", _s),
    ("epoch_raw", _s),
    ("mean_motion_raw", _s),
    ("inclination_raw", _s),
    ("eccentricity_raw", _s),
    ("raw_record_json", _s, False),
    ("source_name", _s, False),
    ("source_url", _s, False),
    ("source_type", _s, False),
    ("ingested_at", _ts),
    ("ingestion_date", _date),
)

SILVER = _schema(
    ("object_name", _s),
    ("object_id", _s),
    ("norad_cat_id", _l),
    ("epoch", _ts),
    ("mean_motion", _d),
    ("inclination", _d),
    ("eccentricity", _d),
    ("source_name", _s),
    ("source_url", _s),
    ("source_type", _s),
    ("ingested_at", _ts),
    ("ingestion_date", _date),
    ("epoch_age_hours", _d),
    ("freshness_status", _s),
    ("quality_status", _s),
    ("raw_record_json", _s),
)

GOLD = _schema(
    ("metric_date", _date, False),
    ("source_name", _s, False),
    ("freshness_status", _s, False),
    ("quality_status", _s, False),
    ("satellite_count", _l, False),
    ("avg_epoch_age_hours", _d),
    ("min_epoch_age_hours", _d),
    ("max_epoch_age_hours", _d),
)

RUN = _schema(
    ("run_id", _l),
    ("source_name", _s),
    ("source_url", _s),
    ("started_at", _ts),
    ("completed_at", _ts),
    ("status", _s),
    ("http_status", _i),
    ("record_count", _i),
    ("error_message", _s),
)

# one row per satellite as stored: the run that saw it last decides its names
SATELLITE = _schema(
    ("norad_cat_id", _l),
    ("object_name", _s),
    ("object_id", _s),
    ("source_name", _s),
    ("first_seen_at", _ts),
    ("last_seen_at", _ts),
    ("last_run_id", _l),
    ("bucket", _i),
)

POLICY = _schema(
    ("policy", _s),
    ("measurement_name", _s),
    ("direction", _s),
    ("warning", _d),
    ("critical", _d),
    ("required_persistence", _i),
    ("recommended_action", _s),
    ("notes", _s),
)

STATION = _schema(
    ("station", _s),
    ("latitude_deg", _d),
    ("longitude_deg", _d),
    ("altitude_m", _d),
)

# a catalog record as history stores it, the run as partition column
SNAPSHOT = _schema(
    ("object_name", _s),
    ("object_id", _s),
    ("norad_cat_id", _l),
    ("epoch", _ts),
    ("mean_motion", _d),
    ("inclination", _d),
    ("eccentricity", _d),
    ("raw_record_json", _s),
    ("ingested_at", _ts),
    ("epoch_age_hours", _d),
    ("freshness_status", _s),
    ("source_json", _s),
    ("record_position", _l),
    ("run_id", _l),
)
