"""Independent SQL for the registered queries, run by another engine on the same tables.

Each query is composed from named fragments; the engine's views carry the table
names. Where the jobs prune or cut work, the SQL takes the plain way (all pairs,
whole series).
"""

from __future__ import annotations

import re
from math import pi

SOURCE = (
    "'CelesTrak GP active' AS {p}name, "
    "'https://celestrak.org/NORAD/elements/gp.php?GROUP=active&FORMAT=json' AS {p}url, "
    "'real_public_orbit_data' AS {p}type"
)

FRAGMENTS: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def _needed(sql: str) -> list[str]:
    """Fragments a statement uses, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in FRAGMENTS:
            if re.search(rf"\b{name}\b", text) and name not in found:
                visit(FRAGMENTS[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def _oracle(key: str, sql: str) -> None:
    parts = ",\n".join(f"{name} AS ({FRAGMENTS[name]})" for name in _needed(sql))
    ORACLES[key] = f"WITH {parts}\n{sql}" if parts else sql


# --- layers -----------------------------------------------------------------
FRAGMENTS["raw_records"] = """
  SELECT event_id, event_type AS object_name, 'U-' || user_id AS object_id,
         CASE WHEN event_id % 23 = 0 THEN 'abc' ELSE user_id::VARCHAR END AS id_text,
         CASE WHEN event_id % 17 <> 0 THEN strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') END AS epoch_raw,
         CASE WHEN event_id % 19 = 0 THEN '' ELSE value::VARCHAR END AS motion_text,
         (user_id % 180)::VARCHAR AS inclination_text,
         CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE '0.0005' END AS eccentricity_text,
         unnest(CASE WHEN event_id % 10 = 0 THEN [1, 2] ELSE [1] END) AS copy
  FROM events"""
FRAGMENTS["silver_rows"] = f"""
  SELECT *,
         CASE WHEN epoch IS NULL THEN 'unknown' WHEN age <= 72.0 THEN 'fresh' ELSE 'stale' END AS freshness_status,
         CASE WHEN epoch IS NULL THEN 'invalid_missing_epoch'
              WHEN norad_cat_id IS NULL THEN 'invalid_missing_norad_cat_id' ELSE 'valid' END AS quality_status
  FROM (
    SELECT object_name, object_id, TRY_CAST(id_text AS BIGINT) AS norad_cat_id,
           epoch_raw::TIMESTAMP AS epoch,
           TRY_CAST(NULLIF(motion_text, '') AS DOUBLE) AS mean_motion,
           TRY_CAST(inclination_text AS DOUBLE) AS inclination,
           TRY_CAST(eccentricity_text AS DOUBLE) AS eccentricity,
           {SOURCE.format(p='source_')},
           (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(epoch_raw::TIMESTAMP)) / 3600e6 AS age
    FROM raw_records
    QUALIFY row_number() OVER (
      PARTITION BY TRY_CAST(id_text AS BIGINT), epoch_raw ORDER BY event_id, copy) = 1)"""
FRAGMENTS["gold_rows"] = """
  SELECT DATE '2024-02-01' AS metric_date, source_name, freshness_status, quality_status,
         count(*)::BIGINT AS satellite_count, avg(age) AS avg_epoch_age_hours,
         min(age) AS min_epoch_age_hours, max(age) AS max_epoch_age_hours
  FROM silver_rows GROUP BY ALL"""

_oracle(
    "bronze_orbit_records",
    f"""
  SELECT object_name, object_id, id_text AS norad_cat_id, epoch_raw,
         NULLIF(motion_text, '') AS mean_motion_raw, inclination_text AS inclination_raw,
         eccentricity_text AS eccentricity_raw, {SOURCE.format(p='source_')},
         TIMESTAMP '2024-02-01' AS ingested_at, DATE '2024-02-01' AS ingestion_date, event_id
  FROM raw_records""",
)
_oracle(
    "bronze_rejects",
    """
  SELECT event_id,
         CASE WHEN event_id % 11 = 0 THEN props
              WHEN event_id % 13 = 0 THEN event_id::VARCHAR
              ELSE '[' || props END AS record_text,
         CASE WHEN event_id % 11 = 0 THEN 'payload_not_a_list'
              WHEN event_id % 13 = 0 THEN 'item_not_an_object'
              ELSE 'payload_not_a_list' END AS reject_reason
  FROM events
  WHERE event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 7 = 0""",
)
_oracle(
    "silver_orbit_snapshots",
    """
  SELECT object_name, object_id, norad_cat_id, epoch, mean_motion, inclination, eccentricity,
         source_name, source_url, source_type, TIMESTAMP '2024-02-01' AS ingested_at,
         DATE '2024-02-01' AS ingestion_date, round(age, 6) AS epoch_age_hours,
         freshness_status, quality_status
  FROM silver_rows""",
)
GOLD_ROUNDED = """
  SELECT metric_date, source_name, freshness_status, quality_status, satellite_count,
         round(avg_epoch_age_hours, 6) AS avg_epoch_age_hours,
         round(min_epoch_age_hours, 6) AS min_epoch_age_hours,
         round(max_epoch_age_hours, 6) AS max_epoch_age_hours
  FROM gold_rows"""
_oracle("gold_freshness_metrics", GOLD_ROUNDED + " ORDER BY 1, 2, 3, 4")
_oracle("gold_incremental", GOLD_ROUNDED + " ORDER BY 1, 2, 3, 4")
_oracle("gold_load_contract", GOLD_ROUNDED)
_oracle(
    "kpi_freshness_by_date",
    """
  SELECT metric_date, freshness_status, sum(satellite_count)::BIGINT AS satellite_count
  FROM gold_rows GROUP BY 1, 2 ORDER BY 1, 2""",
)
_oracle(
    "kpi_quality_by_date",
    """
  SELECT metric_date, quality_status, sum(satellite_count)::BIGINT AS satellite_count,
         round(avg(avg_epoch_age_hours), 2) AS avg_epoch_age_hours,
         round(sum(avg_epoch_age_hours * satellite_count)
               / sum(CASE WHEN avg_epoch_age_hours IS NOT NULL THEN satellite_count END), 2)
           AS weighted_avg_epoch_age_hours
  FROM gold_rows GROUP BY 1, 2 ORDER BY 1, 2""",
)
_oracle(
    "kpi_freshness_pivot",
    """
  SELECT metric_date,
         sum(CASE WHEN freshness_status = 'fresh' THEN satellite_count ELSE 0 END)::BIGINT AS fresh_satellites,
         sum(CASE WHEN freshness_status = 'stale' THEN satellite_count ELSE 0 END)::BIGINT AS stale_satellites,
         sum(CASE WHEN freshness_status = 'unknown' THEN satellite_count ELSE 0 END)::BIGINT AS unknown_satellites,
         sum(satellite_count)::BIGINT AS total_satellites
  FROM gold_rows GROUP BY 1 ORDER BY 1 DESC""",
)
_oracle(
    "gold_contract_check",
    """
  SELECT t.column_name, t.column_type AS expected_type, t.column_type AS found_type,
         CASE WHEN t.required THEN v.nulls ELSE 0 END::BIGINT AS null_violations,
         (NOT t.required OR v.nulls = 0) AS passed
  FROM (VALUES ('metric_date', 'date', true), ('source_name', 'string', true),
               ('freshness_status', 'string', true), ('quality_status', 'string', true),
               ('satellite_count', 'bigint', true), ('avg_epoch_age_hours', 'double', false),
               ('min_epoch_age_hours', 'double', false), ('max_epoch_age_hours', 'double', false)
       ) t(column_name, column_type, required)
  JOIN (UNPIVOT (SELECT count(*) FILTER (metric_date IS NULL) AS metric_date,
                        count(*) FILTER (source_name IS NULL) AS source_name,
                        count(*) FILTER (freshness_status IS NULL) AS freshness_status,
                        count(*) FILTER (quality_status IS NULL) AS quality_status,
                        count(*) FILTER (satellite_count IS NULL) AS satellite_count,
                        count(*) FILTER (avg_epoch_age_hours IS NULL) AS avg_epoch_age_hours,
                        count(*) FILTER (min_epoch_age_hours IS NULL) AS min_epoch_age_hours,
                        count(*) FILTER (max_epoch_age_hours IS NULL) AS max_epoch_age_hours
                 FROM gold_rows) ON COLUMNS(*) INTO NAME column_name VALUE nulls) v
    ON v.column_name = t.column_name""",
)

# --- catalog and history ----------------------------------------------------
FRAGMENTS["run_rows"] = """
  SELECT day(ts)::BIGINT AS run_id, 'events' AS source_name, 'events.parquet' AS source_url,
         min(ts) AS started_at, max(ts) AS completed_at,
         CASE WHEN day(ts) % 7 = 0 THEN 'error' ELSE 'success' END AS status,
         CASE WHEN day(ts) % 7 = 0 THEN 503 END::INTEGER AS http_status,
         CASE WHEN day(ts) % 7 = 0 THEN 0 ELSE count(*) END::INTEGER AS record_count,
         CASE WHEN day(ts) % 7 = 0 THEN 'request failed' END AS error_message
  FROM events GROUP BY day(ts)"""
FRAGMENTS["snapshot_rows"] = """
  SELECT day(ts)::BIGINT AS run_id, event_id AS snapshot_id, user_id AS norad_cat_id,
         event_type AS object_name, 'U-' || user_id AS object_id, 'events' AS source_name,
         ts AS ingested_at, value AS mean_motion, props
  FROM events"""
FRAGMENTS["latest_run"] = """
  SELECT * FROM run_rows WHERE status = 'success' ORDER BY completed_at DESC, run_id DESC LIMIT 1"""
SNAPSHOT = "run_id, snapshot_id, norad_cat_id, object_name, object_id, source_name, ingested_at, mean_motion"

_oracle(
    "catalog_normalized",
    f"""
  SELECT *, CASE WHEN epoch_age_hours IS NULL THEN 'unknown' WHEN epoch_age_hours <= 72.0 THEN 'fresh'
                 ELSE 'stale' END AS freshness_status,
         CASE WHEN norad_cat_id IS NULL THEN 'norad_cat_id_not_an_integer' END AS reject_reason
  FROM (
    SELECT object_name, object_id, TRY_CAST(id_text AS BIGINT) AS norad_cat_id, epoch_raw::TIMESTAMP AS epoch,
           TRY_CAST(NULLIF(motion_text, '') AS DOUBLE) AS mean_motion,
           TRY_CAST(inclination_text AS DOUBLE) AS inclination,
           TRY_CAST(eccentricity_text AS DOUBLE) AS eccentricity,
           {SOURCE.format(p='')}, TIMESTAMP '2024-02-01' AS ingested_at, event_id, copy,
           round(greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(epoch_raw::TIMESTAMP)) / 3600e6)
                 + CASE WHEN epoch_raw IS NULL THEN NULL ELSE 0 END, 6) AS epoch_age_hours
    FROM raw_records)""",
)
_oracle(
    "catalog_latest",
    f"SELECT {SNAPSHOT} FROM snapshot_rows WHERE run_id IN (SELECT run_id FROM latest_run) "
    "ORDER BY object_name, norad_cat_id, snapshot_id",
)
_oracle("ingestion_run_history", "SELECT * FROM run_rows ORDER BY started_at DESC, run_id DESC LIMIT 20")
_oracle(
    "ingest_due",
    """
  SELECT max(run_id) AS run_id, max(completed_at) AS completed_at,
         round(max(age), 6) AS age_hours, coalesce(NOT bool_or(age <= 2.0), true) AS ingest_due
  FROM (SELECT *, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(completed_at)) / 3600e6 AS age FROM latest_run)""",
)
_oracle(
    "catalog_lookup",
    f"""
  SELECT {SNAPSHOT}, (props <> '' AND props <> '{{}}') AS raw_record_available FROM snapshot_rows
  QUALIFY row_number() OVER (PARTITION BY norad_cat_id ORDER BY ingested_at DESC, snapshot_id DESC) = 1""",
)
_oracle(
    "catalog_search",
    f"""
  SELECT {SNAPSHOT} FROM snapshot_rows
  WHERE contains(lower(object_name || ' ' || norad_cat_id || ' ' || coalesce(object_id, '')), 'purchase 1')
  ORDER BY object_name, norad_cat_id, snapshot_id LIMIT 80""",
)
_oracle(
    "catalog_totals",
    "SELECT count(*)::BIGINT AS total_records, max(ts) AS last_ingested_at FROM events",
)
FRAGMENTS["good_snapshots"] = """
  SELECT * FROM snapshot_rows WHERE run_id IN (SELECT run_id FROM run_rows WHERE status = 'success')"""
_oracle(
    "satellite_seen",
    """
  SELECT norad_cat_id, object_name, object_id, source_name,
         min(ingested_at) OVER (PARTITION BY norad_cat_id) AS first_seen_at,
         max(ingested_at) OVER (PARTITION BY norad_cat_id) AS last_seen_at
  FROM good_snapshots
  QUALIFY row_number() OVER (PARTITION BY norad_cat_id ORDER BY ingested_at DESC, snapshot_id DESC) = 1""",
)
ORACLES["satellite_upsert"] = ORACLES["satellite_seen"]

# --- telemetry alerts -------------------------------------------------------
FRAGMENTS["thresholds"] = """
  SELECT * FROM (VALUES
    ('conservative_ops', 'error', 'high', 60.0::DOUBLE, 100.0::DOUBLE, 1),
    ('conservative_ops', 'purchase', 'low', 15.0, 5.0, 1), ('conservative_ops', 'signup', 'low', 15.0, 5.0, 1),
    ('balanced_ops', 'error', 'high', 80.0, 120.0, 2),
    ('balanced_ops', 'purchase', 'low', 10.0, 3.0, 2), ('balanced_ops', 'signup', 'low', 10.0, 3.0, 2),
    ('relaxed_ops', 'error', 'high', 100.0, 160.0, 3),
    ('relaxed_ops', 'purchase', 'low', 5.0, 1.0, 3), ('relaxed_ops', 'signup', 'low', 5.0, 1.0, 3)
  ) t(policy, metric, direction, warning, critical, persistence)"""
FRAGMENTS["telemetry"] = """
  SELECT user_id, event_id, ts, event_type, CASE WHEN event_id % 3 = 0 THEN 'storm' ELSE 'nominal' END AS scenario,
         CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value
  FROM events"""
SEVERITY = """CASE WHEN isnan({v}) THEN 'info'
              WHEN direction = 'high' AND {v} >= critical OR direction = 'low' AND {v} <= critical THEN 'critical'
              WHEN direction = 'high' AND {v} >= warning OR direction = 'low' AND {v} <= warning THEN 'warning'
              ELSE 'info' END"""
FRAGMENTS["graded"] = f"""
  SELECT e.user_id, e.scenario, e.event_id, e.ts, e.event_type AS metric, round(e.value, 3) AS v, p.*,
         {SEVERITY.format(v='round(e.value, 3)')} AS severity
  FROM telemetry e JOIN thresholds p ON e.event_type = p.metric"""
FRAGMENTS["stretches"] = """
  SELECT *, count(*) FILTER (severity = 'info') OVER (
    PARTITION BY user_id, scenario, policy, metric ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stretch FROM graded"""
FRAGMENTS["qualified"] = """
  SELECT * FROM stretches WHERE severity <> 'info'
  QUALIFY row_number() OVER (
    PARTITION BY user_id, scenario, policy, metric, stretch, severity ORDER BY ts, event_id) >= persistence"""
FRAGMENTS["emitted"] = """
  SELECT * FROM qualified
  QUALIFY coalesce(lag(severity) OVER (
    PARTITION BY user_id, scenario, policy, metric, stretch ORDER BY ts, event_id) <> severity, true)"""
FRAGMENTS["alert_rows"] = """
  SELECT *, row_number() OVER (PARTITION BY user_id, scenario, policy ORDER BY ts, event_id) AS event_no FROM emitted"""

_oracle(
    "telemetry_status",
    f"""
  SELECT e.user_id AS entity_id, e.scenario, epoch_us(e.ts) AS sequence_count,
         e.event_id AS sample_ordinal, e.ts AS source_event_time, e.event_type AS subsystem,
         e.event_type AS measurement_name, round(e.value, 3) AS measurement_value,
         {SEVERITY.format(v='e.value')} AS status
  FROM telemetry e LEFT JOIN (SELECT * FROM thresholds WHERE policy = 'balanced_ops') p ON e.event_type = p.metric""",
)
_oracle(
    "latest_per_subsystem",
    """
  SELECT user_id AS entity_id, scenario, epoch_us(ts) AS sequence_count,
         event_id AS sample_ordinal, ts AS source_event_time, event_type AS subsystem,
         event_type AS measurement_name, value AS measurement_value
  FROM telemetry
  QUALIFY row_number() OVER (PARTITION BY user_id, scenario, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
_oracle(
    "threshold_events",
    """
  SELECT user_id AS entity_id, event_no::INTEGER AS event_no,
         'SIM-' || user_id || '-' || scenario || '-' || policy || '-' || lpad(event_no::VARCHAR, greatest(3, length(event_no::VARCHAR))::INTEGER, '0') AS event_id,
         ts AS event_time, metric AS subsystem, severity, scenario, policy,
         metric AS triggered_by, v AS measurement_value,
         CASE severity WHEN 'critical' THEN critical ELSE warning END AS threshold,
         upper(severity[1]) || severity[2:] || ' simulated ' || metric || ' event: ' || metric || ' reached '
           || regexp_replace(v::VARCHAR, '\\.0$', '') || '.' AS summary,
         CASE severity WHEN 'critical' THEN 'Immediate' ELSE 'Focused' END
           || ' check: Review subsystem trend and recent scenario context.' AS recommended_operator_check,
         true AS is_simulated
  FROM alert_rows""",
)
ORACLES["threshold_events_sliced"] = ORACLES["threshold_events"]
FRAGMENTS["comparison_rows"] = """
  SELECT e.user_id AS entity_id, e.scenario, p.policy,
         count(a.event_no) AS event_count, count(*) FILTER (a.severity = 'critical') AS critical_count,
         min(a.ts) FILTER (a.severity = 'warning') AS first_warning_time,
         min(a.ts) FILTER (a.severity = 'critical') AS first_critical_time,
         arg_min(a.metric, a.event_no) AS first_subsystem, min(a.ts) AS first_event_time
  FROM (SELECT DISTINCT user_id, scenario FROM telemetry) e
  CROSS JOIN (SELECT DISTINCT policy FROM thresholds) p
  LEFT JOIN alert_rows a ON a.user_id = e.user_id AND a.scenario = e.scenario AND a.policy = p.policy
  GROUP BY ALL"""
FRAGMENTS["top_subsystems"] = """
  SELECT user_id, scenario, policy, metric AS top_affected_subsystem
  FROM (SELECT user_id, scenario, policy, metric, count(*) AS n, min(event_no) AS first_no FROM alert_rows GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id, scenario, policy ORDER BY n DESC, first_no) = 1"""
_oracle(
    "policy_comparison",
    """
  SELECT c.*, t.top_affected_subsystem, 'act on ' || c.policy AS recommended_action, c.policy AS notes
  FROM comparison_rows c LEFT JOIN top_subsystems t ON t.user_id = c.entity_id AND t.scenario = c.scenario AND t.policy = c.policy""",
)
_oracle(
    "runbook_summary",
    """
  SELECT entity_id, scenario, policy, event_count,
         CASE WHEN event_count = 0 THEN
           'No warning or critical events were generated from simulated spacecraft telemetry for scenario '''
           || scenario || ''' under ' || policy
           || '. Continue nominal review; this is not live spacecraft telemetry.'
         ELSE 'Simulated spacecraft telemetry for scenario ''' || scenario || ''' produced ' || event_count
           || ' event(s) under ' || policy || '; first affected subsystem is ' || first_subsystem || ' at '
           || strftime(first_event_time, '%Y-%m-%dT%H:%M:%S')
           || CASE WHEN epoch_us(first_event_time) % 1000000 = 0 THEN '' ELSE strftime(first_event_time, '.%f') END
           || 'Z. Critical events: ' || critical_count || '. Recommended action: act on ' || policy
         END AS runbook_summary
  FROM comparison_rows""",
)

# --- grids, frames and visibility -------------------------------------------
FRAGMENTS["orbits"] = """
  SELECT s_suppkey AS norad_cat_id, s_name AS object_name, s_nationkey AS nation_key,
         (6700 + s_suppkey * 131 % 1300)::DOUBLE AS radius_km, (30 + s_suppkey * 17 % 69)::DOUBLE AS inclination_deg,
         (s_suppkey * 37 % 360)::DOUBLE AS node_deg, (s_suppkey * 53 % 360)::DOUBLE AS start_deg,
         sqrt(398600.4418::DOUBLE / ((6700 + s_suppkey * 131 % 1300)::DOUBLE ** 3)) AS rate
  FROM supplier"""
FRAGMENTS["minutes_grid"] = """
  SELECT i::INTEGER AS sequence, TIMESTAMP '2024-01-01' + to_minutes(i) AS requested_at
  FROM range(121) t(i)"""
JD = (
    "(floor(epoch_us({t}) / 8.64e10) + 2440587.5::DOUBLE)",
    "(epoch_us({t}) % 86400000000 / 1e6 / 86400::DOUBLE)",
)
GMST = """((280.46061837::DOUBLE + 360.98564736629::DOUBLE * ({jd} - 2451545::DOUBLE)
    + 0.000387933::DOUBLE * (({jd} - 2451545::DOUBLE) / 36525::DOUBLE) ** 2
    - (({jd} - 2451545::DOUBLE) / 36525::DOUBLE) ** 3 / 38710000::DOUBLE) % 360 + 360) % 360"""
FRAGMENTS["circular"] = """
  SELECT o.*, g.*, radians(start_deg) + rate * (sequence * 60)::DOUBLE AS u,
         radians(node_deg) AS om, radians(inclination_deg) AS inc FROM orbits o CROSS JOIN minutes_grid g"""
FRAGMENTS["circular_xyz"] = """
  SELECT norad_cat_id, object_name, nation_key, sequence, requested_at,
         radius_km * (cos(om) * cos(u) - sin(om) * sin(u) * cos(inc)) AS x,
         radius_km * (sin(om) * cos(u) + cos(om) * sin(u) * cos(inc)) AS y,
         radius_km * sin(u) * sin(inc) AS z
  FROM circular"""
E2 = "0.0066943799901413165::DOUBLE"
A = "6378.137::DOUBLE"


def _geodetic(prefix: str, source: str) -> None:
    """Rotation by sidereal time, then five latitude passes, as chained fragments."""
    FRAGMENTS[f"{prefix}_turned"] = f"""
  SELECT s.*, cos(th) * x + sin(th) * y AS xe, -sin(th) * x + cos(th) * y AS ye
  FROM (SELECT *, radians({GMST.format(jd='jd')}) AS th
        FROM (SELECT *, {JD[0].format(t='requested_at')} + {JD[1].format(t='requested_at')} AS jd
              FROM {source})) s"""
    FRAGMENTS[f"{prefix}_pass0"] = f"""
  SELECT *, sqrt(xe * xe + ye * ye) AS p, atan2(z, sqrt(xe * xe + ye * ye) * (1 - {E2})) AS lat, 0::DOUBLE AS alt
  FROM {prefix}_turned"""
    for n in range(5):
        FRAGMENTS[f"{prefix}_pass{n + 1}"] = f"""
  SELECT * REPLACE (p * cos(lat) + z * sin(lat) - {A} * sqrt(1 - {E2} * sin(lat) ** 2) AS alt,
                    atan2(z, p - {E2} * n * cos(lat)) AS lat)
  FROM (SELECT * {'EXCLUDE (n)' if n else ''}, {A} / sqrt(1 - {E2} * sin(lat) ** 2) AS n FROM {prefix}_pass{n})"""
    FRAGMENTS[f"{prefix}_geo"] = f"""
  SELECT *, degrees(lat) AS latitude_deg,
         ((degrees(atan2(ye, xe)) + 180) % 360 + 360) % 360 - 180 AS longitude_deg, alt AS altitude_km
  FROM {prefix}_pass5"""
    FRAGMENTS[f"{prefix}_ecef"] = f"""
  SELECT norad_cat_id, nation_key, sequence, requested_at,
         (n + alt) * cos(lat) * cos(lon) AS sx, (n + alt) * cos(lat) * sin(lon) AS sy,
         (n * (1 - {E2}) + alt) * sin(lat) AS sz
  FROM (SELECT * REPLACE (radians(latitude_deg) AS lat), radians(longitude_deg) AS lon,
               {A} / sqrt(1 - {E2} * sin(radians(latitude_deg)) ** 2) AS n
        FROM (SELECT * EXCLUDE (n) FROM {prefix}_geo))"""
    FRAGMENTS[f"{prefix}_seen"] = f"""
  SELECT *, degrees(atan2(up, sqrt(east * east + north * north))) AS elevation_deg
  FROM (SELECT *, -sin(glon) * dx + cos(glon) * dy AS east,
               -sin(glat) * cos(glon) * dx - sin(glat) * sin(glon) * dy + cos(glat) * dz AS north,
               cos(glat) * cos(glon) * dx + cos(glat) * sin(glon) * dy + sin(glat) * dz AS up
        FROM (SELECT s.*, g.station, g.nation_key AS station_key, g.glat, g.glon,
                     s.sx - g.gx AS dx, s.sy - g.gy AS dy, s.sz - g.gz AS dz
              FROM {prefix}_ecef s CROSS JOIN ground g))"""
    FRAGMENTS[f"{prefix}_islands"] = f"""
  SELECT *, sequence - row_number() OVER (PARTITION BY norad_cat_id, station ORDER BY sequence) AS island
  FROM {prefix}_seen WHERE elevation_deg >= 10"""
    FRAGMENTS[f"{prefix}_windows"] = f"""
  SELECT norad_cat_id, station, min(requested_at) AS "start", max(requested_at) AS "end",
         arg_min(requested_at, (-elevation_deg, sequence)) AS peak_at,
         (epoch_us(max(requested_at)) - epoch_us(min(requested_at))) / 1e6 AS duration_seconds,
         max(elevation_deg) AS max_elevation_deg
  FROM {prefix}_islands GROUP BY norad_cat_id, station, island"""


FRAGMENTS["ground"] = f"""
  SELECT n_name AS station, n_nationkey AS nation_key, glat, glon, (n + h) * cos(glat) * cos(glon) AS gx,
         (n + h) * cos(glat) * sin(glon) AS gy, (n * (1 - {E2}) + h) * sin(glat) AS gz
  FROM (SELECT *, {A} / sqrt(1 - {E2} * sin(glat) ** 2) AS n
        FROM (SELECT *, radians(-84 + 7 * n_nationkey::DOUBLE) AS glat,
                     radians((37 * n_nationkey % 360 - 180)::DOUBLE) AS glon,
                     n_nationkey * 10 / 1000::DOUBLE AS h FROM nation))"""
_geodetic("circular", "circular_xyz")

_oracle(
    "time_grid",
    "SELECT s_suppkey AS norad_cat_id, sequence, requested_at FROM supplier CROSS JOIN minutes_grid",
)
_oracle(
    "track_grid",
    """
  SELECT s_suppkey AS norad_cat_id, i::INTEGER AS sequence,
         least(TIMESTAMP '2024-01-01' + to_minutes(i * 7), TIMESTAMP '2024-01-01 02:00:00') AS requested_at
  FROM supplier CROSS JOIN range(19) t(i)""",
)
_oracle(
    "gmst",
    f"""
  SELECT event_id, ts, jd AS julian_date, round({GMST.format(jd='jd')}, 6) AS gmst_deg
  FROM (SELECT *, floor(epoch_us(ts) / 8.64e10) + 2440587.5::DOUBLE
                  + epoch_us(ts) % 86400000000 / 1e6 / 86400::DOUBLE AS jd FROM events)""",
)
_oracle(
    "ephemeris_geodetic",
    """
  SELECT norad_cat_id, object_name, sequence, requested_at, round(x, 5) + 0.0 AS x_km, round(y, 5) + 0.0 AS y_km,
         round(z, 5) + 0.0 AS z_km, round(latitude_deg, 5) + 0.0 AS latitude_deg, round(longitude_deg, 5) + 0.0 AS longitude_deg,
         round(altitude_km, 5) AS altitude_km
  FROM circular_geo""",
)
_oracle(
    "station_elevation",
    """
  SELECT norad_cat_id, station, sequence, requested_at, round(elevation_deg, 5) AS elevation_deg
  FROM circular_seen WHERE nation_key = station_key""",
)
_oracle(
    "contact_windows",
    "SELECT * REPLACE (round(max_elevation_deg, 5) AS max_elevation_deg) FROM circular_windows",
)
_oracle(
    "contact_summary",
    """
  SELECT o.norad_cat_id, o.object_name, count(w.station) AS window_count,
         coalesce(sum(w.duration_seconds), 0) AS total_seconds,
         round(max(w.max_elevation_deg), 5) AS max_elevation_deg, min(w."start") AS first_start
  FROM orbits o LEFT JOIN circular_windows w USING (norad_cat_id) GROUP BY ALL""",
)

# --- elements and propagation -----------------------------------------------
FRAGMENTS["element_rows"] = f"""
  SELECT norad_cat_id, object_name, nation_key,
         strptime(printf('2023-12-31T%02d:%02d:30.250000', norad_cat_id % 24, norad_cat_id % 60),
                  '%Y-%m-%dT%H:%M:%S.%f')::TIMESTAMP AS epoch,
         round(rate * {86400 / (2 * pi)!r}::DOUBLE, 8) AS motion_day, inclination_deg,
         round((norad_cat_id * 7 % 400) / 10000::DOUBLE, 4) AS ecc,
         CASE WHEN norad_cat_id % 11 <> 0 OR norad_cat_id % 3 <> 0 THEN node_deg END AS node_deg,
         CASE WHEN norad_cat_id % 11 <> 0 OR norad_cat_id % 3 <> 1 THEN (norad_cat_id * 29 % 360)::DOUBLE END AS argp_deg,
         CASE WHEN norad_cat_id % 11 <> 0 OR norad_cat_id % 3 <> 2 THEN start_deg END AS mean_deg,
         CASE WHEN norad_cat_id % 5 <> 0 THEN round((norad_cat_id % 50) / 100000::DOUBLE, 5) ELSE 0 END AS bstar
  FROM orbits"""
_oracle(
    "element_readiness",
    f"""
  SELECT norad_cat_id, epoch,
         concat_ws(', ', CASE WHEN node_deg IS NULL THEN 'ra_of_asc_node' END,
                   CASE WHEN argp_deg IS NULL THEN 'arg_of_pericenter' END,
                   CASE WHEN mean_deg IS NULL THEN 'mean_anomaly' END) AS missing_elements,
         (node_deg IS NOT NULL AND argp_deg IS NOT NULL AND mean_deg IS NOT NULL) AS ready,
         round(motion_day * {2 * pi!r}::DOUBLE / 1440, 9) AS mean_motion,
         round(radians(inclination_deg), 9) AS inclination, ecc AS eccentricity,
         round(radians(node_deg), 9) AS ra_of_asc_node, round(radians(argp_deg), 9) AS arg_of_pericenter,
         round(radians(mean_deg), 9) AS mean_anomaly, bstar,
         0::DOUBLE AS mean_motion_dot, 0::DOUBLE AS mean_motion_ddot
  FROM element_rows""",
)

# Published SGP4 equations, satellite constants first, then one row per instant.
RE, XKE, J2, J3J2, J4 = (
    "6378.135::DOUBLE",
    f"{60.0 / (6378.135**3 / 398600.8) ** 0.5!r}::DOUBLE",
    "0.001082616::DOUBLE",
    "(-0.00000253881::DOUBLE / 0.001082616::DOUBLE)",
    "(-0.00000165597::DOUBLE)",
)
TURN = f"{2 * pi!r}::DOUBLE"


def _stages(prefix: str, source: str, stages: list[str]) -> str:
    """Chain ``SELECT *, <stage>`` fragments and return the last name."""
    previous = source
    for number, stage in enumerate(stages):
        FRAGMENTS[f"{prefix}{number}"] = f"SELECT *, {stage} FROM {previous}"
        previous = f"{prefix}{number}"
    return previous


FRAGMENTS["el_rad"] = f"""
  SELECT norad_cat_id, object_name, nation_key, epoch, ecc AS e0, bstar, radians(inclination_deg) AS inc,
         radians(node_deg) AS node0, radians(argp_deg) AS argp0, radians(mean_deg) AS m0,
         motion_day * {TURN} / 1440 AS nk,
         {JD[0].format(t='epoch')} + {JD[1].format(t='epoch')} - 2433281.5::DOUBLE AS epoch_days
  FROM element_rows WHERE node_deg IS NOT NULL AND argp_deg IS NOT NULL AND mean_deg IS NOT NULL"""
SGP4_CONSTANTS = _stages(
    "sgp_sat",
    "el_rad",
    [
        f"cos(inc) AS ci, sin(inc) AS si, cos(inc) ** 2 AS c2, 1 - e0 * e0 AS om, sqrt(1 - e0 * e0) AS rt, "
        f"pow({XKE} / nk, 2.0::DOUBLE / 3) AS ak",
        f"3 * c2 - 1 AS con41, 1 - c2 AS xm2, 7 * c2 - 1 AS x7, c2 * c2 AS c4, "
        f"0.75::DOUBLE * {J2} * (3 * c2 - 1) / (rt * om) AS d1",
        "d1 / (ak * ak) AS del0",
        "ak * (1 - del0 * del0 - del0 * (1::DOUBLE / 3 + 134 * del0 * del0 / 81)) AS adel",
        "nk / (1 + d1 / (adel * adel)) AS n0",
        f"pow({XKE} / n0, 2.0::DOUBLE / 3) AS ao",
        f"(ao * (1 - e0) - 1) * {RE} AS perigee",
        "CASE WHEN perigee < 98 THEN 20 WHEN perigee < 156 THEN perigee - 78 ELSE 78 END::DOUBLE AS skm",
        f"skm / {RE} + 1 AS s4, pow((120 - skm) / {RE}, 4) AS q4",
        "1 / (ao - s4) AS tsi",
        "ao * e0 * tsi AS eta",
        "eta * eta AS eta2, e0 * eta AS ee, abs(1 - eta * eta) AS psi, q4 * pow(tsi, 4) AS coef",
        "coef / pow(psi, 3.5::DOUBLE) AS coef1",
        f"""coef1 * n0 * (ao * (1 + 1.5::DOUBLE * eta2 + ee * (4 + eta2))
          + 0.375::DOUBLE * {J2} * tsi / psi * con41 * (8 + 3 * eta2 * (8 + eta2))) AS cc2,
        CASE WHEN e0 > 1e-4 THEN -2 * coef * tsi * {J3J2} * n0 * si / e0 ELSE 0 END AS cc3,
        2 * n0 * coef1 * ao * om * (eta * (2 + 0.5::DOUBLE * eta2) + e0 * (0.5::DOUBLE + 2 * eta2)
          - {J2} * tsi / (ao * psi) * (-3 * con41 * (1 - 2 * ee + eta2 * (1.5::DOUBLE - 0.5::DOUBLE * ee))
            + 0.75::DOUBLE * xm2 * (2 * eta2 - ee * (1 + eta2)) * cos(2 * argp0))) AS cc4,
        2 * coef1 * ao * om * (1 + 2.75::DOUBLE * (eta2 + ee) + ee * eta2) AS cc5,
        1 / pow(ao * om, 2) AS pinv""",
        f"bstar * cc2 AS cc1, 1.5::DOUBLE * {J2} * pinv * n0 AS k1, -0.46875::DOUBLE * {J4} * pinv * pinv * n0 AS k3",
        f"0.5::DOUBLE * k1 * {J2} * pinv AS k2, -k1 * ci AS nd1",
        """n0 + 0.5::DOUBLE * k1 * rt * con41 + 0.0625::DOUBLE * k2 * rt * (13 - 78 * c2 + 137 * c4) AS mdot,
        -0.5::DOUBLE * k1 * (1 - 5 * c2) + 0.0625::DOUBLE * k2 * (7 - 114 * c2 + 395 * c4)
          + k3 * (3 - 36 * c2 + 49 * c4) AS argpdot,
        nd1 + (0.5::DOUBLE * k2 * (4 - 19 * c2) + 2 * k3 * (3 - 7 * c2)) * ci AS nodedot,
        3.5::DOUBLE * om * nd1 * cc1 AS nodecf, bstar * cc3 * cos(argp0) AS omg,
        CASE WHEN e0 > 1e-4 THEN -2::DOUBLE / 3 * coef * bstar / ee ELSE 0 END AS xm,
        pow(1 + eta * cos(m0), 3) AS delmo, sin(m0) AS sinmo, 4 * ao * tsi * cc1 * cc1 AS d2""",
        "d2 * tsi * cc1 / 3 AS third",
        """(17 * ao + s4) * third AS d3, 0.5::DOUBLE * third * ao * tsi * (221 * ao + 31 * s4) * cc1 AS d4,
        d2 + 2 * cc1 * cc1 AS t3c""",
        """0.25::DOUBLE * (3 * d3 + cc1 * (12 * d2 + 10 * cc1 * cc1)) AS t4c,
        0.2::DOUBLE * (3 * d4 + 12 * cc1 * d3 + 6 * d2 * d2 + 15 * cc1 * cc1 * (2 * d2 + cc1 * cc1)) AS t5c""",
    ],
)
def _propagation(prefix: str, instants: str) -> None:
    """States of the element rows at joined instants ``g`` (sequence, requested_at)."""
    FRAGMENTS[f"{prefix}_grid"] = f"""
  SELECT c.*, g.sequence, g.requested_at,
         ({JD[0].format(t='g.requested_at')} - (floor(epoch_days) + 2433281.5::DOUBLE)) * 1440
           + ({JD[1].format(t='g.requested_at')} - (epoch_days - floor(epoch_days))) * 1440 AS t
  FROM {SGP4_CONSTANTS} c {instants}"""
    kepler = []
    for number in range(10):
        eo = "u" if number == 0 else f"eo{number - 1}"
        kepler.append(
            f"{eo} + greatest(-0.95::DOUBLE, least(0.95::DOUBLE, (u - ay * cos({eo}) + ax * sin({eo}) - {eo}) "
            f"/ (1 - cos({eo}) * ax - sin({eo}) * ay))) AS eo{number}"
        )
    last = _stages(
        f"{prefix}_at",
        f"{prefix}_grid",
        [
            "m0 + mdot * t AS xmdf, argp0 + argpdot * t AS argpdf, node0 + nodedot * t + nodecf * t * t AS node1",
            "CASE WHEN perigee >= 220 THEN omg * t + xm * (pow(1 + eta * cos(xmdf), 3) - delmo) ELSE 0 END AS shift",
            "xmdf + shift AS m1, argpdf - shift AS argp1",
            """1 - cc1 * t - CASE WHEN perigee >= 220 THEN t * t * (d2 + t * (d3 + t * d4)) ELSE 0 END AS ta,
        bstar * cc4 * t + CASE WHEN perigee >= 220 THEN bstar * cc5 * (sin(m1) - sinmo) ELSE 0 END AS te,
        1.5::DOUBLE * cc1 * t * t
          + CASE WHEN perigee >= 220 THEN t * t * t * (t3c + t * (t4c + t * t5c)) ELSE 0 END AS tl""",
            "ao * ta * ta AS am, e0 - te AS er",
            f"greatest(er, 1e-6::DOUBLE) AS em, {XKE} / pow(am, 1.5::DOUBLE) AS nm, "
            f"fmod(m1 + n0 * tl + argp1 + node1, {TURN}) AS xlm, fmod(node1, {TURN}) AS node2, fmod(argp1, {TURN}) AS argp2",
            f"fmod(xlm - argp2 - node2, {TURN}) AS m2, em * cos(argp2) AS ax, 1 / (am * (1 - em * em)) AS pw",
            f"em * sin(argp2) + pw * (-0.5::DOUBLE * {J3J2} * si) AS ay, "
            f"fmod(m2 + argp2 + pw * (-0.25::DOUBLE * {J3J2} * si * (3 + 5 * ci) / (1 + ci)) * ax, {TURN}) AS u",
            *kepler,
            "ax * cos(eo8) + ay * sin(eo8) AS ecose, ax * sin(eo8) - ay * cos(eo8) AS esine, ax * ax + ay * ay AS el2",
            "am * (1 - el2) AS pl, am * (1 - ecose) AS rl, sqrt(greatest(0, 1 - el2)) AS beta",
            "am / rl * (sin(eo8) - ay - ax * esine / (1 + beta)) AS sinu, "
            "am / rl * (cos(eo8) - ax + ay * esine / (1 + beta)) AS cosu, "
            f"0.5::DOUBLE * {J2} / pl AS q1, 0.5::DOUBLE * {J2} / (pl * pl) AS q2",
            "2 * cosu * sinu AS s2u, 1 - 2 * sinu * sinu AS c2u",
            f"""rl * (1 - 1.5::DOUBLE * q2 * beta * con41) + 0.5::DOUBLE * q1 * xm2 * c2u AS mr,
        atan2(sinu, cosu) - 0.25::DOUBLE * q2 * x7 * s2u AS su, node2 + 1.5::DOUBLE * q2 * ci * s2u AS xn,
        inc + 1.5::DOUBLE * q2 * ci * si * c2u AS xi,
        sqrt(am) * esine / rl - nm * q1 * xm2 * s2u / {XKE} AS mv,
        sqrt(greatest(0, pl)) / rl + nm * q1 * (xm2 * c2u + 1.5::DOUBLE * con41) / {XKE} AS rv""",
            """cos(xn) * cos(su) - sin(xn) * cos(xi) * sin(su) AS ux, sin(xn) * cos(su) + cos(xn) * cos(xi) * sin(su) AS uy,
        sin(xi) * sin(su) AS uz, -cos(xn) * sin(su) - sin(xn) * cos(xi) * cos(su) AS vx,
        cos(xn) * cos(xi) * cos(su) - sin(xn) * sin(su) AS vy, sin(xi) * cos(su) AS vz,
        CASE WHEN er >= 1 OR er < -0.001 THEN 'mean eccentricity is outside the range 0.0 to 1.0'
             WHEN pl < 0 THEN 'semilatus rectum has fallen below zero'
             WHEN mr < 1 THEN 'mrt is less than 1.0 which indicates the satellite has decayed'
             ELSE 'ok' END AS status""",
        ],
    )
    speed = f"({RE} * {XKE} / 60)"
    FRAGMENTS[f"{prefix}_xyz"] = f"""
  SELECT norad_cat_id, object_name, nation_key, epoch, sequence, requested_at, status,
         CASE WHEN status = 'ok' THEN mr * ux * {RE} END AS x, CASE WHEN status = 'ok' THEN mr * uy * {RE} END AS y,
         CASE WHEN status = 'ok' THEN mr * uz * {RE} END AS z,
         CASE WHEN status = 'ok' THEN (mv * ux + rv * vx) * {speed} END AS wx,
         CASE WHEN status = 'ok' THEN (mv * uy + rv * vy) * {speed} END AS wy,
         CASE WHEN status = 'ok' THEN (mv * uz + rv * vz) * {speed} END AS wz
  FROM {last}"""
    _geodetic(prefix, f"{prefix}_xyz")


_propagation("sgp", "CROSS JOIN minutes_grid g")
_propagation(
    "asked",
    "JOIN (SELECT user_id, event_id AS sequence, ts AS requested_at FROM events) g ON g.user_id = c.norad_cat_id",
)
_oracle(
    "requested_positions",
    """
  SELECT norad_cat_id, sequence AS request_id, requested_at, status,
         (epoch_us(requested_at) - epoch_us(epoch)) / 6e7 AS time_delta_minutes_from_epoch,
         round(x, 4) AS x_km, round(y, 4) AS y_km, round(z, 4) AS z_km,
         round(wx, 4) AS vx_km_s, round(wy, 4) AS vy_km_s, round(wz, 4) AS vz_km_s,
         round(latitude_deg, 4) AS latitude_deg, round(longitude_deg, 4) AS longitude_deg,
         round(altitude_km, 4) AS altitude_km
  FROM asked_geo""",
)
_oracle(
    "answered_requests",
    """
  SELECT e.user_id AS norad_cat_id, e.event_id AS request_id, e.ts AS requested_at,
         CASE WHEN r.norad_cat_id IS NULL THEN 'unknown_id'
              WHEN r.node_deg IS NULL OR r.argp_deg IS NULL OR r.mean_deg IS NULL THEN 'missing_elements'
              ELSE a.status END AS status,
         (epoch_us(a.requested_at) - epoch_us(a.epoch)) / 6e7 AS time_delta_minutes_from_epoch,
         round(x, 4) AS x_km, round(y, 4) AS y_km, round(z, 4) AS z_km,
         round(wx, 4) AS vx_km_s, round(wy, 4) AS vy_km_s, round(wz, 4) AS vz_km_s,
         round(latitude_deg, 4) AS latitude_deg, round(longitude_deg, 4) AS longitude_deg,
         round(altitude_km, 4) AS altitude_km
  FROM events e LEFT JOIN element_rows r ON r.norad_cat_id = e.user_id LEFT JOIN asked_geo a ON a.sequence = e.event_id""",
)
_oracle(
    "sgp4_ephemeris",
    """
  SELECT norad_cat_id, object_name, epoch AS source_epoch, requested_at, sequence,
         (epoch_us(requested_at) - epoch_us(epoch)) / 6e7 AS time_delta_minutes_from_epoch,
         round(x, 4) AS x_km, round(y, 4) AS y_km, round(z, 4) AS z_km,
         round(wx, 4) AS vx_km_s, round(wy, 4) AS vy_km_s, round(wz, 4) AS vz_km_s,
         round(latitude_deg, 4) AS latitude_deg, round(longitude_deg, 4) AS longitude_deg,
         round(altitude_km, 4) AS altitude_km,
         CASE WHEN (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(epoch)) / 3600e6 <= 72 THEN 'fresh' ELSE 'stale' END
           AS freshness_status,
         status, 'SGP4' AS propagator, 'TEME' AS coordinate_frame, true AS is_approximate
  FROM sgp_geo""",
)
_oracle(
    "sgp4_contact_windows",
    "SELECT * REPLACE (round(max_elevation_deg, 4) AS max_elevation_deg) FROM sgp_windows",
)

# --- arrays, codec, pages and checks ----------------------------------------
_oracle(
    "landed_array_items",
    """
  SELECT event_id, row_number() OVER (PARTITION BY event_id // 50000 ORDER BY event_id) - 1 AS record_position,
         id_text AS norad_cat_id, epoch_raw, motion_text AS mean_motion_raw, NULL::VARCHAR AS reject_reason
  FROM raw_records WHERE copy = 1""",
)
FRAGMENTS["canonical_rows"] = """
  SELECT event_id, copy,
         '{"ECCENTRICITY":"' || eccentricity_text || '"'
           || CASE WHEN epoch_raw IS NULL THEN '' ELSE ',"EPOCH":"' || epoch_raw || '"' END
           || ',"INCLINATION":' || inclination_text || ',"MEAN_MOTION":"' || motion_text
           || '","NORAD_CAT_ID":"' || id_text || '","OBJECT_ID":"' || object_id
           || '","OBJECT_NAME":"' || object_name || '"}' AS canonical_text
  FROM raw_records"""
_oracle(
    "canonical_records",
    """
  SELECT event_id, copy, canonical_text, sha256(canonical_text) AS digest, false AS drifts, NULL::VARCHAR AS reject_reason
  FROM canonical_rows""",
)
_oracle(
    "stored_row_round_trip",
    """
  SELECT event_id, copy,
         '{"name":"' || source_name || '","url":"' || source_url || '","type":"' || source_type || '"}' AS source_json,
         true AS same
  FROM (SELECT event_id, copy, """
    + SOURCE.format(p="source_")
    + """ FROM raw_records)""",
)
_oracle(
    "nested_windows",
    """
  SELECT norad_cat_id, station, page, count(*) AS "count", count(*) AS list_size, min("start") AS first_start,
         max("start") AS last_start, max("end") AS last_end
  FROM (SELECT *, (epoch_us("start") - epoch_us(TIMESTAMP '2024-01-01')) // 1800000000 AS page FROM circular_windows)
  GROUP BY norad_cat_id, station, page""",
)
_oracle(
    "station_quarantine",
    """
  SELECT station, status, count(*) OVER () AS row_count, count(*) FILTER (status = 'ok') OVER () AS kept_count,
         count(*) FILTER (status <> 'ok') OVER () AS rejected_count, true AS complete
  FROM (SELECT n_name AS station,
               CASE WHEN NOT (-84 + n_nationkey * 9 BETWEEN -90 AND 90) THEN 'latitude_deg_out_of_range'
                    WHEN n_nationkey % 11 = 5 OR NOT (n_nationkey * 37 % 400 - 180 BETWEEN -180 AND 180) THEN 'longitude_deg_out_of_range'
                    WHEN n_nationkey % 7 = 3 OR n_nationkey * 500 > 10000 THEN 'altitude_m_out_of_range'
                    ELSE 'ok' END AS status FROM nation)""",
)

# --- positions between given states -----------------------------------------
FRAGMENTS["asked"] = """
  SELECT e.event_id AS request_id, e.user_id AS norad_cat_id, epoch_us(e.ts) % 7260000000 AS us,
         TIMESTAMP '2024-01-01' + to_microseconds(epoch_us(e.ts) % 7260000000) AS requested_at, o.* EXCLUDE (norad_cat_id),
         o.norad_cat_id IS NOT NULL AS known,
         radians(o.node_deg) AS om, radians(o.inclination_deg) AS inc
  FROM events e LEFT JOIN orbits o ON o.norad_cat_id = e.user_id"""
FRAGMENTS["between"] = """
  SELECT *, us % 60000000 / 6e7 AS f, radians(start_deg) + rate * ((us // 60000000) * 60)::DOUBLE AS u0,
         radians(start_deg) + rate * ((us // 60000000 + 1) * 60)::DOUBLE AS u1
  FROM asked WHERE known AND us <= 7200000000"""
_PLACE = {
    "x": "radius_km * (cos(om) * cos({u}) - sin(om) * sin({u}) * cos(inc))",
    "y": "radius_km * (sin(om) * cos({u}) + cos(om) * sin({u}) * cos(inc))",
    "z": "radius_km * sin({u}) * sin(inc)",
}
_SPEED = {
    "x": "radius_km * rate * (-cos(om) * sin({u}) - sin(om) * cos({u}) * cos(inc))",
    "y": "radius_km * rate * (-sin(om) * sin({u}) + cos(om) * cos({u}) * cos(inc))",
    "z": "radius_km * rate * cos({u}) * sin(inc)",
}
_CUBIC = (
    "(2 * f ** 3 - 3 * f ** 2 + 1) * ({p0}) + (f ** 3 - 2 * f ** 2 + f) * 60 * ({v0})"
    " + (-2 * f ** 3 + 3 * f ** 2) * ({p1}) + (f ** 3 - f ** 2) * 60 * ({v1}) AS {a}"
)
FRAGMENTS["between_xyz"] = "SELECT *, " + ", ".join(
    _CUBIC.format(a=a, p0=_PLACE[a].format(u="u0"), v0=_SPEED[a].format(u="u0"), p1=_PLACE[a].format(u="u1"), v1=_SPEED[a].format(u="u1"))
    for a in "xyz"
) + " FROM between"
_geodetic("between", "between_xyz")
_oracle(
    "instant_positions",
    """
  SELECT a.norad_cat_id, a.request_id, a.requested_at,
         CASE WHEN g.request_id IS NOT NULL THEN TIMESTAMP '2024-01-01' - to_hours((a.norad_cat_id % 24)::INTEGER) END AS source_epoch,
         CASE WHEN NOT a.known THEN 'unknown_id' WHEN a.us > 7200000000 THEN 'outside_states' ELSE 'ok' END AS status,
         round(g.x, 3) + 0.0 AS x_km, round(g.y, 3) + 0.0 AS y_km, round(g.z, 3) + 0.0 AS z_km,
         round(g.latitude_deg, 4) + 0.0 AS latitude_deg, round(g.longitude_deg, 4) + 0.0 AS longitude_deg,
         round(g.altitude_km, 3) AS altitude_km,
         CASE WHEN g.request_id IS NOT NULL THEN (a.us + (a.norad_cat_id % 24) * 3600000000) / 6e7 END AS time_delta_minutes_from_epoch,
         'cubic between given states' AS propagator, 'TEME' AS coordinate_frame, true AS is_approximate,
         CASE WHEN g.request_id IS NOT NULL THEN true END AS within_a_metre
  FROM asked a LEFT JOIN between_geo g USING (request_id)""",
)
