"""Names, thresholds, texts and physical constants that decide results."""

# --- source lineage ---------------------------------------------------------
SOURCE_NAME = "CelesTrak GP active"
SOURCE_URL = "https://celestrak.org/NORAD/elements/gp.php?GROUP=active&FORMAT=json"
SOURCE_TYPE = "real_public_orbit_data"

# --- catalog labels ---------------------------------------------------------
FRESH_WITHIN_HOURS = 72.0
REUSE_WITHIN_HOURS = 2.0
UNNAMED_OBJECT = "UNKNOWN"

# --- request domains --------------------------------------------------------
LATITUDE_DEG = (-90.0, 90.0)
LONGITUDE_DEG = (-180.0, 180.0)
ALTITUDE_M = (-500.0, 10000.0)
ELEVATION_DEG = (0.0, 90.0)
CONTACT_STEP_SECONDS = (10, 600)
TRACK_STEP_SECONDS = (10, 3600)
TELEMETRY_STEP_SECONDS = (1, 3600)
TELEMETRY_MINUTES = (1, 1440)
RUN_LIST_LIMIT = (1, 100)
MAX_TRACK_POINTS = 360
SEARCH_LIMIT = 80
RUN_LIST_DEFAULT = 20
DEFAULT_MIN_ELEVATION_DEG = 10.0

# --- earth models: WGS84 for geodesy, WGS72 for propagation -----------------
EARTH_RADIUS_KM = 6378.137
EARTH_FLATTENING = 1 / 298.257223563
SGP4_MU = 398600.8
SGP4_RADIUS_KM = 6378.135
SGP4_J2 = 0.001082616
SGP4_J3 = -0.00000253881
SGP4_J4 = -0.00000165597
GEODETIC_PASSES = 5

# --- operating policies -----------------------------------------------------
# (policy, metric, worse direction, warning, critical, samples required)
POLICY_THRESHOLDS = [
    ("conservative_ops", "battery_temperature_c", "high", 31.0, 42.0, 1),
    ("conservative_ops", "bus_voltage_v", "low", 27.2, 26.2, 1),
    ("conservative_ops", "downlink_margin_db", "low", 5.5, 3.0, 1),
    ("balanced_ops", "battery_temperature_c", "high", 36.0, 48.0, 2),
    ("balanced_ops", "bus_voltage_v", "low", 26.7, 25.8, 2),
    ("balanced_ops", "downlink_margin_db", "low", 4.5, 2.2, 2),
    ("relaxed_ops", "battery_temperature_c", "high", 44.0, 56.0, 3),
    ("relaxed_ops", "bus_voltage_v", "low", 26.0, 25.2, 3),
    ("relaxed_ops", "downlink_margin_db", "low", 3.2, 1.4, 3),
]
# policy -> (recommended action, notes)
POLICY_GUIDANCE = {
    "conservative_ops": (
        "Start immediate subsystem triage and prepare mitigation review.",
        "Lower thresholds and single-sample persistence; catches weak signals early with more noise.",
    ),
    "balanced_ops": (
        "Validate trend, compare against contact plan, and assign focused subsystem check.",
        "Requires short persistence before escalation to balance sensitivity and alert fatigue.",
    ),
    "relaxed_ops": (
        "Monitor for sustained degradation before interrupting the nominal plan.",
        "Higher thresholds and longer persistence; fewer alerts but later operator visibility.",
    ),
}
STATUS_POLICY = "balanced_ops"
DEFAULT_SCENARIO = "nominal"

# --- alert texts ------------------------------------------------------------
SUBSYSTEM_CHECKS = {
    "thermal": "Review thermal trend, payload duty cycle, and recent eclipse/contact context.",
    "power": "Compare bus voltage trend with payload load and expected sunlight/eclipse period.",
    "communications": "Check next contact geometry, downlink margin assumptions, and antenna pointing context.",
}
OTHER_SUBSYSTEM_CHECK = "Review subsystem trend and recent scenario context."
EVENT_ID_FORMAT = "SIM-%d-%s-%s-%03d"
EVENT_SUMMARY_FORMAT = "%s simulated %s event: %s reached %s."
QUIET_RUNBOOK_FORMAT = (
    "No warning or critical events were generated from simulated spacecraft telemetry for "
    "scenario '%s' under %s. Continue nominal review; this is not live spacecraft telemetry."
)
RUNBOOK_FORMAT = (
    "Simulated spacecraft telemetry for scenario '%s' produced %d event(s) "
    "under %s; first affected subsystem is %s at %s. "
    "Critical events: %d. Recommended action: %s"
)

# --- provenance -------------------------------------------------------------
PROPAGATOR = "SGP4"
COORDINATE_FRAME = "TEME"
TRACK_MODE = "approximate_3d_orbit_playback"
