"""Fixed schemas, domain constants and plan-time schema guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

STATION = "station_id"
TIME = "timestamp"
TARGET = "pm25"
LOCAL_TZ = "Asia/Ho_Chi_Minh"

# Canonical schemas.
AIR_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("station_id", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("pm25", T.DoubleType()),
        T.StructField("pm10", T.DoubleType()),
    ]
)
WEATHER_VARIABLES = (
    "temperature",
    "relative_humidity",
    "wind_speed",
    "wind_direction",
    "precipitation",
    "surface_pressure",
)
MEASUREMENT_SCHEMA = T.StructType(
    [
        T.StructField("location_id", T.StringType()),
        T.StructField("sensors_id", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("datetime", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("parameter", T.StringType()),
        T.StructField("units", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# Physical limits used when canonicalising raw weather.
CANONICAL_BOUNDS = {
    "temperature": (0.0, 50.0),
    "relative_humidity": (0.0, 100.0),
    "wind_speed": (0.0, 60.0),
    "wind_direction": (0.0, 360.0),
    "precipitation": (0.0, 300.0),
    "surface_pressure": (950.0, 1050.0),
}
# Limits used by the quality audit.
AUDIT_BOUNDS = {
    "temperature": (0.0, 50.0),
    "relative_humidity": (0.0, 100.0),
    "wind_speed": (0.0, 50.0),
    "wind_direction": (0.0, 360.0),
    "precipitation": (0.0, 200.0),
    "surface_pressure": (900.0, 1100.0),
    "pm25": (0.0, 1000.0),
    "pm10": (0.0, 1500.0),
}
# Provider units per weather variable.
EXPECTED_UNITS = {
    "temperature_2m": "°C",
    "relative_humidity_2m": "%",
    "wind_speed_10m": "m/s",
    "wind_direction_10m": "°",
    "precipitation": "mm",
    "surface_pressure": "hPa",
}
# Sentinels, markers, thresholds and windows.
SENTINELS = (-999.0, -9999.0)
DISGUISED_MARKERS = ("N/A", "n/a", "NA", "null", "NULL", "None", "none", "nan", "NaN", "", " ")
STUCK_HOURS = 6
LONG_GAP_HOURS = 6
HUMIDITY_LIMIT = 90.0
SUBSET_EPSILON = 2.0
ALERT_WINDOW = 24
ALERT_MIN_PERIODS = 24
ALERT_THRESHOLD = 50.0
MIN_DAY_HOURS = 18
ANNUAL_MIN_DAYS = 329
TIER_EDGES = (15.0, 25.0, 37.5, 50.0, 75.0)
TIER_LABELS = ("<15", "15-<25", "25-<37.5", "37.5-<50", "50-<75", ">=75")
ROLLING_WINDOWS = {24: 24, 168: 126}
ALPHA = 0.05
BLOCK_DAYS = 28
HAC_LAG = 28
SENSITIVITY_BLOCKS = (7, 14, 21, 28, 42)
MIN_WEEKDAYS = 3
MIN_WEEKEND_DAYS = 2
EARTH_RADIUS_KM = 6371.0088
VALID_UNITS = ("ug/m3", "µg/m3", "μg/m3", "ug/m^3", "µg/m^3", "μg/m^3")
VALID_DURATIONS = ("1 hr", "1h", "1 hour", "60 min", "60 mins")


def require(df: DataFrame, columns, context: str = "input") -> DataFrame:
    """Plan-time guard: raise when a column is absent; runs no job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{context}: missing columns {missing}")
    return df


def observation_key(df: DataFrame) -> list[str]:
    """Key of an observation table, chosen from its schema."""
    require(df, [TIME], "observation key")
    return [STATION, TIME] if STATION in df.columns else [TIME]


def require_named_zone(zone: str) -> str:
    """Accept a region zone such as Asia/Ho_Chi_Minh; refuse fixed offsets."""
    if "/" not in zone or zone.upper().startswith(("UTC", "GMT", "ETC/")):
        raise ValueError(f"zone must be a named region, got {zone!r}")
    return zone
