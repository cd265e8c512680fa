"""Views over the driver tables, once as DataFrames and once as SQL for the reference side.

The event stream stands for raw sensor readings (station = event type), orders
stand for a long daily record (station = order priority), nations for the
station dimension. Faults (outages, stuck values, sentinels, markers) are planted by
arithmetic on the event id and the hour, identically on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import clean, grid, panel

HOUR0 = 1704067200  # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def obs_raw(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("station_id"),
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("rh"),
    )


def _fault_columns(df: DataFrame) -> DataFrame:
    sno = (
        F.when(F.col("station_id") == "click", 0)
        .when(F.col("station_id") == "error", 1)
        .when(F.col("station_id") == "purchase", 2)
        .when(F.col("station_id") == "signup", 3)
        .otherwise(4)
    )
    return df.withColumn("sno", sno).withColumn(
        "hidx", F.floor((F.unix_seconds("ts") - HOUR0) / 3600)
    )


def obs_fault(spark, sf) -> DataFrame:
    df = _fault_columns(obs_raw(spark, sf))
    nine = F.floor(F.col("hidx") / 9)
    seq = F.col("seq")
    return df.filter(F.floor(F.col("hidx") / 31) % 5 != F.col("sno")).select(
        "seq",
        "ts",
        "station_id",
        "value",
        "rh",
        F.when(seq % 97 == 0, "N/A")
        .when(seq % 89 == 0, "-999")
        .when(seq % 83 == 0, "-1.5")
        .when(nine % 11 == F.col("sno"), (40 + nine % 7).cast("string"))
        .otherwise(F.col("value").cast("string"))
        .alias("raw_value"),
        F.when(seq % 79 == 0, F.col("value") * 0.5).otherwise(F.col("value") * 1.3).alias("pm10_raw"),
    )


def obs_clean(spark, sf) -> DataFrame:
    """Reading-level cleaned values."""
    return obs_fault(spark, sf).select(
        "seq",
        "ts",
        "station_id",
        F.date_trunc("hour", "ts").alias("timestamp"),
        fn.nonnegative(fn.undisguised("raw_value")).alias("pm25"),
        F.round("pm10_raw", 6).alias("pm10"),
        "rh",
    )


GAIN = 0.99991  # sensor gain; keeps hourly means off short decimals, where two engines round ties apart


def obs_hourly(spark, sf) -> DataFrame:
    means = clean.hourly_means(
        obs_clean(spark, sf), {"pm25": "pm25", "pm10": "pm10", "relative_humidity": "rh"}
    )
    return means.withColumns({c: F.round(F.col(c) / GAIN, 9) for c in ("pm25", "pm10")})


def obs_grid(spark, sf) -> DataFrame:
    return grid.hourly_grid(obs_hourly(spark, sf))


def weather_raw(spark, sf) -> DataFrame:
    seq, k, v = F.col("seq"), F.col("rh"), F.col("value")
    return obs_raw(spark, sf).select(
        "seq",
        F.date_trunc("hour", "ts").alias("timestamp"),
        (k * 0.6 - 2).alias("temperature"),
        (k * 1.02).alias("relative_humidity"),
        F.when(seq % 101 == 0, -1.0).otherwise(v / 10).alias("wind_speed"),
        F.when(seq % 53 == 0, -5.0)
        .otherwise(F.pmod(seq * 37, F.lit(400)).cast("double"))
        .alias("wind_direction"),
        F.when(seq % 50 == 0, v).otherwise(0.0).alias("precipitation"),
        (k * 1.2 + 940).alias("surface_pressure"),
    )


WEATHER = (
    "temperature",
    "relative_humidity",
    "wind_speed",
    "wind_direction",
    "precipitation",
    "surface_pressure",
)


def weather_hourly(spark, sf) -> DataFrame:
    cleaned = weather_raw(spark, sf).select(
        "timestamp", *[fn.within_weather_bounds(v, v).alias(v) for v in WEATHER]
    )
    return clean.hourly_means(cleaned, {v: v for v in WEATHER}, keys=())


def merged(spark, sf) -> DataFrame:
    """Dense air grid with the weather of the hour."""
    air = obs_grid(spark, sf).select("station_id", "timestamp", "pm25", "pm10")
    return air.join(weather_hourly(spark, sf), "timestamp", "left")


def daily_long(spark, sf) -> DataFrame:
    """Mean order value per day, from exact integer cents so that both engines hold the same double."""
    return (
        table(spark, sf, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("station_id"),
            F.col("o_orderdate").cast("date").alias("date"),
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
        )
        .select("station_id", "date", "n", (F.expr("cents div n") / F.lit(99991.0)).alias("v"))
    )


def daily_calendar(spark, sf) -> DataFrame:
    """Every day per station; value only where at least two orders were placed."""
    days = daily_long(spark, sf).select(
        "station_id", "date", F.when(F.col("n") >= 2, F.col("v")).alias("value")
    )
    return panel.dense_days(days, ["value"])


def station_dim(spark, sf) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("source_id"),
        F.concat(F.lit("ST"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("station_id"),
        F.concat_ws(" / ", "r_name", "n_name").alias("location"),
        (F.col("n_nationkey") * 3.7 - 40).alias("lat"),
        (F.col("n_nationkey") * 13.3 - 160).alias("lon"),
    )


# --- the same views as SQL ----------------------------------------------------

_OBS_RAW = """obs_raw AS (
  SELECT event_id AS seq, ts, event_type AS station_id, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS rh FROM events)"""
_OBS_FAULT = """obs_fault AS (
  SELECT seq, ts, station_id, value, rh,
    CASE WHEN seq % 97 = 0 THEN 'N/A' WHEN seq % 89 = 0 THEN '-999' WHEN seq % 83 = 0 THEN '-1.5'
         WHEN (hidx // 9) % 11 = sno THEN CAST(40 + (hidx // 9) % 7 AS VARCHAR)
         ELSE CAST(value AS VARCHAR) END AS raw_value,
    CASE WHEN seq % 79 = 0 THEN value * 0.5 ELSE value * 1.3 END AS pm10_raw
  FROM (SELECT *, CASE station_id WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                  WHEN 'signup' THEN 3 ELSE 4 END AS sno,
               date_diff('hour', TIMESTAMP '2024-01-01', ts) AS hidx FROM obs_raw)
  WHERE (hidx // 31) % 5 <> sno)"""
_OBS_CLEAN = """obs_clean AS (
  SELECT seq, ts, station_id, date_trunc('hour', ts)::TIMESTAMP AS timestamp,
    CASE WHEN TRY_CAST(raw_value AS DOUBLE) >= 0 THEN TRY_CAST(raw_value AS DOUBLE) END AS pm25,
    round(pm10_raw, 6) AS pm10, rh FROM obs_fault)"""
_OBS_HOURLY = """obs_hourly AS (
  SELECT station_id, timestamp, round(round(avg(pm25), 9) / 0.99991::DOUBLE, 9) AS pm25, round(round(avg(pm10), 9) / 0.99991::DOUBLE, 9) AS pm10,
         round(avg(rh), 9) AS relative_humidity
  FROM obs_clean GROUP BY ALL)"""
_OBS_GRID = """obs_grid AS (
  SELECT s.station_id, g.timestamp, o.pm25, o.pm10, o.relative_humidity
  FROM (SELECT DISTINCT station_id FROM obs_hourly) s
  CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp
              FROM (SELECT min(timestamp) lo, max(timestamp) hi FROM obs_hourly)) g
  LEFT JOIN obs_hourly o ON o.station_id = s.station_id AND o.timestamp = g.timestamp)"""
_WEATHER_RAW = """weather_raw AS (
  SELECT seq, date_trunc('hour', ts)::TIMESTAMP AS timestamp, rh * 0.6 - 2 AS temperature, rh * 1.02 AS relative_humidity,
    CASE WHEN seq % 101 = 0 THEN -1.0::DOUBLE ELSE value / 10 END AS wind_speed,
    CASE WHEN seq % 53 = 0 THEN -5.0::DOUBLE ELSE CAST((seq * 37) % 400 AS DOUBLE) END AS wind_direction,
    CASE WHEN seq % 50 = 0 THEN value ELSE 0.0 END AS precipitation, rh * 1.2 + 940 AS surface_pressure
  FROM obs_raw)"""
_WEATHER_HOURLY = """weather_hourly AS (
  SELECT timestamp,
    round(avg(CASE WHEN temperature BETWEEN 0 AND 50 THEN temperature END), 9) AS temperature,
    round(avg(CASE WHEN relative_humidity BETWEEN 0 AND 100 THEN relative_humidity END), 9) AS relative_humidity,
    round(avg(CASE WHEN wind_speed >= 0 THEN wind_speed END), 9) AS wind_speed,
    round(avg(CASE WHEN wind_direction < 0 THEN NULL WHEN wind_direction > 360 THEN wind_direction - 360
              ELSE wind_direction END), 9) AS wind_direction,
    round(avg(CASE WHEN precipitation >= 0 THEN precipitation END), 9) AS precipitation,
    round(avg(CASE WHEN surface_pressure BETWEEN 950 AND 1050 THEN surface_pressure END), 9) AS surface_pressure
  FROM weather_raw GROUP BY ALL)"""
_MERGED = """merged AS (
  SELECT a.station_id, a.timestamp, a.pm25, a.pm10, w.temperature, w.relative_humidity, w.wind_speed,
         w.wind_direction, w.precipitation, w.surface_pressure
  FROM obs_grid a LEFT JOIN weather_hourly w USING (timestamp))"""
_DAILY_LONG = """daily_long AS (
  SELECT o_orderpriority AS station_id, CAST(o_orderdate AS DATE) AS date, count(*) AS n,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS DOUBLE) / 99991.0::DOUBLE AS v FROM orders GROUP BY ALL)"""
_DAILY_CALENDAR = """daily_calendar AS (
  SELECT s.station_id, CAST(s.date AS DATE) AS date, CASE WHEN d.n >= 2 THEN d.v END AS value,
         date_diff('day', s.lo, CAST(s.date AS DATE)) AS pos
  FROM (SELECT station_id, lo, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS date
        FROM (SELECT station_id, min(date) AS lo, max(date) AS hi FROM daily_long GROUP BY ALL)) s
  LEFT JOIN daily_long d ON d.station_id = s.station_id AND d.date = CAST(s.date AS DATE))"""
_STATION_DIM = """station_dim AS (
  SELECT CAST(n_nationkey AS BIGINT) AS source_id, 'ST' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS station_id,
         r_name || ' / ' || n_name AS location, n_nationkey * 3.7::DOUBLE - 40 AS lat, n_nationkey * 13.3::DOUBLE - 160 AS lon
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

_CHAINS = {
    "obs_raw": [_OBS_RAW],
    "obs_fault": [_OBS_RAW, _OBS_FAULT],
    "obs_clean": [_OBS_RAW, _OBS_FAULT, _OBS_CLEAN],
    "obs_hourly": [_OBS_RAW, _OBS_FAULT, _OBS_CLEAN, _OBS_HOURLY],
    "obs_grid": [_OBS_RAW, _OBS_FAULT, _OBS_CLEAN, _OBS_HOURLY, _OBS_GRID],
    "weather_raw": [_OBS_RAW, _WEATHER_RAW],
    "weather_hourly": [_OBS_RAW, _WEATHER_RAW, _WEATHER_HOURLY],
    "merged": [
        _OBS_RAW, _OBS_FAULT, _OBS_CLEAN, _OBS_HOURLY, _OBS_GRID, _WEATHER_RAW, _WEATHER_HOURLY, _MERGED,
    ],
    "daily_long": [_DAILY_LONG],
    "daily_calendar": [_DAILY_LONG, _DAILY_CALENDAR],
    "station_dim": [_STATION_DIM],
}


def sql(views: str, body: str, *ctes: str) -> str:
    """Body preceded by the CTE chains of the named views (space separated) and extra CTEs."""
    chain: list[str] = []
    for v in views.split():
        for cte in _CHAINS[v]:
            if cte not in chain:
                chain.append(cte)
    chain += ctes
    return "WITH " + ",\n".join(chain) + "\n" + body.strip()
