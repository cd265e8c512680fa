"""Composite plans that chain the operators (inventory 2.9b)."""

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import quality, resample
from ..operators.stats import holm
from ..plans import cleaning, dataset, inference, suites
from ..schema import EXPECTED_UNITS
from ..session import scratch_path, written
from . import query, views as v
from .alerts import FEATURES as ALERT_FEATURES
from .alerts import model_frame
from .frames import FEATURES
from .inference import MU, days
from .linear import CALENDAR, model_table
from .panels import LABELLED, SEASON, labelled
from .quality import MEASURES, extended, six_dimension_sql
from .resampling import N_CI, N_NULL, SEED
from .sequences import RUNS
from .sources import export_archive, export_columnar

STATIONS = ["click", "error", "purchase", "signup", "view"]
#: All measures of merged().
MERGED = ("pm25", "pm10", *v.WEATHER)


def air_raw(spark, sf):
    """Reading-level air input with text values; several readings may share an hour."""
    return v.obs_fault(spark, sf).select(
        "seq",
        "station_id",
        F.date_trunc("hour", "ts").alias("timestamp"),
        F.col("raw_value").alias("pm25"),
        F.round("pm10_raw", 6).cast("string").alias("pm10"),
    )


AIR = """air AS (SELECT station_id, timestamp, CASE WHEN coalesce(a > b, false) THEN NULL ELSE a END AS pm25, CASE WHEN coalesce(a > b, false) THEN NULL ELSE b END AS pm10 FROM (
  SELECT station_id, timestamp, CASE WHEN TRY_CAST(raw_value AS DOUBLE) >= 0 THEN TRY_CAST(raw_value AS DOUBLE) END AS a, round(pm10_raw, 6) AS b FROM (
    SELECT *, date_trunc('hour', ts)::TIMESTAMP AS timestamp, row_number() OVER (PARTITION BY station_id, date_trunc('hour', ts) ORDER BY seq) AS rn FROM obs_fault) WHERE rn = 1))"""
AIRGRID = """airgrid AS (SELECT s.station_id, g.timestamp, a.pm25, a.pm10 FROM (SELECT DISTINCT station_id FROM air) s CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp FROM (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM air)) g LEFT JOIN air a ON a.station_id = s.station_id AND a.timestamp = g.timestamp)"""
WFIRST = """wclean AS (SELECT g.timestamp, w.* EXCLUDE (timestamp) FROM (SELECT unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp FROM weather_raw) g LEFT JOIN (
  SELECT timestamp, CASE WHEN temperature BETWEEN 0 AND 50 THEN temperature END AS temperature, CASE WHEN relative_humidity BETWEEN 0 AND 100 THEN relative_humidity END AS relative_humidity, CASE WHEN wind_speed >= 0 THEN wind_speed END AS wind_speed,
    CASE WHEN wind_direction < 0 THEN NULL WHEN wind_direction > 360 THEN wind_direction - 360 ELSE wind_direction END AS wind_direction, CASE WHEN precipitation >= 0 THEN precipitation END AS precipitation, CASE WHEN surface_pressure BETWEEN 950 AND 1050 THEN surface_pressure END AS surface_pressure
  FROM (SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY seq) AS rn FROM weather_raw) WHERE rn = 1) w USING (timestamp))"""
UNSTUCK = "unstuck AS (SELECT g.station_id, g.timestamp, g.pm10, CASE WHEN g.pm25 IS NOT NULL AND r.len > 6 THEN 1 ELSE 0 END AS is_stuck, CASE WHEN r.len > 6 THEN NULL ELSE g.pm25 END AS pm25 FROM airgrid g JOIN runs_s r ON r.station_id = g.station_id AND g.timestamp BETWEEN r.run_start AND r.run_end)"
CLEANED = "cleaned AS (SELECT u.station_id, u.timestamp, u.pm25, u.pm10, u.is_stuck, CASE WHEN r.state AND r.len > 6 THEN 1 ELSE 0 END AS is_long_gap, CASE WHEN w.relative_humidity > 90 THEN 1 ELSE 0 END AS is_high_humidity, w.relative_humidity FROM unstuck u JOIN runs_g r ON r.station_id = u.station_id AND u.timestamp BETWEEN r.run_start AND r.run_end LEFT JOIN wclean w ON w.timestamp = u.timestamp)"
_CHAIN = (AIR, AIRGRID, WFIRST, RUNS.format("pm25", "s", "airgrid"), UNSTUCK, RUNS.format("pm25 IS NULL", "g", "unstuck"), CLEANED)
_VIEWS = "obs_fault weather_raw"


def _clean_air(spark, sf):
    weather = cleaning.clean_weather(v.weather_raw(spark, sf), "seq")
    return cleaning.clean_air(air_raw(spark, sf), weather, "seq")


@query(
    "clean_air",
    v.sql(_VIEWS, "SELECT station_id, timestamp, round(pm25, 6) AS pm25, round(pm10, 6) AS pm10, is_stuck, is_long_gap, is_high_humidity FROM cleaned", *_CHAIN),
)
def _(spark, sf):
    return _clean_air(spark, sf)


@query(
    "clean_air_steps",
    v.sql(
        _VIEWS,
        """SELECT c.*, i.n_input, i.n_keys, i.n_input - i.n_keys AS n_duplicates, c.n_grid - i.n_keys AS n_inserted FROM (SELECT station_id, count(*) AS n_grid, count(pm25) AS n_observed, sum(is_stuck)::BIGINT AS n_stuck, sum(is_long_gap)::BIGINT AS n_long_gap, sum(is_high_humidity)::BIGINT AS n_high_humidity FROM cleaned GROUP BY ALL) c
        JOIN (SELECT station_id, count(*) AS n_input, count(DISTINCT date_trunc('hour', ts)) AS n_keys FROM obs_fault GROUP BY ALL) i USING (station_id)""",
        *_CHAIN,
    ),
)
def _(spark, sf):
    return cleaning.air_step_counts(air_raw(spark, sf), _clean_air(spark, sf), "seq")


@query(
    "no_imputation_proof",
    v.sql(
        _VIEWS,
        """SELECT "column", 0::BIGINT AS fabricated, count(*) FILTER (o IS NOT NULL AND w IS NULL) AS lost, 0::BIGINT AS mutated, count(*) FILTER (w IS NOT NULL) AS unchanged FROM (
        SELECT unnest(['pm25', 'pm10']) AS "column", unnest([TRY_CAST(f.raw_value AS DOUBLE), round(f.pm10_raw, 6)]) AS o, unnest([c.pm25, c.pm10]) AS w FROM cleaned c LEFT JOIN (SELECT *, date_trunc('hour', ts)::TIMESTAMP AS hr, row_number() OVER (PARTITION BY station_id, date_trunc('hour', ts) ORDER BY seq) AS rn FROM obs_fault) f ON f.station_id = c.station_id AND f.hr = c.timestamp AND f.rn = 1) GROUP BY ALL""",
        *_CHAIN,
    ),
)
def _(spark, sf):
    return cleaning.imputation_proof(air_raw(spark, sf), _clean_air(spark, sf), "seq")


@query(
    "clean_weather",
    v.sql("weather_raw", "SELECT timestamp, " + ", ".join(f"round({c}, 6) AS {c}" for c in v.WEATHER) + " FROM wclean", WFIRST),
)
def _(spark, sf):
    return cleaning.clean_weather(v.weather_raw(spark, sf), "seq")


@query(
    "deterministic_cleaning",
    v.sql(
        _VIEWS,
        """SELECT station_id, unnest(['no_duplicate_keys', 'hourly_step', 'pm25_nonnegative', 'pm10_nonnegative', 'fine_not_above_coarse', 'timestamp_present']) AS "check", 0::BIGINT AS violations, true AS passed FROM cleaned GROUP BY station_id
        UNION ALL SELECT 'ALL', unnest(['no_imputation_pm25', 'no_imputation_pm10', 'frozen_rows']), unnest([0, 0, count(*)]), true FROM cleaned""",
        *_CHAIN,
    ),
)
def _(spark, sf):
    return cleaning.deterministic_cleaning(air_raw(spark, sf), v.weather_raw(spark, sf), "seq", scratch_path(spark, "cleaned"))


@query(
    "quality_audit",
    v.sql(
        "obs_grid",
        """SELECT 'gaps' AS section, station_id, unnest(['n_gaps', 'longest_gap', 'n_isolated']) AS metric, unnest([count(*), max(len), count(*) FILTER (len = 1)])::DOUBLE AS value FROM runs_m WHERE state GROUP BY station_id
        UNION ALL SELECT 'joint_missing', station_id, unnest(['both_missing', 'only_target_missing', 'only_other_missing']), unnest([count(*) FILTER (pm25 IS NULL AND pm10 IS NULL), count(*) FILTER (pm25 IS NULL AND pm10 IS NOT NULL), count(*) FILTER (pm25 IS NOT NULL AND pm10 IS NULL)])::DOUBLE FROM obs_grid GROUP BY station_id
        UNION ALL SELECT 'uniqueness_detail', 'ALL', unnest(['n_duplicate_rows', 'duplicate_pct']), unnest([0.0, 0.0])
        UNION ALL SELECT dimension, 'ALL', metric, value FROM six""",
        *six_dimension_sql("obs_grid")[1:],
        f"six AS ({six_dimension_sql('obs_grid')[0]})",
        RUNS.format("pm25 IS NULL", "m", "obs_grid"),
    ),
)
def _(spark, sf):
    return cleaning.quality_audit(v.obs_grid(spark, sf), MEASURES)


@query(
    "collection",
    v.sql(
        "obs_raw weather_hourly",
        """SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM w) AS n_right, count(*) AS n_overlap, round(100.0 * count(DISTINCT timestamp) / (SELECT count(DISTINCT timestamp) FROM a), 6) AS overlap_pct, count(*) > greatest((SELECT count(*) FROM a), (SELECT count(*) FROM w)) AS row_explosion, round(100.0 - 100.0 * count(temperature) / count(*), 6) AS missing_pct_temperature FROM a JOIN w USING (timestamp)""",
        "a AS (SELECT DISTINCT station_id, date_trunc('hour', ts + INTERVAL 7 HOUR)::TIMESTAMP AS timestamp FROM obs_raw)",
        "w AS (SELECT timestamp + INTERVAL 7 HOUR AS timestamp, temperature FROM weather_hourly)",
    ),
)
def _(spark, sf):
    air = dataset.collect_air(spark, export_archive(spark, sf), [2024], (20.0, 104.0, 22.0, 106.0), ["pm25", "rh"])
    names = dict(zip(EXPECTED_UNITS, v.WEATHER))
    weather = dataset.collect_weather(spark, export_columnar(spark, sf), EXPECTED_UNITS, names, multi_line=False)
    return dataset.collection(air, weather, ["temperature"])


@query(
    "flag_frame",
    v.sql(
        _VIEWS,
        f"SELECT station_id, timestamp, round(pm25, 6) AS pm25, round(relative_humidity, 6) AS relative_humidity, CASE WHEN relative_humidity > 60 THEN 1 ELSE 0 END AS flag, {SEASON.format('timestamp')} AS season FROM cleaned",
        *_CHAIN,
    ),
)
def _(spark, sf):
    return cleaning.flag_frame(air_raw(spark, sf), v.weather_raw(spark, sf), "seq", 60.0)


_EXT = """ext AS (SELECT *, CASE WHEN pm25 IS NOT NULL THEN pm25 WHEN p1 - p0 - 1 <= 2 THEN v0 + (v1 - v0) * ((h - p0) / (p1 - p0)) END AS pm25_derived FROM (
  SELECT *, last_value(pm25 IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN pm25 IS NOT NULL THEN h END IGNORE NULLS) OVER b AS p0, first_value(pm25 IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN pm25 IS NOT NULL THEN h END IGNORE NULLS) OVER f AS p1 FROM (
    SELECT *, epoch(timestamp) / 3600.0 AS h, CASE WHEN row_number() OVER (PARTITION BY station_id ORDER BY timestamp) <= floor(count(*) OVER (PARTITION BY station_id) * 0.8) THEN 'train' ELSE 'test' END AS split FROM merged)
  WINDOW b AS (PARTITION BY station_id, split ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY station_id, split ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)))"""


@query(
    "extended_dataset",
    v.sql(
        "merged",
        f"""SELECT station_id, timestamp, split, round(pm25, 6) AS pm25, round(pm25_derived, 6) AS pm25_derived, pm25 IS NULL AND pm25_derived IS NOT NULL AS is_derived, round(temperature, 6) AS temperature, round(sin(2 * pi() * hour(timestamp) / 24), 6) + 0.0 AS hour_sin, {SEASON.format('timestamp')} AS season, CASE WHEN month(timestamp) IN (12, 1, 2) THEN year(timestamp) + (month(timestamp) = 12)::INT END AS winter_year FROM ext""",
        _EXT,
    ),
)
def _(spark, sf):
    air = v.obs_grid(spark, sf).select("station_id", "timestamp", "pm25", "pm10")
    full = dataset.extended_dataset(air, v.weather_hourly(spark, sf))
    return full.select(
        "station_id", "timestamp", "split", "pm25", "pm25_derived", "is_derived", "temperature", "hour_sin", "season",
        F.col("winter_year").cast("long").alias("winter_year"),
    )


@query("reanalysis")
def _(spark, sf):
    ext = written(extended(spark, sf), "extended")
    return dataset.reanalysis(v.merged(spark, sf), days(spark, sf), MERGED, MU, 250.0, N_NULL, SEED, ext, N_CI)


@query("regression_suite")
def _(spark, sf):
    every = [*FEATURES, *CALENDAR]
    sets = {"mean": [], "full": every, "no_calendar": list(FEATURES), "weather_pair": ["temperature", "wind_speed"], "with_lag": [*every, "lag_24h"]}
    table = written(model_table(spark, sf), "model_table")
    derived = extended(spark, sf).select("station_id", "timestamp", "pm25_derived")
    table = written(table.drop("pm25_derived").join(derived, ["station_id", "timestamp"], "left"), "with_derived")
    return suites.regression_suite(table, "pm25", every, sets, "pm25_derived", ["wind_speed", "precipitation", "temperature"])


@query("alert_suite")
def _(spark, sf):
    return suites.alert_suite(
        model_frame(spark, sf), ALERT_FEATURES, {"first": ["click"], "second": ["view"], "pooled": STATIONS}
    )


@query(
    "population_report",
    v.sql(
        "obs_grid",
        """SELECT station_id, kind || '/' || stratum AS item, split, count(*) FILTER (alert IS NOT NULL AND has_past) AS n, count(*) FILTER (alert = 1 AND has_past) AS positives FROM (SELECT *, unnest(['year', 'season', 'month']) AS kind, unnest([year(timestamp)::VARCHAR, season, strftime(timestamp, '%Y-%m')]) AS stratum FROM lab) GROUP BY station_id, kind, stratum, split
        UNION ALL SELECT station_id, unnest(['all', 'observed', 'labelled', 'evaluable']), split, unnest([count(*), count(pm25), count(alert), count(*) FILTER (alert IS NOT NULL AND has_past)]), unnest([count(*) FILTER (alert = 1), count(*) FILTER (alert = 1 AND pm25 IS NOT NULL), count(*) FILTER (alert = 1), count(*) FILTER (alert = 1 AND has_past)]) FROM lab GROUP BY station_id, split""",
        LABELLED,
    ),
)
def _(spark, sf):
    return suites.population_report(labelled(spark, sf))


@query("revalidate")
def _(spark, sf):
    """Quality rows, a test family and bootstrap intervals, each checked by another path."""
    ext = written(extended(spark, sf), "extended")
    gaps = written(quality.period_gaps(ext), "period_gaps")
    published = written(quality.period_quality_table(ext, gaps=gaps), "published")
    calendar = written(days(spark, sf), "calendar")
    tests = written(inference.weekday_effect(calendar, N_NULL, SEED), "tests")
    reported = written(resample.compact_mean_report(calendar, N_NULL, S.SENSITIVITY_BLOCKS, SEED), "reported")
    recheck = inference.inference_recheck(reported, calendar, N_NULL, S.SENSITIVITY_BLOCKS, SEED)
    results = tests.select(
        F.lit("weekday").alias("family"), F.col("station_id").alias("test"), "estimate", "ci_low", "ci_high", F.col("p_value").alias("p")
    )
    adjusted = holm(results, ["family"], "p", "test")
    return dataset.revalidate(ext, STATIONS, published, adjusted.withColumn("rejected", F.col("holm_p") < 0.05), recheck)
