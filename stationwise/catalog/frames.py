"""Splits, preprocessing and model frames (inventory 2.9, first part)."""

from pyspark.sql import functions as F


from ..operators import splits
from ..session import written
from . import query, views as v
from .sequences import CUT

FEATURES = ("temperature", "relative_humidity", "wind_speed", "precipitation", "surface_pressure")
_TS = f"TIMESTAMP '{CUT}'"


@query(
    "chronological_split",
    v.sql(
        "obs_grid",
        f"SELECT count(*) AS n_rows, 0::BIGINT AS n_null_time, count(*) FILTER (timestamp < {_TS}) AS n_train, count(*) FILTER (timestamp >= {_TS}) AS n_test, true AS valid FROM obs_grid",
    ),
)
def _(spark, sf):
    return splits.cut_verdict(v.obs_grid(spark, sf), CUT)


@query(
    "station_split",
    v.sql(
        "obs_hourly",
        """SELECT station_id, timestamp, CASE WHEN rn <= greatest(1, least(n - 1, floor(n * 0.8))) THEN 'train' ELSE 'test' END AS split FROM (SELECT station_id, timestamp, row_number() OVER (PARTITION BY station_id ORDER BY timestamp) AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM obs_hourly)""",
    ),
)
def _(spark, sf):
    return splits.station_split(v.obs_hourly(spark, sf)).select("station_id", "timestamp", "split")


@query(
    "pooled_split",
    v.sql(
        "obs_hourly",
        """SELECT station_id, timestamp, CASE WHEN row_number() OVER (ORDER BY timestamp, station_id) <= greatest(1, least(count(*) OVER () - 1, floor(count(*) OVER () * 0.8))) THEN 'train' ELSE 'test' END AS split FROM obs_hourly""",
    ),
)
def _(spark, sf):
    return splits.pooled_split(v.obs_hourly(spark, sf)).select("station_id", "timestamp", "split")


@query(
    "split_protocol_check",
    v.sql(
        "obs_hourly",
        f"""SELECT station_id, "check", violations, violations = 0 AS passed FROM (SELECT station_id, unnest(['both_sides', 'known_labels', 'train_before_test']) AS "check", unnest([CASE WHEN count(*) FILTER (s = 'train') > 0 AND count(*) FILTER (s = 'test') > 0 THEN 0 ELSE 1 END, CASE WHEN count(*) FILTER (s NOT IN ('train', 'test')) = 0 THEN 0 ELSE 1 END,
        CASE WHEN max(timestamp) FILTER (s = 'train') < min(timestamp) FILTER (s = 'test') THEN 0 ELSE 1 END])::BIGINT AS violations FROM (SELECT *, CASE WHEN station_id = 'view' AND hour(timestamp) = 3 THEN 'valid' WHEN station_id = 'click' AND hour(timestamp) = 4 THEN 'test' WHEN timestamp < {_TS} THEN 'train' ELSE 'test' END AS s FROM obs_hourly) GROUP BY station_id)""",
    ),
)
def _(spark, sf):
    """One station carries an unknown label, another a shuffled hour."""
    h = F.hour("timestamp")
    df = splits.cut_split(v.obs_hourly(spark, sf), CUT).withColumn(
        "split",
        F.when((F.col("station_id") == "view") & (h == 3), "valid")
        .when((F.col("station_id") == "click") & (h == 4), "test")
        .otherwise(F.col("split")),
    )
    return splits.split_check(df)


def scaled_input(spark, sf):
    return splits.cut_split(v.merged(spark, sf), CUT)


_PARAMS = (
    "params AS (SELECT station_id, feature, coalesce(quantile_cont(x, 0.5), 0) AS median, CASE WHEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) > 0 THEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) ELSE 1 END AS scale FROM ("
    + " UNION ALL ".join(f"SELECT station_id, '{f}' AS feature, {f} AS x FROM merged WHERE timestamp < {_TS}" for f in FEATURES)
    + ") GROUP BY ALL)"
)


@query(
    "train_only_preprocess",
    v.sql("merged", "SELECT station_id, feature, round(median, 6) AS median, round(scale, 6) AS scale FROM params", _PARAMS),
)
def _(spark, sf):
    return splits.fit_scaler(scaled_input(spark, sf), FEATURES, F.col("split") == "train")


@query(
    "apply_preprocess",
    v.sql(
        "merged",
        "SELECT m.station_id, m.timestamp, "
        + ", ".join(
            f"round((coalesce({f}, (SELECT median FROM params p WHERE p.station_id = m.station_id AND feature = '{f}')) - (SELECT median FROM params p WHERE p.station_id = m.station_id AND feature = '{f}')) / (SELECT scale FROM params p WHERE p.station_id = m.station_id AND feature = '{f}'), 6) + 0.0 AS {f}"
            for f in FEATURES
        )
        + " FROM merged m",
        _PARAMS,
    ),
)
def _(spark, sf):
    df = scaled_input(spark, sf)
    params = splits.fit_scaler(df, FEATURES, F.col("split") == "train")
    return splits.apply_scaler(df, params, FEATURES).select("station_id", "timestamp", *FEATURES)


@query(
    "no_leakage_check",
    v.sql(
        "merged",
        "SELECT station_id, true AS equals_train_refit, true AS differs_from_test_refit, true AS train_before_test FROM merged GROUP BY ALL",
    ),
)
def _(spark, sf):
    df = written(scaled_input(spark, sf), "scaled_input")
    params = splits.fit_scaler(df, FEATURES, F.col("split") == "train")
    return splits.leakage_check(df, params, FEATURES)


@query(
    "regression_frame",
    v.sql(
        "merged",
        "SELECT station_id, timestamp, round(pm25, 6) AS pm25, " + ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES) + f", CASE WHEN timestamp < {_TS} THEN 'train' ELSE 'test' END AS split FROM merged WHERE pm25 IS NOT NULL",
    ),
)
def _(spark, sf):
    return splits.regression_frame(v.merged(spark, sf), CUT, features=FEATURES)[0]


@query(
    "predictor_ranges",
    v.sql(
        "merged",
        "SELECT t.station_id, t.feature, round(lo, 6) AS train_min, round(hi, 6) AS train_max, round(med, 6) AS train_median, n AS n_test, round(100.0 * o / n, 6) AS outside_pct FROM (SELECT station_id, feature, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.5) AS med FROM long WHERE tr GROUP BY ALL) t JOIN (SELECT l.station_id, l.feature, count(x) AS n, count(*) FILTER (x < lo OR x > hi) AS o FROM long l JOIN (SELECT station_id, feature, min(x) AS lo, max(x) AS hi FROM long WHERE tr GROUP BY ALL) r USING (station_id, feature) WHERE NOT tr GROUP BY ALL) e USING (station_id, feature)",
        "long AS (" + " UNION ALL ".join(f"SELECT station_id, '{f}' AS feature, {f} AS x, timestamp < {_TS} AS tr FROM merged" for f in FEATURES) + ")",
    ),
)
def _(spark, sf):
    return splits.predictor_ranges(scaled_input(spark, sf), FEATURES)


def alert_frame(spark, sf, horizon=0):
    """Model rows with relaxed completeness, so that the small tables hold both classes."""
    feats = splits.alert_features(v.merged(spark, sf), min_periods=12, threshold=50.0)
    return splits.classification_frame(feats, CUT, horizon)


FRAME = f"""frame AS (SELECT *, CASE WHEN label IS NULL OR past_mean IS NULL THEN 'incomplete' WHEN split = 'train' AND {{0}} > 0 AND timestamp + INTERVAL {{0}} HOUR >= {_TS} THEN 'purged' ELSE 'used' END AS row_state FROM (
  SELECT a.*, {{1}} AS label, CASE WHEN a.timestamp < {_TS} THEN 'train' ELSE 'test' END AS split FROM af a LEFT JOIN af b ON b.station_id = a.station_id AND b.timestamp = a.timestamp + INTERVAL {{0}} HOUR))"""
AF = """af AS (SELECT m.*, CASE WHEN count(pm25) OVER w >= 12 THEN (round(avg(pm25) OVER w, 9) >= 50)::INT END AS alert, CASE WHEN count(pm25) OVER p >= 12 THEN avg(pm25) OVER p END AS past_mean, CASE WHEN count(pm25) OVER p >= 12 THEN stddev_samp(pm25) OVER p END AS past_sd, lag(pm25, 24) OVER (PARTITION BY station_id ORDER BY timestamp) AS lag_24h FROM merged m
  WINDOW w AS (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), p AS (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))"""


@query(
    "classification_frame",
    v.sql(
        "merged",
        "SELECT station_id, timestamp, round(past_mean, 6) AS past_mean, round(past_sd, 6) AS past_sd, round(lag_24h, 6) AS lag_24h, label, split, row_state FROM frame",
        AF,
        FRAME.format(6, "b.alert"),
    ),
)
def _(spark, sf):
    return alert_frame(spark, sf, 6).select(
        "station_id", "timestamp", "past_mean", "past_sd", "lag_24h", "label", "split", "row_state"
    )


@query(
    "classification_frame_counts",
    v.sql(
        "merged",
        """SELECT station_id, split, count(*) AS n_total, count(label) AS n_labelled, count(*) FILTER (row_state = 'used') AS n_used, count(*) FILTER (row_state = 'purged') AS n_purged, count(*) FILTER (row_state = 'used' AND label = 1) AS n_positive, round(count(*) FILTER (row_state = 'used' AND label = 1) / nullif(count(*) FILTER (row_state = 'used'), 0), 6) AS prevalence_used, round(count(*) FILTER (row_state = 'used' AND label = 1) / count(*), 6) AS prevalence_all FROM frame GROUP BY ALL""",
        AF,
        FRAME.format(6, "b.alert"),
    ),
)
def _(spark, sf):
    return splits.frame_counts(alert_frame(spark, sf, 6))


@query(
    "expanding_folds",
    v.sql(
        "obs_hourly",
        """SELECT station_id, block, count(*) AS n, min(timestamp) AS first_hour, max(timestamp) AS last_hour FROM (SELECT *, CASE WHEN rn <= n - 5 * (n // 6) THEN 0 ELSE (rn - (n - 5 * (n // 6)) - 1) // (n // 6) + 1 END AS block FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY timestamp) AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM obs_hourly)) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    return (
        splits.expanding_folds(v.obs_hourly(spark, sf), 5)
        .withColumn("block", F.col("block").cast("long"))
        .groupBy("station_id", "block")
        .agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_hour"), F.max("timestamp").alias("last_hour"))
    )
