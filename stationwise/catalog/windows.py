"""Trailing-window labels and features (inventory 2.6)."""

from pyspark.sql import functions as F

from ..operators import windows
from . import query, views as v
from .sequences import _SPLIT, split_grid

_W = "PARTITION BY station_id ORDER BY timestamp"


@query(
    "alert_label",
    v.sql(
        "obs_grid",
        f"""SELECT station_id, timestamp, n AS window_n, round(m, 6) AS window_mean, CASE WHEN n >= 18 THEN (round(m, 9) >= 50)::INT END AS alert FROM (SELECT station_id, timestamp, count(pm25) OVER w AS n, avg(pm25) OVER w AS m FROM obs_grid WINDOW w AS ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))""",
    ),
)
def _(spark, sf):
    return windows.alert_label(v.obs_grid(spark, sf), min_periods=18, threshold=50.0).select(
        "station_id", "timestamp", "window_n", "window_mean", "alert"
    )


@query(
    "causal_rolling",
    v.sql(
        "obs_grid",
        f"""SELECT station_id, timestamp, round(CASE WHEN count(pm25) OVER a >= 24 THEN avg(pm25) OVER a END, 6) AS rolling_24h, round(CASE WHEN count(pm25) OVER b >= 126 THEN avg(pm25) OVER b END, 6) AS rolling_168h FROM obs_grid
        WINDOW a AS ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), b AS ({_W} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)""",
    ),
)
def _(spark, sf):
    return windows.rolling_means(v.obs_grid(spark, sf)).select("station_id", "timestamp", "rolling_24h", "rolling_168h")


@query(
    "causal_rolling_instant",
    v.sql(
        "obs_clean",
        """SELECT station_id, seq, timestamp, round(CASE WHEN count(pm25) OVER w >= 24 THEN avg(pm25) OVER w END, 6) AS rolling_24h FROM (SELECT station_id, seq, ts AS timestamp, pm25 / 0.99991::DOUBLE AS pm25, epoch_us(ts) AS us FROM obs_clean)
        WINDOW w AS (PARTITION BY station_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""",
    ),
)
def _(spark, sf):
    raw = v.obs_clean(spark, sf).select("station_id", "seq", F.col("ts").alias("timestamp"), (F.col("pm25") / v.GAIN).alias("pm25"))
    return windows.rolling_means_exact(raw, 24, 24).drop("pm25")


@query(
    "past_only_features",
    v.sql(
        "obs_grid",
        f"""SELECT station_id, timestamp, n AS past_n, round(CASE WHEN n >= 18 THEN m END, 6) AS past_mean, round(CASE WHEN n >= 18 THEN s END, 6) AS past_sd, round(lag24, 6) AS lag_24h FROM (SELECT station_id, timestamp, count(pm25) OVER w AS n, avg(pm25) OVER w AS m, stddev_samp(pm25) OVER w AS s, lag(pm25, 24) OVER ({_W}) AS lag24 FROM obs_grid
        WINDOW w AS ({_W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))""",
    ),
)
def _(spark, sf):
    return windows.past_features(v.obs_grid(spark, sf), min_periods=18).select(
        "station_id", "timestamp", "past_n", "past_mean", "past_sd", "lag_24h"
    )


@query(
    "gap_safe_label",
    v.sql(
        "obs_grid",
        f"""SELECT l.station_id, l.timestamp, l.alert FROM (SELECT station_id, timestamp, CASE WHEN count(pm25) OVER w >= 18 THEN (round(avg(pm25) OVER w, 9) >= 50)::INT END AS alert FROM obs_grid WINDOW w AS ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) l
        SEMI JOIN obs_hourly h ON l.station_id = h.station_id AND l.timestamp = h.timestamp""",
    ),
)
def _(spark, sf):
    """Evaluated on the observed rows directly: hour-based frames make the dense detour unnecessary."""
    return windows.alert_label(v.obs_hourly(spark, sf), min_periods=18, threshold=50.0).select(
        "station_id", "timestamp", "alert"
    )


_CFG = [(24, 24, 50.0), (24, 18, 50.0), (24, 12, 50.0), (12, 9, 50.0), (48, 24, 45.0)]


def _sens_sql(part):
    return " UNION ALL ".join(
        f"""SELECT station_id, {w}::BIGINT AS "window", {k}::BIGINT AS min_periods, {t}::DOUBLE AS threshold, count(y) AS n_labelled, coalesce(sum(y), 0)::BIGINT AS n_positive, round(100.0 * sum(y) / nullif(count(y), 0), 6) AS prevalence_pct FROM (
        SELECT station_id, CASE WHEN count(pm25) OVER w >= {k} THEN (round(avg(pm25) OVER w, 9) >= {t})::INT END AS y FROM (SELECT *, {_SPLIT} FROM obs_grid) WINDOW w AS (PARTITION BY station_id{part} ORDER BY timestamp ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)) GROUP BY ALL"""
        for w, k, t in _CFG
    )


@query("label_sensitivity", v.sql("obs_grid", _sens_sql("")))
def _(spark, sf):
    return windows.label_sensitivity(v.obs_grid(spark, sf), _CFG)


@query("label_sensitivity_per_split", v.sql("obs_grid", _sens_sql(", split")))
def _(spark, sf):
    return windows.label_sensitivity(split_grid(spark, sf), _CFG, partition="split")
