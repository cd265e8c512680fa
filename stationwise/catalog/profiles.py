"""Descriptive profiles, correlations, densities (inventory 2.5, second part)."""

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import profile, windows
from . import query, views as v

VARS = ("pm25", "pm10", "temperature", "relative_humidity", "wind_speed", "wind_direction")
Q = {"p10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _profile_sql(c):
    ang = c == "wind_direction"
    circ = (
        f"""round((degrees(atan2(avg(sin(radians({c}))), avg(cos(radians({c}))))) + 360) % 360, 6) AS circular_mean, round(degrees(sqrt(-2 * ln(sqrt(power(avg(sin(radians({c}))), 2) + power(avg(cos(radians({c}))), 2))))), 6) AS circular_sd,
        round(sqrt(power(avg(sin(radians({c}))), 2) + power(avg(cos(radians({c}))), 2)), 6) AS resultant"""
        if ang
        else "NULL::DOUBLE AS circular_mean, NULL::DOUBLE AS circular_sd, NULL::DOUBLE AS resultant"
    )
    qs = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {n}" for n, p in Q.items())
    return f"""SELECT b.*, m.mode FROM (SELECT station_id, '{c}' AS variable, count(*) AS n_rows, count({c}) AS n, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct, round(avg({c}), 6) AS mean, round(var_samp({c}), 6) AS variance, round(stddev_samp({c}), 6) AS sd,
    round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis, {circ}, {qs}, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr, round(max({c}) - min({c}), 6) AS range FROM merged GROUP BY ALL) b
    LEFT JOIN (SELECT station_id, CASE WHEN count(*) = 1 THEN round(max(x), 6) END AS mode FROM (SELECT station_id, {c} AS x, count(*) AS k, max(count(*)) OVER (PARTITION BY station_id) AS mk FROM merged WHERE {c} IS NOT NULL GROUP BY 1, 2) WHERE k = mk GROUP BY ALL) m USING (station_id)"""


@query("statistical_profile", v.sql("merged", " UNION ALL ".join(_profile_sql(c) for c in VARS)))
def _(spark, sf):
    return profile.statistical_profile(v.merged(spark, sf), ["station_id"], VARS)


_LEVELS = {
    "hour": "hour(timestamp)::VARCHAR",
    "dow": "(isodow(timestamp) - 1)::VARCHAR",
    "weekend": "(isodow(timestamp) >= 6)::INT::VARCHAR",
    "month": "month(timestamp)::VARCHAR",
}
_STATS = (
    "SELECT station_id, level, key, count(pm25) AS n, round(avg(pm25), 6) AS mean, round(quantile_cont(pm25, 0.25), 6) AS q25, round(quantile_cont(pm25, 0.5), 6) AS median, round(quantile_cont(pm25, 0.75), 6) AS q75, round(quantile_cont(pm25, 0.9), 6) AS p90, round(quantile_cont(pm25, 0.95), 6) AS p95, round(quantile_cont(pm25, 0.75) - quantile_cont(pm25, 0.25), 6) AS iqr FROM ("
    + " UNION ALL ".join(f"SELECT station_id, '{n}' AS level, {e} AS key, pm25 FROM obs_grid" for n, e in _LEVELS.items())
    + ") GROUP BY ALL"
)


def _group_stats(spark, sf):
    return profile.group_stats(
        v.obs_grid(spark, sf),
        {
            "hour": F.hour("timestamp"),
            "dow": F.weekday("timestamp"),
            "weekend": (F.weekday("timestamp") >= 5).cast("int"),
            "month": F.month("timestamp"),
        },
    )


@query("group_stats", v.sql("obs_grid", _STATS))
def _(spark, sf):
    return _group_stats(spark, sf)


@query(
    "extreme_groups",
    v.sql(
        "obs_grid",
        """SELECT station_id, level, arg_max(key, (median, key)) FILTER (median IS NOT NULL) AS highest_key, max(median) AS highest, arg_min(key, (median, key)) FILTER (median IS NOT NULL) AS lowest_key, min(median) AS lowest FROM gs GROUP BY ALL""",
        f"gs AS ({_STATS})",
    ),
)
def _(spark, sf):
    return profile.extreme_groups(_group_stats(spark, sf), "median")


_HOURS = ", ".join(f"round(avg(pm25) FILTER (hour(timestamp) = {h}), 6) AS h{h:02d}" for h in range(24))


@query(
    "hour_dow_pivot",
    v.sql("obs_grid", f"SELECT station_id, (isodow(timestamp) - 1)::BIGINT AS dow, {_HOURS} FROM obs_grid GROUP BY 1, 2"),
)
def _(spark, sf):
    return profile.hour_dow_matrix(v.obs_grid(spark, sf))


@query(
    "hour_dow_summary",
    v.sql(
        "obs_grid",
        """SELECT station_id, round(weekend_minus_weekday, 6) AS weekend_minus_weekday, round(peak_mean, 6) AS peak_mean, peak_cell, round(trough_mean, 6) AS trough_mean, trough_cell FROM
        (SELECT station_id, avg(pm25) FILTER (isodow(timestamp) >= 6) - avg(pm25) FILTER (isodow(timestamp) < 6) AS weekend_minus_weekday FROM obs_grid GROUP BY ALL)
        JOIN (SELECT station_id, max(m) AS peak_mean, (arg_max(d * 24 + h, (m, d, h)) FILTER (m IS NOT NULL))::BIGINT AS peak_cell, min(m) AS trough_mean, (arg_min(d * 24 + h, (m, d, h)) FILTER (m IS NOT NULL))::BIGINT AS trough_cell
          FROM (SELECT station_id, isodow(timestamp) - 1 AS d, hour(timestamp) AS h, avg(pm25) AS m FROM obs_grid GROUP BY ALL) GROUP BY ALL) USING (station_id)""",
    ),
)
def _(spark, sf):
    return profile.hour_dow_summary(v.obs_grid(spark, sf))


_XS = ("pm10", "temperature", "relative_humidity", "wind_speed")


def _rank(c, part):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0"


@query(
    "pair_correlation",
    v.sql(
        "merged",
        f"""SELECT station_id, year, variable, n_rows, n_pairs, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(100.0 * n_pairs / n_rows, 6) AS pair_pct FROM
        (SELECT station_id, year, variable, count(*) AS n_rows FROM long GROUP BY ALL) JOIN
        (SELECT station_id, year, variable, count(*) AS n_pairs, corr(x, pm25) AS pearson, corr(rx, ry) AS spearman FROM (SELECT *, {_rank('x', 'station_id, year, variable')} AS rx, {_rank('pm25', 'station_id, year, variable')} AS ry FROM long WHERE x IS NOT NULL AND pm25 IS NOT NULL) GROUP BY ALL) USING (station_id, year, variable) WHERE n_pairs >= 30""",
        "long AS (" + " UNION ALL ".join(f"SELECT station_id, year(timestamp) AS year, '{c}' AS variable, pm25, {c} AS x FROM merged" for c in _XS) + ")",
    ),
)
def _(spark, sf):
    df = v.merged(spark, sf).withColumn("year", F.year("timestamp").cast("long"))
    return profile.pair_correlation(df, ["station_id", "year"], "pm25", _XS, min_n=30)


_MAT = ("pm25", "pm10", "temperature", "relative_humidity", "wind_speed", "surface_pressure")


@query(
    "correlation_matrix",
    v.sql(
        "merged",
        " UNION ALL ".join(
            [f"SELECT station_id, '{a}|{b}' AS pair, round(corr({a}, {b}), 6) AS corr, 'pearson' AS method FROM cc GROUP BY station_id" for a, b in combinations(_MAT, 2)]
            + [f"SELECT station_id, '{a}|{b}' AS pair, round(corr(r_{a}, r_{b}), 6) AS corr, 'spearman' AS method FROM rk GROUP BY station_id" for a, b in combinations(_MAT, 2)]
        ),
        "cc AS (SELECT * FROM merged WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _MAT) + ")",
        "rk AS (SELECT station_id, " + ", ".join(f"rank() OVER (PARTITION BY station_id ORDER BY {c}) + (count(*) OVER (PARTITION BY station_id, {c}) - 1) / 2.0 AS r_{c}" for c in _MAT) + " FROM cc)",
    ),
)
def _(spark, sf):
    return profile.correlation_matrix(v.merged(spark, sf), _MAT)


BIN_SQL = """{name} AS (SELECT d.*, greatest(len(list_filter(e.edges, lambda z: z < d.{x})) - 1, 0)::BIGINT AS bin FROM {src} d JOIN (SELECT station_id, list_distinct(quantile_cont({x}, [{probs}])) AS edges FROM {src} GROUP BY ALL) e USING (station_id))"""


def bin_sql(name, src, x, bins):
    return BIN_SQL.format(name=name, src=src, x=x, probs=", ".join(repr(i / bins) for i in range(bins + 1)))


@query(
    "quantile_bin_trend",
    v.sql(
        "merged",
        """SELECT station_id, bin, count(*) AS n, round(quantile_cont(temperature, 0.5), 6) AS median_x, round(quantile_cont(pm25, 0.5), 6) AS median_y, round(quantile_cont(pm25, 0.25), 6) AS q25_y, round(quantile_cont(pm25, 0.75), 6) AS q75_y FROM b GROUP BY ALL""",
        "both_seen AS (SELECT station_id, temperature, pm25 FROM merged WHERE temperature IS NOT NULL AND pm25 IS NOT NULL)",
        bin_sql("b", "both_seen", "temperature", 10),
    ),
)
def _(spark, sf):
    return profile.quantile_bin_trend(v.merged(spark, sf), ["station_id"], "temperature", "pm25", 10)


@query(
    "circular_stats",
    v.sql(
        "merged",
        """SELECT station_id, count(wind_direction) AS n, round((degrees(atan2(s, c)) + 360) % 360, 6) AS circular_mean, round(degrees(sqrt(-2 * ln(sqrt(s * s + c * c)))), 6) AS circular_sd, round(sqrt(s * s + c * c), 6) AS resultant FROM
        (SELECT *, avg(sin(radians(wind_direction))) OVER (PARTITION BY station_id) AS s, avg(cos(radians(wind_direction))) OVER (PARTITION BY station_id) AS c FROM merged) GROUP BY station_id, s, c""",
    ),
)
def _(spark, sf):
    cols = profile.circular(F.col("wind_direction"))
    return v.merged(spark, sf).groupBy("station_id").agg(
        F.count("wind_direction").alias("n"), *[c.alias(n) for n, c in cols.items()]
    )


@query(
    "wind_rose",
    v.sql(
        "merged",
        """SELECT t.station_id, s.sector, coalesce(c.n, 0) AS n, round(100.0 * coalesce(c.n, 0) / t.total, 6) AS pct FROM (SELECT station_id, count(wind_direction) AS total FROM merged GROUP BY ALL) t CROSS JOIN (SELECT unnest(range(16)) AS sector) s
        LEFT JOIN (SELECT station_id, floor(((wind_direction + 11.25) % 360) / 22.5)::BIGINT AS sector, count(*) AS n FROM merged WHERE wind_direction IS NOT NULL GROUP BY ALL) c USING (station_id, sector)""",
    ),
)
def _(spark, sf):
    return profile.wind_rose(v.merged(spark, sf), ["station_id"])


@query(
    "histogram",
    v.sql(
        "obs_hourly",
        """SELECT station_id, bin, round(lo + bin * (hi - lo) / 20, 6) AS left_edge, count(*) AS n, round(count(*) / (k * (hi - lo) / 20), 6) AS density FROM (
        SELECT o.station_id, lo, hi, k, least(floor((pm25 - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin FROM obs_hourly o JOIN (SELECT station_id, min(pm25) AS lo, max(pm25) AS hi, count(pm25) AS k FROM obs_hourly GROUP BY ALL) s USING (station_id) WHERE pm25 IS NOT NULL) GROUP BY station_id, bin, lo, hi, k""",
    ),
)
def _(spark, sf):
    return profile.histogram(v.obs_hourly(spark, sf), ["station_id"], "pm25", 20)


_KDE = """kde AS (SELECT o.station_id, g.point, lo + (hi - lo) / 31 * g.point AS x, sum(exp(-0.5 * power((lo + (hi - lo) / 31 * g.point - pm25) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density
  FROM obs_hourly o JOIN (SELECT station_id, min(pm25) AS lo, max(pm25) AS hi, count(pm25) AS n, stddev_samp(pm25) * power(count(pm25), -0.2) AS h FROM obs_hourly GROUP BY ALL) s USING (station_id) CROSS JOIN (SELECT unnest(range(32)) AS point) g WHERE pm25 IS NOT NULL GROUP BY o.station_id, g.point, lo, hi)"""


@query(
    "kde_density",
    v.sql("obs_hourly", "SELECT station_id, point, round(x, 6) AS x, round(density, 6) AS density FROM kde", _KDE),
)
def _(spark, sf):
    return profile.kde_density(v.obs_hourly(spark, sf), ["station_id"], "pm25")


@query(
    "kde_mode",
    v.sql(
        "obs_hourly",
        "SELECT station_id, round(arg_max(x, density), 6) AS mode_x, round(max(density), 6) AS mode_density FROM kde GROUP BY ALL",
        _KDE,
    ),
)
def _(spark, sf):
    return profile.density_mode(profile.kde_density(v.obs_hourly(spark, sf), ["station_id"], "pm25"), ["station_id"])


@query(
    "avg_rank",
    v.sql(
        "obs_hourly",
        """SELECT station_id, round(pm25, 6) AS pm25, count(*) AS cnt, any_value(r) AS avg_rank FROM (SELECT station_id, pm25, rank() OVER (PARTITION BY station_id ORDER BY pm25) + (count(*) OVER (PARTITION BY station_id, pm25) - 1) / 2.0 AS r FROM obs_hourly WHERE pm25 IS NOT NULL) GROUP BY station_id, pm25""",
    ),
)
def _(spark, sf):
    return windows.avg_rank_rows(v.obs_hourly(spark, sf), ["station_id"], "pm25").select(
        "station_id", "pm25", "cnt", "avg_rank"
    )
