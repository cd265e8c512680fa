"""Regression operators (inventory 2.9, second part)."""

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from ..operators import grid, joins, linear, splits
from ..session import written
from . import query, views as v
from .frames import _TS, FEATURES
from .profiles import bin_sql
from .sequences import CUT, INTERP, _SPLIT, split_grid

X = ["one", "temperature"]
CALENDAR = ("hour_sin", "hour_cos")


def model_table(spark, sf):
    """Merged hourly table with calendar terms and the split, written once for multi-fit plans."""
    cyc = fn.cyclical_time("timestamp")
    return written(
        splits.cut_split(v.merged(spark, sf), CUT).withColumns({c: cyc[c] for c in CALENDAR}), "model_table"
    )


def simple(spark, sf):
    return linear.with_constant(v.merged(spark, sf))


OBS = "obs AS (SELECT station_id, timestamp, pm25 AS y, temperature AS x, row_number() OVER (PARTITION BY station_id ORDER BY timestamp) AS rn FROM merged WHERE pm25 IS NOT NULL AND temperature IS NOT NULL)"
FIT = "fit AS (SELECT station_id, count(*)::DOUBLE AS n, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM obs GROUP BY ALL)"
RES = "res AS (SELECT o.*, f.n, f.mx, f.sxx, b0 + b1 * x AS fitted, y - b0 - b1 * x AS e FROM obs o JOIN fit f USING (station_id))"


@query(
    "vif",
    v.sql(
        "merged",
        "SELECT station_id, n, feature, round(1 / (1 - r * r), 6) AS vif FROM (SELECT station_id, count(*) AS n, corr(temperature, wind_speed) AS r, unnest(['temperature', 'wind_speed']) AS feature FROM merged WHERE temperature IS NOT NULL AND wind_speed IS NOT NULL GROUP BY ALL)".replace(
            "GROUP BY ALL", "GROUP BY station_id"
        ),
    ),
)
def _(spark, sf):
    return linear.vif(v.merged(spark, sf), ["temperature", "wind_speed"])


@query("vif_all")
def _(spark, sf):
    return linear.vif(v.merged(spark, sf), FEATURES)


@query(
    "line_diagnostics",
    v.sql(
        "merged",
        """SELECT station_id, count(*) AS n, round(avg(e), 6) + 0.0 AS resid_mean, round(sum(power(e - l1, 2)) / sum(e * e), 6) AS durbin_watson, round(sum(e * l1) / sum(e * e), 6) AS acf_1, round(sum(e * l24) / sum(e * e), 6) AS acf_24,
        round(avg(power(e, 3)) / power(avg(e * e), 1.5), 6) AS skewness, round(avg(power(e, 4)) / power(avg(e * e), 2) - 3, 6) AS kurtosis, round(count(*) / 6.0 * (power(avg(power(e, 3)) / power(avg(e * e), 1.5), 2) + power(avg(power(e, 4)) / power(avg(e * e), 2) - 3, 2) / 4), 6) AS jarque_bera,
        greatest(1, floor(4 * power(count(*) / 100.0::DOUBLE, 2 / 9.0::DOUBLE)))::BIGINT AS plugin_lag, round(count(*) * regr_r2(e * e, x), 6) AS breusch_pagan FROM (SELECT *, lag(e, 1) OVER w AS l1, lag(e, 24) OVER w AS l24 FROM res WINDOW w AS (PARTITION BY station_id ORDER BY rn)) GROUP BY ALL""",
        OBS,
        FIT,
        RES,
    ),
)
def _(spark, sf):
    return linear.line_diagnostics(simple(spark, sf), "pm25", X).drop("resid_fitted_corr", "reset2_f", "reset3_f")


@query("line_diagnostics_full")
def _(spark, sf):
    df = linear.with_constant(model_table(spark, sf))
    return linear.line_diagnostics(df, "pm25", ["one", *FEATURES], p_values=True)


@query(
    "binned_residuals",
    v.sql(
        "merged",
        "SELECT station_id, bin, count(*) AS n, round(avg(fitted), 6) AS mean_fitted, round(avg(e), 6) AS mean_resid, round(stddev_samp(e), 6) AS sd_resid FROM b GROUP BY ALL",
        OBS,
        FIT,
        RES,
        bin_sql("b", "res", "fitted", 10),
    ),
)
def _(spark, sf):
    return linear.binned_residuals(simple(spark, sf), "pm25", X)


INFL = "infl AS (SELECT *, e / sqrt((sse - e * e / (1 - h)) / (n - 3) * (1 - h)) AS t, e * e * h / (2 * sse / (n - 2) * (1 - h) * (1 - h)) AS d FROM (SELECT *, 1 / n + (x - mx) * (x - mx) / sxx AS h, sum(e * e) OVER (PARTITION BY station_id) AS sse FROM res))"


@query(
    "influence",
    v.sql(
        "merged",
        """SELECT station_id, count(*) AS n_obs, count(*) FILTER (d > 4 / n) AS n_cooks_4n, count(*) FILTER (d > 0.5) AS n_cooks_05, count(*) FILTER (d > 1) AS n_cooks_10, round(max(d), 6) AS cooks_max, count(*) FILTER (h > 4 / n) AS n_high_leverage, round(max(h), 6) AS leverage_max, count(*) FILTER (abs(t) > 3) AS n_outliers, count(*) FILTER (abs(t) > 3 AND h > 4 / n) AS n_outlier_and_leverage FROM infl GROUP BY ALL""",
        OBS,
        FIT,
        RES,
        INFL,
    ),
)
def _(spark, sf):
    return linear.influence(simple(spark, sf), "pm25", X)


@query(
    "top_influential",
    v.sql(
        "merged",
        "SELECT station_id, timestamp, round(y, 6) AS pm25, round(fitted, 6) AS fitted, round(e, 6) AS resid, round(t, 6) AS studentized, round(h, 6) AS leverage, round(d, 6) AS cooks_d FROM infl ORDER BY d DESC, station_id, timestamp LIMIT 10",
        OBS,
        FIT,
        RES,
        INFL,
    ),
)
def _(spark, sf):
    return linear.top_influential(simple(spark, sf), "pm25", X)


@query(
    "hac_lag_table",
    v.sql(
        "merged",
        """SELECT station_id, lag::BIGINT AS lag, n::BIGINT AS n, round(b1, 6) AS coef, round(se, 6) AS se, round(b1 / se, 6) AS z FROM (
          SELECT f.station_id, p.lag, f.n, f.b1, sqrt(greatest(0, i01 * i01 * m00 + 2 * i01 * i11 * m01 + i11 * i11 * m11)) * CASE WHEN p.lag = 0 THEN sqrt(f.n / (f.n - 2)) ELSE 1 END AS se
          FROM (SELECT *, -sx / det AS i01, n / det AS i11, floor(4 * power(n / 100, 2 / 9.0::DOUBLE)) AS plug FROM (SELECT station_id, count(*)::DOUBLE AS n, sum(x) AS sx, count(*) * sum(x * x) - sum(x) * sum(x) AS det, regr_slope(y, x) AS b1 FROM obs GROUP BY ALL)) f
          JOIN (SELECT a.station_id, p.lag, sum(w * a.e * b.e * CASE WHEN p.l = 0 THEN 1 ELSE 2 END) AS m00, sum(w * a.e * b.e * CASE WHEN p.l = 0 THEN b.x ELSE a.x + b.x END) AS m01, sum(w * a.e * b.e * a.x * b.x * CASE WHEN p.l = 0 THEN 1 ELSE 2 END) AS m11
            FROM (SELECT g.lag, h.l, 1 - h.l / (g.lag + 1.0::DOUBLE) AS w FROM (SELECT unnest(range(0, 25)) AS lag) g JOIN (SELECT unnest(range(0, 25)) AS l) h ON h.l <= g.lag) p CROSS JOIN res a JOIN res b ON b.station_id = a.station_id AND b.rn = a.rn - p.l GROUP BY a.station_id, p.lag) p USING (station_id)
          WHERE p.lag IN (0, 12, 24) OR p.lag = greatest(1, f.plug))""",
        OBS,
        FIT,
        RES,
    ),
)
def _(spark, sf):
    rows = linear.hac_lag_table(simple(spark, sf), "pm25", X, [12, 24])
    return rows.filter("term = 'temperature'").drop("term")


@query("hac_lag_table_full")
def _(spark, sf):
    df = linear.with_constant(model_table(spark, sf))
    return linear.hac_lag_table(df, "pm25", ["one", *FEATURES], p_values=True)


def _given_predictions(spark, sf):
    """Test rows scored by the train mean and by the value a day earlier."""
    df = splits.cut_split(joins.value_at_offset(v.obs_hourly(spark, sf), 24, "pm25", "lag24"), CUT).filter("pm25 is not null")
    mean = df.filter("split = 'train'").groupBy("station_id").agg(F.avg("pm25").alias("mean"))
    cells = F.array(
        F.struct(F.lit("mean").alias("model"), F.col("mean").alias("pred"), F.lit(0).alias("n_predictors")),
        F.struct(F.lit("lag24").alias("model"), F.col("lag24").alias("pred"), F.lit(1).alias("n_predictors")),
    )
    test = df.filter("split = 'test'").join(mean, "station_id")
    return test.select("station_id", F.col("pm25").alias("y"), F.explode(cells).alias("m")).select("station_id", "y", "m.*").filter("pred is not null")


@query(
    "regression_metrics",
    v.sql(
        "obs_hourly",
        f"""SELECT station_id, model, n, p AS n_predictors, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(bias, 6) AS bias, round(CASE WHEN n > p + 1 THEN 1 - (1 - r2) * (n - 1) / (n - p - 1) END, 6) AS adjusted_r2 FROM (
        SELECT station_id, model, count(*) AS n, max(p)::BIGINT AS p, avg(abs(pred - y)) AS mae, sqrt(avg(power(pred - y, 2))) AS rmse, 1 - sum(power(pred - y, 2)) / (var_pop(y) * count(*)) AS r2, avg(pred - y) AS bias FROM (
          SELECT t.station_id, t.pm25 AS y, unnest(['mean', 'lag24']) AS model, unnest([m.mean, l.pm25]) AS pred, unnest([0, 1]) AS p FROM obs_hourly t JOIN (SELECT station_id, avg(pm25) AS mean FROM obs_hourly WHERE timestamp < {_TS} GROUP BY ALL) m USING (station_id) LEFT JOIN obs_hourly l ON l.station_id = t.station_id AND l.timestamp = t.timestamp - INTERVAL 24 HOUR WHERE t.timestamp >= {_TS} AND t.pm25 IS NOT NULL) WHERE pred IS NOT NULL GROUP BY ALL)""",
    ),
)
def _(spark, sf):
    return linear.regression_metrics(_given_predictions(spark, sf), ["station_id", "model"])


@query("ridge_lasso_tune")
def _(spark, sf):
    df = model_table(spark, sf).filter("split = 'train'")
    return linear.ridge_lasso_tune(df, "pm25", [*FEATURES, *CALENDAR])


@query("regression_models")
def _(spark, sf):
    """Mean, OLS, ridge and lasso on the test span, penalties tuned on the train span."""
    df = model_table(spark, sf)
    features = [*FEATURES, *CALENDAR]
    tuned = linear.ridge_lasso_tune(df.filter("split = 'train'"), "pm25", features)
    return linear.regression_metrics(linear.model_scores(df, "pm25", features, tuned), ["station_id", "model"])


@query("regression_ablation")
def _(spark, sf):
    return linear.regression_ablation(
        model_table(spark, sf),
        "pm25",
        {
            "mean": [],
            "full": [*FEATURES, *CALENDAR],
            "no_calendar": list(FEATURES),
            "weather_pair": ["temperature", "wind_speed"],
            "with_lag": [*FEATURES, *CALENDAR, "lag_24h"],
        },
    )


@query(
    "rolling_origin",
    v.sql(
        "merged",
        """SELECT station_id, fold, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, n_train, first_hour, last_hour, round(mean_rmse, 6) AS mean_rmse FROM (
        SELECT d.station_id, d.fold, count(*) AS n, avg(abs(pred - y)) AS mae, sqrt(avg(power(pred - y, 2))) AS rmse, 1 - sum(power(pred - y, 2)) / (var_pop(y) * count(*)) AS r2, any_value(n_train) AS n_train, min(timestamp) AS first_hour, max(timestamp) AS last_hour, sqrt(avg(power(y - ym, 2))) AS mean_rmse FROM (
          SELECT v.station_id, v.fold, v.timestamp, v.y, f.b0 + f.b1 * coalesce(v.x, f.med) AS pred, f.n_train, f.ym FROM folds v JOIN (SELECT t.station_id, t.fold, any_value(m.med) AS med, count(*) AS n_train, regr_intercept(y, coalesce(x, m.med)) AS b0, regr_slope(y, coalesce(x, m.med)) AS b1, avg(y) AS ym FROM folds t JOIN (SELECT station_id, fold, coalesce(quantile_cont(x, 0.5), 0) AS med FROM folds WHERE role = 'train' GROUP BY ALL) m USING (station_id, fold) WHERE role = 'train' GROUP BY t.station_id, t.fold) f USING (station_id, fold) WHERE v.role = 'validation') d GROUP BY d.station_id, d.fold)""",
        "blk AS (SELECT *, CASE WHEN rn <= n - 5 * (n // 6) THEN 0 ELSE (rn - (n - 5 * (n // 6)) - 1) // (n // 6) + 1 END AS block FROM (SELECT station_id, timestamp, pm25 AS y, temperature AS x, row_number() OVER (PARTITION BY station_id ORDER BY timestamp) AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM merged WHERE pm25 IS NOT NULL))",
        "folds AS (SELECT b.*, f.fold, CASE WHEN b.block = f.fold THEN 'validation' ELSE 'train' END AS role FROM blk b JOIN (SELECT unnest(range(1, 6)) AS fold) f ON f.fold >= b.block)",
    ),
)
def _(spark, sf):
    return linear.rolling_origin(v.merged(spark, sf), "pm25", ["temperature"])


@query("stratified_stability")
def _(spark, sf):
    return linear.stratified_stability(model_table(spark, sf), "pm25", ["wind_speed", "precipitation", "temperature"])


@query(
    "derived_input_sensitivity",
    v.sql(
        "obs_grid weather_hourly",
        """SELECT f.station_id, f.no AS n_observed, f.nd AS n_derived, round(greatest(abs(o0 - d0), abs(o1 - d1)), 6) AS max_abs_beta_diff, count(*) AS n_test, round(avg(abs(o0 + o1 * t.x - t.y)), 6) AS mae_observed, round(avg(abs(d0 + d1 * t.x - t.y)), 6) AS mae_derived, round(sqrt(avg(power(o0 + o1 * t.x - t.y, 2))), 6) AS rmse_observed, round(sqrt(avg(power(d0 + d1 * t.x - t.y, 2))), 6) AS rmse_derived, round(avg(o0 + o1 * t.x - t.y), 6) AS bias_observed, round(avg(d0 + d1 * t.x - t.y), 6) AS bias_derived
        FROM (SELECT station_id, count(y) AS no, count(d) AS nd, regr_intercept(y, x) AS o0, regr_slope(y, x) AS o1, regr_intercept(d, x) AS d0, regr_slope(d, x) AS d1 FROM j WHERE split = 'train' AND x IS NOT NULL GROUP BY ALL) f JOIN j t ON t.station_id = f.station_id AND t.split = 'test' AND t.y IS NOT NULL AND t.x IS NOT NULL GROUP BY f.station_id, f.no, f.nd, o0, o1, d0, d1""",
        INTERP.format(2, _SPLIT),
        "j AS (SELECT i.station_id, i.split, i.pm25 AS y, i.pm25_derived AS d, w.temperature AS x FROM interp i LEFT JOIN weather_hourly w USING (timestamp))",
    ),
)
def _(spark, sf):
    df = grid.interpolate_short_gaps(split_grid(spark, sf), max_gap=2).join(
        v.weather_hourly(spark, sf).select("timestamp", "temperature"), "timestamp", "left"
    )
    return linear.derived_input_sensitivity(df, "pm25", "pm25_derived", ["temperature"])


@query(
    "feature_guard",
    v.sql(
        "merged",
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, count({c}) AS n_present FROM merged"
            for c in ("temperature", "relative_humidity", "wind_speed", "wind_direction", "precipitation", "surface_pressure")
        ),
    ),
)
def _(spark, sf):
    """The guard admits exactly the weather columns of a table that also holds forbidden names."""
    df = v.merged(spark, sf).withColumns(
        {"pm25_derived": F.col("pm25"), "next_pm25": F.col("pm25"), "pm25_lead_1": F.col("pm25"), "alert": F.lit(1)}
    )
    allowed = splits.guard_features(df, "pm25")
    wide = df.agg(*[F.count(c).alias(c) for c in allowed])
    return wide.unpivot([], allowed, "feature", "n_present")


@query(
    "require_columns",
    v.sql(
        "obs_grid",
        "SELECT 'station_id,timestamp' AS observation_key, count(*) AS n_rows, count(*) FILTER (station_id IS NULL) AS n_null_station, count(*) FILTER (timestamp IS NULL) AS n_null_time FROM obs_grid",
    ),
)
def _(spark, sf):
    df = S.require(v.obs_grid(spark, sf), ["station_id", "timestamp", "pm25"], "grid")
    return df.agg(
        F.lit(",".join(S.observation_key(df))).alias("observation_key"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("station_id").isNull()).alias("n_null_station"),
        F.count_if(F.col("timestamp").isNull()).alias("n_null_time"),
    )
