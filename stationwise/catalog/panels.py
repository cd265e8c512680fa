"""Daily and weekly panels, compliance and exceedance tables (inventory 2.5, third part)."""

from pyspark.sql import functions as F

from ..operators import panel, windows
from . import query, views as v

MIN_HOURS = 12
DAYS = """days AS (SELECT station_id, CAST(timestamp AS DATE) AS date, count(*) AS n_rows, count(pm25) AS valid_hours, avg(pm25) AS mean_value, quantile_cont(pm25, 0.5) AS median_value FROM {0} GROUP BY ALL)"""
DENSE = """dense AS (SELECT s.station_id, s.date, s.lo, s.hi, coalesce(d.n_rows, 0) AS n_rows, coalesce(d.valid_hours, 0) AS valid_hours, d.mean_value, d.median_value FROM (SELECT station_id, lo, hi, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT station_id, min(date) AS lo, max(date) AS hi FROM days GROUP BY ALL)) s LEFT JOIN days d USING (station_id, date))"""
SEASON = "CASE WHEN month({0}) IN (12,1,2) THEN 'Winter' WHEN month({0}) IN (3,4,5) THEN 'Spring' WHEN month({0}) IN (6,7,8) THEN 'Summer' ELSE 'Autumn' END"
_LABELS = f"{SEASON.format('date')} AS season, (isodow(date) - 1)::BIGINT AS dow, (isodow(date) >= 6)::BIGINT AS is_weekend, printf('%04d-W%02d', isoyear(date), week(date)) AS iso_week"


def _dates(df, *cols):
    """Dates as text in the result tables."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


@query(
    "daily_panel",
    v.sql(
        "obs_grid",
        f"SELECT station_id, date::VARCHAR AS date, n_rows, valid_hours, round(mean_value, 6) AS mean_value, round(median_value, 6) AS median_value, {_LABELS} FROM days WHERE valid_hours >= {MIN_HOURS}",
        DAYS.format("obs_grid"),
    ),
)
def _(spark, sf):
    return _dates(panel.daily_panel(v.obs_grid(spark, sf), MIN_HOURS), "date")


@query(
    "daily_panel_audit",
    v.sql(
        "obs_hourly",
        f"""SELECT station_id, sum(n_rows)::BIGINT AS n_rows, sum(valid_hours)::BIGINT AS n_valid_hours, count(*) AS span_days, count(*) FILTER (valid_hours > 0) AS days_any, count(*) FILTER (valid_hours = 0) AS days_none, count(*) FILTER (valid_hours = 24) AS days_full,
        count(*) FILTER (valid_hours >= 18) AS days_kept, count(*) FILTER (valid_hours > 0 AND valid_hours < 18) AS days_dropped, count(*) FILTER (valid_hours >= 18 AND isodow(date) >= 6) AS kept_weekend,
        {', '.join(f"count(*) FILTER (valid_hours >= 18 AND {SEASON.format('date')} = '{s}') AS kept_{s.lower()}" for s in ('Winter', 'Spring', 'Summer', 'Autumn'))} FROM dense GROUP BY ALL""",
        DAYS.format("obs_hourly"),
        DENSE,
    ),
)
def _(spark, sf):
    return panel.daily_panel_audit(v.obs_hourly(spark, sf))


@query(
    "dropped_days",
    v.sql(
        "obs_hourly",
        "SELECT station_id, date::VARCHAR AS date, valid_hours FROM days WHERE valid_hours > 0 AND valid_hours < 18",
        DAYS.format("obs_hourly"),
    ),
)
def _(spark, sf):
    return _dates(panel.dropped_days(v.obs_hourly(spark, sf)), "date")


@query(
    "daily_calendar",
    v.sql(
        "obs_hourly",
        f"SELECT station_id, date::VARCHAR AS date, valid_hours, round(CASE WHEN valid_hours >= {MIN_HOURS} THEN mean_value END, 6) AS value, date_diff('day', lo, date) AS pos, {_LABELS} FROM dense",
        DAYS.format("obs_hourly"),
        DENSE,
    ),
)
def _(spark, sf):
    return _dates(panel.daily_calendar(v.obs_hourly(spark, sf), MIN_HOURS), "date")


WEEKLY = f"""weekly AS (SELECT station_id, printf('%04d-W%02d', isoyear(date), week(date)) AS iso_week, CAST(min(date_trunc('week', date)) AS DATE) AS week_start, avg(value) AS week_mean, count(value) AS observed_days, arg_min({SEASON.format('date')}, date) AS season FROM daily_calendar GROUP BY 1, 2)"""


@query(
    "weekly_calendar",
    v.sql(
        "daily_calendar",
        "SELECT station_id, iso_week, week_start::VARCHAR AS week_start, round(week_mean, 6) AS week_mean, observed_days, season FROM weekly",
        WEEKLY,
    ),
)
def _(spark, sf):
    return _dates(panel.weekly_calendar(v.daily_calendar(spark, sf)), "week_start")


WEEKDIFF = """weekdiff AS (SELECT station_id, iso_week, week_start, n_weekdays, n_weekend, CASE WHEN n_weekdays >= 3 AND n_weekend >= 2 THEN wd - we END AS difference FROM (SELECT station_id, printf('%04d-W%02d', isoyear(date), week(date)) AS iso_week, CAST(min(date_trunc('week', date)) AS DATE) AS week_start,
  count(value) FILTER (isodow(date) < 6) AS n_weekdays, count(value) FILTER (isodow(date) >= 6) AS n_weekend, avg(value) FILTER (isodow(date) < 6) AS wd, avg(value) FILTER (isodow(date) >= 6) AS we FROM daily_calendar GROUP BY 1, 2))"""


@query(
    "weekly_paired_difference",
    v.sql(
        "daily_calendar",
        "SELECT station_id, iso_week, week_start::VARCHAR AS week_start, n_weekdays, n_weekend, round(difference, 6) AS difference FROM weekdiff",
        WEEKDIFF,
    ),
)
def _(spark, sf):
    return _dates(panel.weekly_difference(v.daily_calendar(spark, sf)), "week_start")


_STATUS_SQL = f"""st AS (SELECT *, CASE WHEN valid_hours >= {MIN_HOURS} THEN 'valid' WHEN valid_hours = 0 THEN 'no_obs' ELSE 'incomplete_obs' END AS day_status, (date = lo OR date = hi) AND n_rows < 24 AS is_boundary_day, CASE WHEN valid_hours >= {MIN_HOURS} THEN mean_value END AS daily_mean FROM dense)"""


@query(
    "day_status",
    v.sql(
        "obs_hourly",
        "SELECT station_id, date::VARCHAR AS date, n_rows, valid_hours, day_status, is_boundary_day, round(daily_mean, 6) AS daily_mean FROM st",
        DAYS.format("obs_hourly"),
        DENSE,
        _STATUS_SQL,
    ),
)
def _(spark, sf):
    return _dates(panel.day_status(v.obs_hourly(spark, sf), MIN_HOURS), "date")


_EDGES = [(None, 15), (15, 25), (25, 37.5), (37.5, 50), (50, 75), (75, None)]


def tier_conditions(c):
    out = []
    for lo, hi in _EDGES:
        parts = [f"{c} IS NOT NULL"] + ([f"{c} >= {lo}"] if lo is not None else []) + ([f"{c} < {hi}"] if hi is not None else [])
        out.append(" AND ".join(parts))
    return out


_T = tier_conditions("daily_mean")


@query(
    "daily_compliance",
    v.sql(
        "obs_hourly",
        "SELECT station_id, count(*) AS n_days, count(daily_mean) AS n_valid_days, count(*) FILTER (day_status = 'no_obs') AS n_no_obs, count(*) FILTER (day_status = 'incomplete_obs') AS n_incomplete, count(*) FILTER (is_boundary_day) AS n_boundary_partial, "
        + ", ".join(f"count(*) FILTER ({c}) AS tier_{i}, round(100.0 * count(*) FILTER ({c}) / nullif(count(daily_mean), 0), 6) AS tier_{i}_pct_valid, round(100.0 * count(*) FILTER ({c}) / count(*), 6) AS tier_{i}_pct_all" for i, c in enumerate(_T))
        + """, count(*) FILTER (daily_mean >= 50) AS n_ge_50, count(*) FILTER (daily_mean < 15) AS n_lt_15, count(*) FILTER (daily_mean >= 15) AS n_ge_15, count(*) FILTER (daily_mean > 15) AS n_gt_15, round(max(daily_mean), 6) AS max_daily, round(avg(daily_mean), 6) AS mean_daily,
        round(quantile_cont(daily_mean, 0.99), 6) AS p99_daily, round(quantile_cont(daily_mean, 0.5), 6) AS median_daily, any_value(y.n_years) AS n_years, any_value(y.mx) AS max_valid_days_in_year, any_value(y.mx) >= 329 AND any_value(y.n_years) = 1 AND count(*) - count(daily_mean) <= 36 AS sufficient_for_annual
        FROM st JOIN (SELECT station_id, count(*) AS n_years, max(k) AS mx FROM (SELECT station_id, year(date) AS yy, count(daily_mean) AS k FROM st GROUP BY ALL) GROUP BY ALL) y USING (station_id) GROUP BY station_id""",
        DAYS.format("obs_hourly"),
        DENSE,
        _STATUS_SQL,
    ),
)
def _(spark, sf):
    return panel.daily_compliance(v.obs_hourly(spark, sf), MIN_HOURS)


ROLL = """roll AS (SELECT *, CASE WHEN count(pm25) OVER w >= {1} THEN avg(pm25) OVER w END AS r FROM {0} WINDOW w AS (PARTITION BY station_id ORDER BY timestamp RANGE BETWEEN INTERVAL {2} HOUR PRECEDING AND CURRENT ROW))"""
_RT = tier_conditions("r")


@query(
    "rolling_tiers",
    v.sql(
        "obs_grid",
        "SELECT station_id, count(*) AS n_rows, count(r) AS n_windows, "
        + ", ".join(f"count(*) FILTER ({c}) AS tier_{i}, round(100.0 * count(*) FILTER ({c}) / nullif(count(r), 0), 6) AS tier_{i}_pct" for i, c in enumerate(_RT))
        + ", round(max(r), 6) AS peak, arg_max(timestamp, (r, timestamp)) FILTER (r IS NOT NULL) AS peak_time FROM roll GROUP BY station_id",
        ROLL.format("obs_grid", 12, 23),
    ),
)
def _(spark, sf):
    rolled = windows.rolling_means(v.obs_grid(spark, sf), windows={24: 12})
    r = F.col("rolling_24h")
    out = rolled.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(r).alias("n_windows"),
        *panel.tier_counts(r),
        F.max(r).alias("peak"),
        F.max_by("timestamp", F.when(r.isNotNull(), F.struct(r, "timestamp"))).alias("peak_time"),
    )
    for i in range(6):
        out = out.withColumn(f"tier_{i}_pct", F.try_divide(100.0 * F.col(f"tier_{i}"), F.col("n_windows")))
    return out


@query(
    "exceedance_context",
    v.sql(
        "obs_grid",
        """SELECT station_id, windows_valid, windows_over, round(windows_over / nullif(windows_valid, 0), 6) AS window_share, days, days_over, round(p, 6) AS day_share,
        round(greatest(0, (p + 3.841458820694124 / (2 * days)) / (1 + 3.841458820694124 / days) - 1.959963984540054 * sqrt(p * (1 - p) / days + 3.841458820694124 / (4 * days * days)) / (1 + 3.841458820694124 / days)), 6) AS wilson_low,
        round(least(1, (p + 3.841458820694124 / (2 * days)) / (1 + 3.841458820694124 / days) + 1.959963984540054 * sqrt(p * (1 - p) / days + 3.841458820694124 / (4 * days * days)) / (1 + 3.841458820694124 / days)), 6) AS wilson_high
        FROM (SELECT station_id, count(r) AS windows_valid, count(*) FILTER (r >= 50) AS windows_over FROM roll GROUP BY ALL) JOIN (SELECT station_id, count(*) AS days, count(*) FILTER (mean_value >= 50) AS days_over, count(*) FILTER (mean_value >= 50) / count(*) AS p FROM days WHERE valid_hours >= 12 GROUP BY ALL) USING (station_id)""",
        ROLL.format("obs_grid", 24, 23),
        DAYS.format("obs_grid"),
    ),
)
def _(spark, sf):
    df = v.obs_grid(spark, sf)
    r = F.col("rolling_24h")
    wins = windows.rolling_means(df, windows={24: 24}).groupBy("station_id").agg(
        F.count(r).alias("windows_valid"), F.count_if(r >= 50).alias("windows_over")
    )
    days = panel.daily_panel(df, MIN_HOURS).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("mean_value") >= 50).alias("days_over")
    )
    low, high = panel.wilson_interval(F.col("days_over"), F.col("days"))
    return wins.join(days, "station_id").withColumns(
        {
            "window_share": F.try_divide("windows_over", "windows_valid"),
            "day_share": F.col("days_over") / F.col("days"),
            "wilson_low": F.greatest(F.lit(0.0), low),
            "wilson_high": F.least(F.lit(1.0), high),
        }
    )


_COHORT = f"""cohorts AS (SELECT station_id, season, season_year, observed_days, days_in_span, total AS calendar_days, observed_days / total AS coverage, CASE WHEN observed_days / total >= 0.9 THEN 'full' ELSE 'partial' END AS cohort FROM (
  SELECT station_id, season, season_year, count(value) AS observed_days, count(*) AS days_in_span, date_diff('day', any_value(start), CAST(any_value(start) + INTERVAL 3 MONTH AS DATE)) AS total FROM (
    SELECT *, make_date(season_year - CASE WHEN season = 'Winter' THEN 1 ELSE 0 END, CASE season WHEN 'Winter' THEN 12 WHEN 'Spring' THEN 3 WHEN 'Summer' THEN 6 ELSE 9 END, 1) AS start FROM (SELECT *, {SEASON.format('date')} AS season, year(date) + CASE WHEN month(date) = 12 THEN 1 ELSE 0 END AS season_year FROM daily_calendar)) GROUP BY station_id, season, season_year))"""


@query(
    "season_cohorts",
    v.sql("daily_calendar", "SELECT station_id, season, season_year, observed_days, days_in_span, calendar_days, round(coverage, 6) AS coverage, cohort FROM cohorts", _COHORT),
)
def _(spark, sf):
    return panel.season_cohorts(v.daily_calendar(spark, sf))


@query(
    "repeated_seasons",
    v.sql(
        "daily_calendar",
        "SELECT station_id, season, count(*) AS n_years FROM cohorts WHERE observed_days > 0 GROUP BY ALL HAVING count(*) >= 2",
        _COHORT,
    ),
)
def _(spark, sf):
    return panel.repeated_seasons(panel.season_cohorts(v.daily_calendar(spark, sf)))


@query(
    "multi_year_summary",
    v.sql(
        "obs_grid",
        f"""SELECT h.*, coalesce(d.vd, 0) AS valid_days, coalesce(d.d50, 0) AS days_gt_50, coalesce(d.d15, 0) AS days_gt_15, round(100.0 * d.d50 / d.vd, 6) AS pct_gt_50, round(100.0 * d.d15 / d.vd, 6) AS pct_gt_15 FROM
        (SELECT station_id, year(timestamp) AS year, {SEASON.format('timestamp')} AS season, count(*) AS n_hours, count(*) FILTER (pm25 IS NULL) AS n_missing, round(avg(pm25), 6) AS mean, round(stddev_samp(pm25), 6) AS sd, round(quantile_cont(pm25, 0.5), 6) AS median, round(quantile_cont(pm25, 0.75) - quantile_cont(pm25, 0.25), 6) AS iqr, round(quantile_cont(pm25, 0.9), 6) AS p90, round(quantile_cont(pm25, 0.95), 6) AS p95 FROM obs_grid GROUP BY 1, 2, 3) h
        LEFT JOIN (SELECT station_id, year(date) AS year, {SEASON.format('date')} AS season, count(*) AS vd, count(*) FILTER (mean_value > 50) AS d50, count(*) FILTER (mean_value > 15) AS d15 FROM days WHERE valid_hours >= {MIN_HOURS} GROUP BY 1, 2, 3) d USING (station_id, year, season)""",
        DAYS.format("obs_grid"),
    ),
)
def _(spark, sf):
    return panel.multi_year_summary(v.obs_grid(spark, sf), MIN_HOURS)


# --- label prevalence, coverage strata and split search ---------------------

from ..operators import labels  # noqa: E402

LABELLED = f"""lab AS (SELECT *, CASE WHEN wn >= 12 THEN (round(wm, 9) >= 50)::INT END AS alert, pn >= 12 AS has_past, CASE WHEN timestamp < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS split, {SEASON.format('timestamp')} AS season FROM (
  SELECT station_id, timestamp, pm25, count(pm25) OVER w AS wn, avg(pm25) OVER w AS wm, count(pm25) OVER p AS pn FROM obs_grid
  WINDOW w AS (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), p AS (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)))"""


def labelled(spark, sf):
    return labels.labelled_grid(v.obs_grid(spark, sf), "2024-01-20 00:00:00", min_periods=12, threshold=50.0)


_SUMS = "count(*) AS grid_hours, count(pm25) AS valid_hours, count(*) - count(pm25) AS missing_hours, count(alert) AS labelled, count(*) FILTER (alert IS NOT NULL AND has_past) AS evaluable, coalesce(sum(alert), 0)::BIGINT AS positives, coalesce(sum(alert) FILTER (has_past), 0)::BIGINT AS positives_evaluable"
_RATES = """round(100.0 * valid_hours / grid_hours, 6) AS valid_pct, round(100.0 * labelled / grid_hours, 6) AS labelled_pct, round(100.0 * evaluable / grid_hours, 6) AS evaluable_pct, round(100.0 * positives / nullif(labelled, 0), 6) AS positive_pct_labelled, round(100.0 * positives_evaluable / nullif(evaluable, 0), 6) AS positive_pct_evaluable"""


@query(
    "coverage_by_stratum",
    v.sql(
        "obs_grid",
        f"""SELECT *, {_RATES} FROM (SELECT station_id, kind, stratum, split, {_SUMS} FROM (SELECT *, unnest(['year', 'season', 'month']) AS kind, unnest([year(timestamp)::VARCHAR, season, strftime(timestamp, '%Y-%m')]) AS stratum FROM lab) GROUP BY station_id, kind, stratum, split)""",
        LABELLED,
    ),
)
def _(spark, sf):
    return labels.coverage_by_stratum(labelled(spark, sf))


@query(
    "coverage_conservation",
    v.sql(
        "obs_grid",
        f"""SELECT k.kind, t.split, m.measure, m.total AS total_strata, m.total AS total_rows, true AS conserved FROM (SELECT unnest(['year', 'season', 'month']) AS kind) k CROSS JOIN (SELECT split, {_SUMS} FROM lab GROUP BY split) t
        CROSS JOIN LATERAL (SELECT unnest(['grid_hours', 'valid_hours', 'missing_hours', 'labelled', 'evaluable', 'positives', 'positives_evaluable']) AS measure, unnest([grid_hours, valid_hours, missing_hours, labelled, evaluable, positives, positives_evaluable]) AS total) m""",
        LABELLED,
    ),
)
def _(spark, sf):
    df = labelled(spark, sf)
    return labels.conservation(labels.coverage_by_stratum(df), df)


@query(
    "population_funnel",
    v.sql(
        "obs_grid",
        """SELECT station_id, split, stage, n, positives FROM (SELECT station_id, split, unnest(['all', 'observed', 'labelled', 'evaluable']) AS stage, unnest([count(*), count(pm25), count(alert), count(*) FILTER (alert IS NOT NULL AND has_past)]) AS n,
        unnest([count(*) FILTER (alert = 1), count(*) FILTER (alert = 1 AND pm25 IS NOT NULL), count(*) FILTER (alert = 1), count(*) FILTER (alert = 1 AND has_past)]) AS positives FROM lab GROUP BY station_id, split)""",
        LABELLED,
    ),
)
def _(spark, sf):
    return labels.population_funnel(labelled(spark, sf))


@query(
    "label_prevalence",
    v.sql(
        "obs_grid",
        """SELECT station_id, split, count(*) AS n_rows, count(pm25) AS n_observed, count(*) FILTER (pm25 > 100) AS n_severe, round(100.0 * count(*) FILTER (pm25 > 100) / count(*), 6) AS severe_pct_rows, round(100.0 * count(*) FILTER (pm25 > 100) / nullif(count(pm25), 0), 6) AS severe_pct_observed,
        count(alert) AS n_labelled, coalesce(sum(alert), 0)::BIGINT AS n_alert, round(100.0 * coalesce(sum(alert), 0) / count(*), 6) AS alert_pct_rows, round(100.0 * sum(alert) / nullif(count(alert), 0), 6) AS alert_pct_labelled FROM lab GROUP BY ALL""",
        LABELLED,
    ),
)
def _(spark, sf):
    return labels.label_prevalence(labelled(spark, sf))


@query(
    "month_exceedance",
    v.sql(
        "obs_grid",
        "SELECT station_id, strftime(timestamp, '%Y-%m') AS month, count(*) AS n_rows, count(pm25) AS n_observed, count(*) FILTER (pm25 > 50) AS hours_gt_50, count(*) FILTER (pm25 > 100) AS hours_gt_100, round(avg(pm25), 6) AS mean FROM obs_grid GROUP BY 1, 2",
    ),
)
def _(spark, sf):
    return labels.month_exceedance(v.obs_grid(spark, sf))


@query(
    "split_candidates",
    v.sql(
        "obs_grid",
        """SELECT station_id, cut, count(*) FILTER (timestamp < cut) AS n_train, count(*) FILTER (timestamp >= cut) AS n_test, round(count(*) FILTER (timestamp < cut) / count(*), 6) AS train_share, count(*) FILTER (timestamp < cut AND pm25 > 40) AS severe_train, count(*) FILTER (timestamp >= cut AND pm25 > 40) AS severe_test,
        round(quantile_cont(pm25, 0.9) FILTER (timestamp < cut), 6) AS p90_train, round(quantile_cont(pm25, 0.9) FILTER (timestamp >= cut), 6) AS p90_test FROM obs_grid CROSS JOIN (SELECT unnest([TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-16', TIMESTAMP '2024-01-22']) AS cut) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    return labels.split_candidates(v.obs_grid(spark, sf), ["2024-01-10", "2024-01-16", "2024-01-22"], severe=40.0)
