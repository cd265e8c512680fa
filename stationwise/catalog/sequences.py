"""Grid, run-length, masking and interpolation operators (inventory 2.4)."""

from pyspark.sql import functions as F

from ..operators import clean, grid, panel
from ..operators.sequence import hour_number
from ..session import written
from . import query, views as v

CUT = "2024-01-20 00:00:00"

# Islands on the dense grid, for any state expression {0}; a run needs equal state on adjacent hours.
RUNS = """runs_{1} AS (
  SELECT station_id, run, min(timestamp) AS run_start, max(timestamp) AS run_end, count(*) AS len, any_value(state) AS state FROM (
    SELECT *, sum(brk) OVER (PARTITION BY station_id ORDER BY timestamp) AS run FROM (
      SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL OR timestamp - lag(timestamp) OVER w <> INTERVAL 1 HOUR OR state IS DISTINCT FROM lag(state) OVER w THEN 1 ELSE 0 END AS brk
      FROM (SELECT *, {0} AS state FROM {2}) WINDOW w AS (PARTITION BY station_id ORDER BY timestamp))) GROUP BY ALL)"""


@query(
    "hourly_grid",
    v.sql(
        "obs_grid",
        "SELECT station_id, timestamp, round(pm25, 6) AS pm25, round(pm10, 6) AS pm10, round(relative_humidity, 6) AS relative_humidity FROM obs_grid",
    ),
)
def _(spark, sf):
    return v.obs_grid(spark, sf)


@query(
    "grid_inserted",
    v.sql(
        "obs_grid",
        """SELECT station_id, n_grid, n_observed, n_grid - n_observed AS n_inserted FROM (SELECT station_id, count(*) AS n_grid FROM obs_grid GROUP BY ALL) JOIN (SELECT station_id, count(*) AS n_observed FROM obs_hourly GROUP BY ALL) USING (station_id)""",
    ),
)
def _(spark, sf):
    return grid.grid_inserted(v.obs_hourly(spark, sf), v.obs_grid(spark, sf))


@query(
    "daily_grid",
    v.sql(
        "daily_calendar",
        "SELECT station_id, date::VARCHAR AS date, pos, round(value, 6) AS value FROM daily_calendar",
    ),
)
def _(spark, sf):
    return v.daily_calendar(spark, sf).withColumn("date", F.col("date").cast("string"))


@query(
    "run_ids",
    v.sql(
        "obs_hourly",
        "SELECT station_id, run_start, run_end, len AS run_len, round(state, 6) AS pm25 FROM runs_v",
        RUNS.format("pm25", "v", "obs_hourly"),
    ),
)
def _(spark, sf):
    r = grid.with_runs(v.obs_hourly(spark, sf), F.col("pm25"), size=64)
    first = r.filter(F.col("run_first") == hour_number("timestamp"))
    return first.select(
        "station_id",
        F.timestamp_seconds(F.col("run_first") * 3600).alias("run_start"),
        F.timestamp_seconds(F.col("run_last") * 3600).alias("run_end"),
        "run_len",
        "pm25",
    )


@query(
    "stuck_sensor",
    v.sql(
        "obs_grid",
        """SELECT g.station_id, g.timestamp, CASE WHEN r.len > 6 AND g.pm25 IS NOT NULL THEN 1 ELSE 0 END AS is_stuck, round(CASE WHEN r.len > 6 THEN NULL ELSE g.pm25 END, 6) AS pm25
        FROM obs_grid g JOIN runs_v r ON g.station_id = r.station_id AND g.timestamp BETWEEN r.run_start AND r.run_end""",
        RUNS.format("pm25", "v", "obs_grid"),
    ),
)
def _(spark, sf):
    return grid.stuck_sensor(v.obs_grid(spark, sf)).select("station_id", "timestamp", "is_stuck", "pm25")


_MISS = RUNS.format("pm25 IS NULL", "m", "obs_grid")


@query(
    "prolonged_missing_flag",
    v.sql(
        "obs_grid",
        """SELECT station_id, coalesce(sum(len) FILTER (state AND len > 6), 0)::BIGINT AS flagged_hours, count(*) FILTER (state AND len > 6) AS n_blocks, max(len) FILTER (state AND len > 6) AS longest_block FROM runs_m GROUP BY ALL""",
        _MISS,
    ),
)
def _(spark, sf):
    return grid.prolonged_missing_stats(v.obs_grid(spark, sf))


_SEASON = "CASE WHEN month(run_start) IN (12,1,2) THEN 'Winter' WHEN month(run_start) IN (3,4,5) THEN 'Spring' WHEN month(run_start) IN (6,7,8) THEN 'Summer' ELSE 'Autumn' END"


@query(
    "missing_runs",
    v.sql(
        "obs_grid",
        f"SELECT station_id, run_start, run_end, len AS gap_hours, year(run_start) AS year, {_SEASON} AS season FROM runs_m WHERE state AND len >= 2",
        _MISS,
    ),
)
def _(spark, sf):
    return grid.missing_runs(v.obs_grid(spark, sf), min_span=2)


@query(
    "top_outages",
    v.sql(
        "obs_grid",
        f"""SELECT station_id, run_start, run_end, len AS gap_hours, year(run_start) AS year, {_SEASON} AS season,
        CASE WHEN run_end < TIMESTAMP '{CUT}' THEN 'train' WHEN run_start >= TIMESTAMP '{CUT}' THEN 'test' ELSE 'train+test' END AS split_tag FROM runs_m WHERE state ORDER BY len DESC, station_id, run_start LIMIT 10""",
        _MISS,
    ),
)
def _(spark, sf):
    return grid.top_outages(v.obs_grid(spark, sf), 10, CUT)


@query(
    "missing_block_histogram",
    v.sql(
        "obs_grid",
        "SELECT station_id, len AS gap_hours, count(*) AS n_runs, CASE WHEN len = 1 THEN 'isolated' ELSE 'outage' END AS kind, sum(len)::BIGINT AS hours FROM runs_m WHERE state GROUP BY station_id, len",
        _MISS,
    ),
)
def _(spark, sf):
    return grid.missing_histogram(v.obs_grid(spark, sf))


_ZERO = "(SELECT station_id, timestamp, CASE WHEN pm25 BETWEEN 40 AND 46.5 THEN 0.0 ELSE pm25 END AS z FROM obs_grid)"


@query(
    "zero_streaks",
    v.sql(
        "obs_grid",
        "SELECT station_id, run_start, run_end, len AS streak_hours FROM runs_z WHERE state AND len >= 6",
        RUNS.format("coalesce(z = 0, false)", "z", _ZERO),
    ),
)
def _(spark, sf):
    zeroed = v.obs_grid(spark, sf).select(
        "station_id", "timestamp", F.when(F.col("pm25").between(40, 46.5), 0.0).otherwise(F.col("pm25")).alias("z")
    )
    return grid.zero_streaks(zeroed, "z")


@query(
    "sampling_interval_profile",
    v.sql(
        "obs_hourly",
        """SELECT station_id, count(d) AS n_steps, round(avg(d), 6) AS mean_step, round(min(d), 6) AS min_step, round(max(d), 6) AS max_step, round(100.0 * count(*) FILTER (d = 1) / count(d), 6) AS exact_hour_pct,
        count(*) FILTER (d <> 1) AS n_irregular, round(quantile_cont(d, 0.5), 6) AS median_step FROM (
          SELECT station_id, epoch(timestamp - lag(timestamp) OVER (PARTITION BY station_id ORDER BY timestamp)) / 3600.0 AS d FROM obs_hourly) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    return grid.sampling_profile(v.obs_hourly(spark, sf))


_SPLIT = f"CASE WHEN timestamp < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS split"
INTERP = """interp AS (
  SELECT *, CASE WHEN pm25 IS NOT NULL THEN pm25 WHEN p1 - p0 - 1 <= {0} THEN v0 + (v1 - v0) * ((h - p0) / (p1 - p0)) END AS pm25_derived FROM (
    SELECT *, last_value(pm25 IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN pm25 IS NOT NULL THEN h END IGNORE NULLS) OVER b AS p0,
      first_value(pm25 IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN pm25 IS NOT NULL THEN h END IGNORE NULLS) OVER f AS p1
    FROM (SELECT station_id, timestamp, pm25, epoch(timestamp) / 3600.0 AS h, {1} FROM obs_grid)
    WINDOW b AS (PARTITION BY station_id, split ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           f AS (PARTITION BY station_id, split ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)))"""


def split_grid(spark, sf):
    split = F.when(F.col("timestamp") < F.lit(CUT).cast("timestamp"), "train").otherwise("test")
    return v.obs_grid(spark, sf).select("station_id", "timestamp", "pm25", split.alias("split"))


@query(
    "short_gap_interpolate",
    v.sql(
        "obs_grid",
        "SELECT station_id, timestamp, split, round(pm25, 6) AS pm25, round(pm25_derived, 6) AS pm25_derived, pm25 IS NULL AND pm25_derived IS NOT NULL AS is_derived FROM interp",
        INTERP.format(2, _SPLIT),
    ),
)
def _(spark, sf):
    return grid.interpolate_short_gaps(split_grid(spark, sf), max_gap=2)


_DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


@query(
    "mask_random",
    v.sql(
        "obs_grid",
        f"""SELECT station_id, timestamp, coalesce(rn <= greatest(1, round(n * 0.1)), false) AS held_out FROM (
          SELECT station_id, timestamp, CASE WHEN pm25 IS NOT NULL THEN row_number() OVER (ORDER BY d NULLS LAST) END AS rn, count(pm25) OVER () AS n
          FROM (SELECT *, CASE WHEN pm25 IS NOT NULL THEN {_DRAW.format("'42:' || station_id || ':' || epoch(timestamp)::BIGINT")} END AS d FROM obs_grid))""",
    ),
)
def _(spark, sf):
    return grid.mask_random(v.obs_grid(spark, sf), 0.1, 42).select("station_id", "timestamp", "held_out")


_STARTS = """starts_{0} AS (
  SELECT station_id, split, make_timestamp(unnest(taken) * 3600000000) AS gap_start, {0} AS gap_hours FROM (SELECT station_id, split,
    list_reduce(list_prepend([]::BIGINT[], list([h] ORDER BY pick)), lambda acc, x: CASE WHEN len(acc) < 40 AND len(list_filter(acc, lambda y: abs(y - x[1]) <= {0})) = 0 THEN list_concat(acc, x) ELSE acc END) AS taken FROM (
    SELECT *, row_number() OVER (PARTITION BY station_id, split ORDER BY ('0x' || substr(md5('42:{0}:' || station_id || ':' || h), 1, 8))::BIGINT, h) AS pick FROM (
      SELECT station_id, timestamp, split, h, sum(s) OVER (PARTITION BY station_id, split ORDER BY h RANGE BETWEEN 1 PRECEDING AND {0} FOLLOWING) AS around
      FROM (SELECT station_id, timestamp, CASE WHEN pm25 IS NOT NULL THEN 1 ELSE 0 END AS s, (epoch(timestamp) / 3600)::BIGINT AS h, {1} FROM obs_grid))
    WHERE around = {0} + 2) GROUP BY station_id, split))"""


@query(
    "mask_contiguous",
    v.sql("obs_grid", "SELECT station_id, split, gap_start, gap_hours FROM starts_2", _STARTS.format(2, _SPLIT)),
)
def _(spark, sf):
    return grid.mask_contiguous(split_grid(spark, sf), 2, 40, 42)


def _interp_scores_sql(gaps, max_gaps):
    ctes = [_STARTS.format(g, _SPLIT) for g in gaps]
    ctes.append("starts AS (" + " UNION ALL ".join(f"SELECT * FROM starts_{g}" for g in gaps) + ")")
    ctes.append(
        """masked AS (SELECT g.station_id, g.split, p.gap_hours, g.timestamp, epoch(g.timestamp) / 3600.0 AS h, CASE WHEN s.station_id IS NOT NULL THEN g.pm25 END AS truth, CASE WHEN s.station_id IS NULL THEN g.pm25 END AS seen
        FROM (SELECT station_id, timestamp, pm25, """
        + _SPLIT
        + """ FROM obs_grid) g CROSS JOIN (SELECT unnest("""
        + str(list(gaps))
        + """) AS gap_hours) p
        LEFT JOIN starts s ON s.station_id = g.station_id AND s.split = g.split AND s.gap_hours = p.gap_hours AND g.timestamp >= s.gap_start AND g.timestamp < s.gap_start + to_hours(p.gap_hours))"""
    )
    ctes.append(
        """scored AS (SELECT station_id, gap_hours, max_gap, CASE WHEN month(timestamp) IN (12,1,2) THEN 'Winter' WHEN month(timestamp) IN (3,4,5) THEN 'Spring' WHEN month(timestamp) IN (6,7,8) THEN 'Summer' ELSE 'Autumn' END AS season, truth,
        CASE WHEN p1 - p0 - 1 <= max_gap THEN v0 + (v1 - v0) * ((h - p0) / (p1 - p0)) END AS est FROM (
        SELECT *, last_value(seen IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN seen IS NOT NULL THEN h END IGNORE NULLS) OVER b AS p0, first_value(seen IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN seen IS NOT NULL THEN h END IGNORE NULLS) OVER f AS p1 FROM masked
        WINDOW b AS (PARTITION BY station_id, split, gap_hours ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY station_id, split, gap_hours ORDER BY h ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
        CROSS JOIN (SELECT unnest("""
        + str(list(max_gaps))
        + """) AS max_gap) WHERE truth IS NOT NULL)"""
    )
    body = """SELECT station_id, gap_hours, max_gap, CASE WHEN grouping(season) = 1 THEN 'ALL' ELSE season END AS season, count(truth) AS n_masked, count(est) AS n_recovered, round(100.0 * count(est) / count(truth), 6) AS recovery_pct,
      round(avg(abs(est - truth)), 6) AS mae, round(sqrt(avg((est - truth) * (est - truth))), 6) AS rmse, round(avg(est - truth), 6) AS bias FROM scored GROUP BY GROUPING SETS ((station_id, gap_hours, max_gap, season), (station_id, gap_hours, max_gap))"""
    return v.sql("obs_grid", body, *ctes)


@query("interpolation_scores", _interp_scores_sql((1, 2, 3), (1, 2, 3)))
def _(spark, sf):
    # the masked table is scored under several settings, so the grid is written once
    base = written(split_grid(spark, sf), "split_grid")
    return grid.interpolation_scores(base, (1, 2, 3), (1, 2, 3), 40, 42)
