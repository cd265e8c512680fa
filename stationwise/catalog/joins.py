"""Joins, set operations and reconciliation (inventory 2.3, 2.7)."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import clean, joins
from . import query, views as v
from .scalars import BOX

CUT = "2024-01-20 00:00:00"


@query(
    "station_in_bounds",
    v.sql(
        "station_dim",
        """SELECT s.station_id, n_rows, CASE WHEN d.station_id IS NULL THEN 'unknown_station' WHEN lat BETWEEN -20 AND 30 AND lon BETWEEN -100 AND 120 THEN 'ok' ELSE 'out_of_bounds' END AS verdict
        FROM (SELECT 'ST' || lpad((c_custkey % 28)::VARCHAR, 3, '0') AS station_id, count(*) AS n_rows FROM customer GROUP BY ALL) s LEFT JOIN station_dim d USING (station_id)""",
    ),
)
def _(spark, sf):
    rows = v.table(spark, sf, "customer").select(
        F.concat(F.lit("ST"), F.lpad((F.col("c_custkey") % 28).cast("string"), 3, "0")).alias("station_id")
    )
    return joins.stations_in_bounds(rows, v.station_dim(spark, sf), BOX)


@query(
    "station_lookup",
    v.sql(
        "station_dim",
        """SELECT lookup_status, station_id, location, count(*) AS n, round(sum(lat), 6) AS lat_sum FROM (
        SELECT CASE WHEN d.source_id IS NULL THEN 'unknown' ELSE 'resolved' END AS lookup_status, d.station_id, d.location, d.lat
        FROM (SELECT l_suppkey % 30 AS source_id FROM lineitem WHERE l_suppkey % 30 <> 7) r LEFT JOIN station_dim d USING (source_id)) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    rows = v.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 30).alias("source_id"))
    dim = v.station_dim(spark, sf)
    blocked = dim.filter("source_id = 7").select("source_id")
    return (
        joins.station_lookup(rows, dim, "source_id", blocked)
        .groupBy("lookup_status", "station_id", "location")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("lat").alias("lat_sum"))
    )


_WNULL = ", ".join(f"count({c}) = 0 AS {c}_all_null" for c in v.WEATHER)


@query(
    "join_air_weather",
    v.sql(
        "obs_grid weather_hourly",
        f"""SELECT station_id, count(*) AS n_rows, count(*) FILTER (m) AS n_matched, round(100.0 * count(*) FILTER (m) / count(*), 6) AS match_pct, {_WNULL}
        FROM (SELECT a.station_id, w.timestamp IS NOT NULL AS m, w.* EXCLUDE (timestamp) FROM obs_grid a LEFT JOIN weather_hourly w ON a.timestamp = w.timestamp) GROUP BY station_id""",
    ),
)
def _(spark, sf):
    air = v.obs_grid(spark, sf).select("station_id", "timestamp", "pm25", "pm10")
    return joins.match_coverage(joins.join_air_weather(air, v.weather_hourly(spark, sf)), v.WEATHER)


@query(
    "lookup_many_to_one",
    v.sql(
        "obs_grid weather_hourly",
        """SELECT a.station_id, count(*) AS n, sum(CASE WHEN w.relative_humidity > 60 THEN 1 ELSE 0 END)::BIGINT AS n_humid, round(avg(w.relative_humidity), 6) AS mean_rh
        FROM obs_grid a LEFT JOIN weather_hourly w ON a.timestamp = w.timestamp GROUP BY ALL""",
    ),
)
def _(spark, sf):
    dim = v.weather_hourly(spark, sf).select("timestamp", F.col("relative_humidity").alias("rh"))
    air = v.obs_grid(spark, sf).select("station_id", "timestamp")
    return (
        joins.lookup_many_to_one(air, dim, ["timestamp"])
        .groupBy("station_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum((F.coalesce(F.col("rh") > 60, F.lit(False))).cast("long")).alias("n_humid"),
            F.avg("rh").alias("mean_rh"),
        )
    )


@query(
    "humidity_flag",
    v.sql(
        "obs_hourly weather_hourly",
        """SELECT a.station_id, count(*) AS n, sum(CASE WHEN w.relative_humidity > 90 THEN 1 ELSE 0 END)::BIGINT AS n_flagged
        FROM obs_hourly a LEFT JOIN weather_hourly w ON a.timestamp = w.timestamp GROUP BY ALL""",
    ),
)
def _(spark, sf):
    flagged = joins.humidity_by_lookup(v.obs_hourly(spark, sf).select("station_id", "timestamp"), v.weather_hourly(spark, sf))
    return flagged.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.sum("is_high_humidity").alias("n_flagged"))


@query(
    "overlap_coverage",
    v.sql(
        "obs_hourly weather_hourly",
        """SELECT (SELECT count(*) FROM l) AS n_left, (SELECT count(*) FROM r) AS n_right, count(*) AS n_overlap,
        round(100.0 * count(DISTINCT timestamp) / (SELECT count(DISTINCT timestamp) FROM l), 6) AS overlap_pct,
        count(*) > greatest((SELECT count(*) FROM l), (SELECT count(*) FROM r)) AS row_explosion,
        round(100.0 - 100.0 * count(wind_direction) / count(*), 6) AS missing_pct_wind_direction,
        round(100.0 - 100.0 * count(precipitation) / count(*), 6) AS missing_pct_precipitation
        FROM l JOIN r USING (timestamp)""",
        "l AS (SELECT * FROM obs_hourly WHERE station_id <> 'view')",
        "r AS (SELECT * FROM weather_hourly WHERE timestamp < TIMESTAMP '2024-01-25')",
    ),
)
def _(spark, sf):
    left = v.obs_hourly(spark, sf).filter("station_id <> 'view'")
    right = v.weather_hourly(spark, sf).filter("timestamp < timestamp'2024-01-25'")
    return joins.overlap_coverage(left, right, "timestamp", ["wind_direction", "precipitation"])


@query(
    "spine_left_join",
    v.sql(
        "obs_grid",
        """SELECT station_id, CASE WHEN pm25 IS NULL THEN 'missing' ELSE 'observed' END AS status, count(*) AS n, min(timestamp) AS first_hour FROM obs_grid GROUP BY ALL""",
    ),
)
def _(spark, sf):
    status = F.when(F.col("pm25").isNull(), "missing").otherwise("observed")
    return (
        v.obs_grid(spark, sf)
        .groupBy("station_id", status.alias("status"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_hour"))
    )


@query(
    "lag_exact",
    v.sql(
        "obs_hourly",
        """SELECT a.station_id, a.timestamp, round(a.pm25, 6) AS pm25, round(b.pm25, 6) AS pm25_lag24 FROM obs_hourly a LEFT JOIN obs_hourly b ON a.station_id = b.station_id AND b.timestamp = a.timestamp - INTERVAL 24 HOUR""",
    ),
)
def _(spark, sf):
    return joins.value_at_offset(v.obs_hourly(spark, sf), 24, "pm25", "pm25_lag24").select(
        "station_id", "timestamp", "pm25", "pm25_lag24"
    )


@query(
    "lead_horizon_label",
    v.sql(
        "obs_hourly",
        """SELECT a.station_id, a.timestamp, b.y AS future_label, CASE WHEN a.timestamp < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS part
        FROM l a LEFT JOIN l b ON a.station_id = b.station_id AND b.timestamp = a.timestamp + INTERVAL 6 HOUR
        WHERE NOT (a.timestamp < TIMESTAMP '2024-01-20' AND a.timestamp + INTERVAL 6 HOUR >= TIMESTAMP '2024-01-20')""",
        "l AS (SELECT station_id, timestamp, CASE WHEN pm25 >= 50 THEN 1 WHEN pm25 < 50 THEN 0 END AS y FROM obs_hourly)",
    ),
)
def _(spark, sf):
    labelled = v.obs_hourly(spark, sf).select("station_id", "timestamp", (F.col("pm25") >= 50).cast("int").alias("y"))
    return joins.horizon_label(labelled, "y", 6, CUT).drop("y")


@query(
    "cell_diff",
    v.sql(
        "obs_hourly",
        """SELECT "column", count(*) FILTER (o IS NULL AND w IS NOT NULL) AS fabricated, count(*) FILTER (o IS NOT NULL AND w IS NULL) AS lost,
        count(*) FILTER (abs(w - o) > 1e-8 + 1e-5 * abs(o)) AS mutated, count(*) FILTER (abs(w - o) <= 1e-8 + 1e-5 * abs(o)) AS unchanged FROM (
          SELECT 'pm25' AS "column", a.pm25 AS o, b.pm25 AS w FROM a FULL JOIN b USING (station_id, timestamp)
          UNION ALL SELECT 'pm10', a.pm10, b.pm10 FROM a FULL JOIN b USING (station_id, timestamp)) GROUP BY ALL""",
        "a AS (SELECT * FROM obs_hourly)",
        "b AS (SELECT station_id, timestamp, CASE WHEN pm25 <= 45 THEN coalesce(pm25, 0.0) END AS pm25, CASE WHEN hour(timestamp) = 3 THEN pm10 + 1 ELSE pm10 END AS pm10 FROM obs_hourly WHERE hour(timestamp) <> 5)",
    ),
)
def _(spark, sf):
    before = v.obs_hourly(spark, sf)
    after = before.filter(F.hour("timestamp") != 5).select(
        "station_id",
        "timestamp",
        F.when(F.col("pm25") <= 45, F.col("pm25")).alias("pm25"),
        F.when(F.hour("timestamp") == 3, F.col("pm10") + 1).otherwise(F.col("pm10")).alias("pm10"),
    )
    return joins.cell_diff(before, after, ["station_id", "timestamp"], ["pm25", "pm10"])


@query(
    "reconcile_tables",
    v.sql(
        "obs_hourly",
        """SELECT "column", verdict, count(*) AS n FROM (
          SELECT unnest(['n', 'mean_v']) AS "column", unnest([CASE WHEN b.n IS NULL THEN 'only_reported' WHEN a.n IS NULL THEN 'only_recomputed' WHEN a.n = b.n THEN 'match' ELSE 'mismatch' END,
            CASE WHEN b.n IS NULL THEN 'only_reported' WHEN a.n IS NULL THEN 'only_recomputed' WHEN a.m IS NOT DISTINCT FROM b.m OR abs(a.m - b.m) <= 1e-6 + 1e-6 * abs(b.m) THEN 'match' ELSE 'mismatch' END]) AS verdict
          FROM a FULL JOIN b USING (station_id, day)) GROUP BY ALL""",
        "d AS (SELECT station_id, CAST(timestamp AS DATE) AS day, count(*) AS n, avg(pm25) AS m FROM obs_hourly GROUP BY ALL)",
        "a AS (SELECT station_id, day, CASE WHEN day(day) % 6 = 0 THEN n + 1 ELSE n END AS n, CASE WHEN day(day) % 5 = 0 THEN m * 1.01 ELSE m END AS m FROM d WHERE day(day) % 7 <> 0)",
        "b AS (SELECT * FROM d WHERE day(day) % 11 <> 0)",
    ),
)
def _(spark, sf):
    d = (
        v.obs_hourly(spark, sf)
        .groupBy("station_id", F.col("timestamp").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("pm25").alias("mean_v"))
    )
    dom = F.dayofmonth("day")
    reported = d.filter(dom % 7 != 0).withColumns(
        {
            "n": F.when(dom % 6 == 0, F.col("n") + 1).otherwise(F.col("n")),
            "mean_v": F.when(dom % 5 == 0, F.col("mean_v") * 1.01).otherwise(F.col("mean_v")),
        }
    )
    return joins.reconcile(reported, d.filter(dom % 11 != 0), ["station_id", "day"], ["n"], ["mean_v"], 1e-6, 1e-6)


PERIODS_SQL = """periods AS (
  SELECT *, unnest([{'t': 'station', 'p': 'all', 's': NULL::TIMESTAMP, 'e': NULL::TIMESTAMP},
    {'t': 'year', 'p': year(timestamp)::VARCHAR, 's': date_trunc('year', timestamp)::TIMESTAMP, 'e': (date_trunc('year', timestamp) + INTERVAL 1 YEAR)::TIMESTAMP},
    {'t': 'month', 'p': strftime(timestamp, '%Y-%m'), 's': date_trunc('month', timestamp)::TIMESTAMP, 'e': (date_trunc('month', timestamp) + INTERVAL 1 MONTH)::TIMESTAMP},
    {'t': CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'winter_year' ELSE 'season_year' END,
     'p': CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'Winter (Dec-Feb)' WHEN month(timestamp) < 6 THEN 'Spring (Mar-May)' WHEN month(timestamp) < 9 THEN 'Summer (Jun-Aug)' ELSE 'Autumn (Sep-Nov)' END
        || ':' || (year(timestamp) + CASE WHEN month(timestamp) = 12 THEN 1 ELSE 0 END)::VARCHAR,
     's': make_timestamp(CASE WHEN month(timestamp) < 3 THEN year(timestamp) - 1 ELSE year(timestamp) END, CASE WHEN month(timestamp) IN (12, 1, 2) THEN 12 WHEN month(timestamp) < 6 THEN 3 WHEN month(timestamp) < 9 THEN 6 ELSE 9 END, 1, 0, 0, 0.0),
     'e': (make_timestamp(CASE WHEN month(timestamp) < 3 THEN year(timestamp) - 1 ELSE year(timestamp) END, CASE WHEN month(timestamp) IN (12, 1, 2) THEN 12 WHEN month(timestamp) < 6 THEN 3 WHEN month(timestamp) < 9 THEN 6 ELSE 9 END, 1, 0, 0, 0.0) + INTERVAL 3 MONTH)::TIMESTAMP}]) AS q
  FROM base)"""


@query(
    "period_membership",
    v.sql(
        "daily_long",
        """SELECT station_id, q.t AS period_type, q.p AS period, q.s AS period_start, q.e AS period_end, count(*) AS n, round(avg(v), 6) AS mean_v FROM periods GROUP BY ALL""",
        "base AS (SELECT station_id, date::TIMESTAMP AS timestamp, v FROM daily_long)",
        PERIODS_SQL,
    ),
)
def _(spark, sf):
    df = v.daily_long(spark, sf).withColumn("timestamp", F.col("date").cast("timestamp"))
    return (
        joins.with_periods(df)
        .groupBy("station_id", "period_type", "period", "period_start", "period_end")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_v"))
    )


@query(
    "station_pair_overlap",
    v.sql(
        "obs_hourly",
        """SELECT a.station_id AS station_a, b.station_id AS station_b, greatest(a.lo, b.lo) <= least(a.hi, b.hi) AS has_overlap,
        CASE WHEN greatest(a.lo, b.lo) <= least(a.hi, b.hi) THEN greatest(a.lo, b.lo) END AS overlap_start, CASE WHEN greatest(a.lo, b.lo) <= least(a.hi, b.hi) THEN least(a.hi, b.hi) END AS overlap_end,
        (SELECT count(*) FROM h x JOIN h y ON x.timestamp = y.timestamp WHERE x.station_id = a.station_id AND y.station_id = b.station_id) AS shared_hours,
        CASE WHEN greatest(a.lo, b.lo) <= least(a.hi, b.hi) THEN 0.0 ELSE round(epoch(greatest(a.lo, b.lo) - least(a.hi, b.hi)) / 3600.0, 6) END::DOUBLE AS gap_hours FROM s a JOIN s b ON a.station_id < b.station_id""",
        "h AS (SELECT DISTINCT station_id, timestamp FROM obs_hourly WHERE NOT (station_id = 'view' AND timestamp >= TIMESTAMP '2024-01-09') AND NOT (station_id = 'click' AND timestamp < TIMESTAMP '2024-01-12'))",
        "s AS (SELECT station_id, min(timestamp) AS lo, max(timestamp) AS hi FROM h GROUP BY ALL)",
    ),
)
def _(spark, sf):
    t = F.col("timestamp")
    df = v.obs_hourly(spark, sf).filter(
        ~((F.col("station_id") == "view") & (t >= "2024-01-09")) & ~((F.col("station_id") == "click") & (t < "2024-01-12"))
    )
    # all stations of the events table form one network, whatever their names and number
    pairs = joins.pairs_within(df.select("station_id").withColumn("network", F.lit("events")), "network")
    return joins.station_pair_overlap(df, pairs)


@query(
    "source_hours_in_grid",
    v.sql(
        "obs_clean obs_hourly",
        """SELECT c.station_id, count(DISTINCT c.timestamp) AS source_hours FROM obs_clean c WHERE EXISTS (SELECT 1 FROM obs_hourly o WHERE o.station_id = c.station_id AND o.timestamp = c.timestamp AND o.timestamp >= TIMESTAMP '2024-01-10') GROUP BY ALL""",
    ),
)
def _(spark, sf):
    grid = v.obs_hourly(spark, sf).filter("timestamp >= timestamp'2024-01-10'")
    return joins.source_hours_in_grid(v.obs_clean(spark, sf), grid, ["station_id", "timestamp"])


@query(
    "union_stations",
    v.sql(
        "obs_hourly weather_hourly",
        """SELECT station_id, count(*) AS n, count(pm25) AS n_pm25, round(avg(relative_humidity), 6) AS mean_rh FROM (
        SELECT station_id, timestamp, pm25, relative_humidity FROM obs_hourly UNION ALL SELECT 'WEATHER', timestamp, NULL, relative_humidity FROM weather_hourly) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    air = v.obs_hourly(spark, sf).drop("pm10")
    weather = v.weather_hourly(spark, sf).select(F.lit("WEATHER").alias("station_id"), "timestamp", "relative_humidity")
    both = air.unionByName(weather, allowMissingColumns=True)
    return both.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("pm25").alias("n_pm25"), F.avg("relative_humidity").alias("mean_rh")
    )


@query(
    "key_intersection",
    """SELECT count(*) AS n_shared, min(k) AS lowest, max(k) AS highest FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def _(spark, sf):
    o = v.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    li = v.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return o.intersect(li).agg(F.count(F.lit(1)).alias("n_shared"), F.min("k").alias("lowest"), F.max("k").alias("highest"))


@query(
    "key_difference",
    """SELECT side, count(*) AS n, min(k) AS lowest FROM (
    SELECT 'only_orders' AS side, o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
    UNION ALL SELECT DISTINCT 'only_lines', l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')) GROUP BY ALL""",
)
def _(spark, sf):
    o = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    li = v.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    left = o.join(li, "k", "left_anti").select(F.lit("only_orders").alias("side"), "k")
    right = (
        li.distinct().join(o.filter("o_orderstatus = 'F'"), "k", "left_anti").select(F.lit("only_lines").alias("side"), "k")
    )
    return left.unionByName(right).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lowest"))


@query(
    "evidence_compare",
    v.sql(
        "daily_calendar",
        """SELECT test, CASE WHEN test = 'season_effect' THEN 'EXPLORATORY / INCOMPARABLE' WHEN ea IS NULL OR eb IS NULL OR la IS NULL OR lb IS NULL THEN 'UNVERIFIED'
        WHEN sign(ea) <> sign(eb) OR ea = 0 THEN 'INCOMPARABLE (effect direction differs across physical stations)'
        WHEN pa < 0.05 AND pb < 0.05 AND greatest(la, lb) <= least(ha, hb) THEN 'CONCORDANT DIRECTION; OVERLAPPING CI' WHEN pa < 0.05 AND pb < 0.05 THEN 'CONCORDANT DIRECTION; DIFFERENT MAGNITUDE'
        WHEN pa < 0.05 OR pb < 0.05 THEN 'WEAKENED / NOT REPLICATED AT ONE STATION' ELSE 'NO EVIDENCE OF EFFECT IN EITHER STATION' END AS classification,
        CASE WHEN test <> 'season_effect' AND ea IS NOT NULL AND eb IS NOT NULL AND la IS NOT NULL AND lb IS NOT NULL THEN sign(ea) = sign(eb) AND ea <> 0 END AS same_direction,
        CASE WHEN test <> 'season_effect' AND ea IS NOT NULL AND eb IS NOT NULL AND la IS NOT NULL AND lb IS NOT NULL THEN greatest(la, lb) <= least(ha, hb) END AS ci_overlap FROM (
          SELECT test, max(e) FILTER (station_id LIKE '1%') AS ea, max(e) FILTER (station_id LIKE '2%') AS eb, max(e - h) FILTER (station_id LIKE '1%') AS la, max(e - h) FILTER (station_id LIKE '2%') AS lb,
            max(e + h) FILTER (station_id LIKE '1%') AS ha, max(e + h) FILTER (station_id LIKE '2%') AS hb, max(p) FILTER (station_id LIKE '1%') AS pa, max(p) FILTER (station_id LIKE '2%') AS pb
          FROM t WHERE station_id LIKE '1%' OR station_id LIKE '2%' GROUP BY test)""",
        """t AS (SELECT station_id, CASE isodow(date) WHEN 1 THEN 'season_effect' ELSE 'dow_' || isodow(date) END AS test, avg(value) - 255 AS e, 2 * stddev_samp(value) / sqrt(count(value)) AS h,
             CASE WHEN abs(avg(value) - 255) > 2 * stddev_samp(value) / sqrt(count(value)) THEN 0.01 ELSE 0.5 END AS p FROM daily_calendar GROUP BY ALL)""",
    ),
)
def _(spark, sf):
    days = v.daily_calendar(spark, sf)
    dow = F.weekday("date") + 1
    half = 2 * F.stddev_samp("value") / F.sqrt(F.count("value"))
    e = F.avg("value") - 255
    t = days.groupBy(
        "station_id",
        F.when(dow == 1, "season_effect").otherwise(F.concat(F.lit("dow_"), dow.cast("string"))).alias("test"),
    ).agg(
        e.alias("estimate"),
        (e - half).alias("ci_low"),
        (e + half).alias("ci_high"),
        F.when(F.abs(e) > half, 0.01).otherwise(0.5).alias("holm_p"),
    )
    return joins.compare_evidence(t.filter("station_id like '1%'"), t.filter("station_id like '2%'"))


@query(
    "chrono_order_check",
    """SELECT o_orderpriority AS station_id, count(*) AS n_rows, count(*) FILTER (d < p) AS n_out_of_order, count(*) FILTER (d = p) AS n_equal_times, count(*) FILTER (d < p) = 0 AS is_ordered
    FROM (SELECT o_orderpriority, o_orderdate AS d, lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS p FROM orders) GROUP BY ALL""",
)
def _(spark, sf):
    o = v.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("station_id"), "o_orderkey", "o_orderdate")
    return clean.chronology(o, ["station_id"], "o_orderkey", "o_orderdate", size=4096)


@query(
    "top_k",
    """SELECT * FROM (SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)""",
)
def _(spark, sf):
    return (
        v.table(spark, sf, "orders")
        .select("o_orderkey", "o_totalprice")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .limit(25)
    )


@query(
    "top_k_per_group",
    """SELECT station_id, o_orderkey, o_totalprice FROM (SELECT o_orderpriority AS station_id, o_orderkey, round(o_totalprice, 6) AS o_totalprice,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5""",
)
def _(spark, sf):
    """The rank limit is applied before the shuffle, so each task sends at most five rows per group."""
    w = W.partitionBy("station_id").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = v.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("station_id"), "o_orderkey", "o_totalprice")
    return o.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").drop("rn")


@query(
    "arg_extreme",
    v.sql(
        "obs_clean",
        """SELECT station_id, max(pm25) AS peak, arg_max(seq, (pm25, -seq)) FILTER (pm25 IS NOT NULL) AS peak_seq, min(pm25) AS trough, arg_min(seq, (pm25, seq)) FILTER (pm25 IS NOT NULL) AS trough_seq FROM obs_clean GROUP BY ALL""",
    ),
)
def _(spark, sf):
    has = F.col("pm25").isNotNull()
    return v.obs_clean(spark, sf).groupBy("station_id").agg(
        F.max("pm25").alias("peak"),
        F.max_by("seq", F.when(has, F.struct("pm25", -F.col("seq")))).alias("peak_seq"),
        F.min("pm25").alias("trough"),
        F.min_by("seq", F.when(has, F.struct("pm25", "seq"))).alias("trough_seq"),
    )
