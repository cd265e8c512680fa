"""Row-level cleaning rules, calendar keys and labels (inventory 2.2)."""

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from ..operators import clean
from . import query, views as v

BOX = (-20.0, -100.0, 30.0, 120.0)


@query(
    "null_normalise",
    v.sql(
        "obs_raw",
        """SELECT station_id, count(x) FILTER (NOT isnan(x)) AS n_kept,
        count(*) FILTER (isnan(x)) AS n_nan, count(*) FILTER (isinf(x)) AS n_nonfinite,
        round(avg(x) FILTER (NOT isnan(x) AND NOT isinf(x)), 6) AS mean_finite
        FROM (SELECT station_id, CASE WHEN seq % 41 = 0 THEN 'NaN'::DOUBLE WHEN seq % 43 = 0 THEN 'Infinity'::DOUBLE
              ELSE value END AS x FROM obs_raw) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    raw = v.obs_raw(spark, sf)
    x = (
        F.when(F.col("seq") % 41 == 0, float("nan"))
        .when(F.col("seq") % 43 == 0, float("inf"))
        .otherwise(F.col("value"))
    )
    clean_x = fn.null_normalise("x")
    return (
        raw.select("station_id", x.alias("x"))
        .groupBy("station_id")
        .agg(
            F.count(clean_x).alias("n_kept"),
            F.count_if(F.isnan("x")).alias("n_nan"),
            F.count_if(fn.is_nonfinite("x")).alias("n_nonfinite"),
            F.avg(F.when(~fn.is_nonfinite("x"), clean_x)).alias("mean_finite"),
        )
    )


@query(
    "bbox_filter",
    v.sql(
        "station_dim",
        """SELECT count(*) AS n_rows, count(*) FILTER (k) AS n_kept, count(*) FILTER (NOT k) AS n_dropped,
        round(100.0 * count(*) FILTER (k) / count(*), 6) AS kept_pct
        FROM (SELECT coalesce(lat BETWEEN -20 AND 30 AND lon BETWEEN -100 AND 120, false) AS k
              FROM customer LEFT JOIN station_dim ON c_nationkey = source_id)""",
    ),
)
def _(spark, sf):
    rows = v.table(spark, sf, "customer").join(
        v.station_dim(spark, sf), F.col("c_nationkey") == F.col("source_id"), "left"
    )
    keep = fn.in_box("lat", "lon", BOX)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(keep).alias("n_kept"),
        F.count_if(~keep).alias("n_dropped"),
        (100.0 * F.count_if(keep) / F.count(F.lit(1))).alias("kept_pct"),
    )


@query(
    "timestamp_normalise",
    v.sql(
        "obs_raw",
        """SELECT kind, count(*) AS n, count(parsed) AS n_parsed, count(*) FILTER (txt IS NOT NULL AND parsed IS NULL) AS n_unparsable,
        min(parsed) AS first_instant, max(parsed) AS last_instant FROM (
          SELECT CASE seq % 4 WHEN 0 THEN 'naive' WHEN 1 THEN 'utc' WHEN 2 THEN 'offset' ELSE 'broken' END AS kind,
            seq AS txt,
            CASE seq % 4 WHEN 0 THEN date_trunc('second', ts)::TIMESTAMP - INTERVAL 7 HOUR
              WHEN 1 THEN date_trunc('second', ts)::TIMESTAMP
              WHEN 2 THEN date_trunc('second', ts)::TIMESTAMP - INTERVAL 7 HOUR ELSE NULL END AS parsed FROM obs_raw)
        GROUP BY kind""",
    ),
)
def _(spark, sf):
    base = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kind = F.col("seq") % 4
    raw = v.obs_raw(spark, sf).select(
        F.when(kind == 0, "naive").when(kind == 1, "utc").when(kind == 2, "offset").otherwise("broken").alias("kind"),
        F.when(kind == 0, base)
        .when(kind == 1, F.concat(base, F.lit("Z")))
        .when(kind == 2, F.concat(base, F.lit("+07:00")))
        .otherwise("not a time")
        .alias("txt"),
    )
    parsed = raw.withColumn("parsed", fn.parsed_time("txt"))
    return parsed.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("parsed").alias("n_parsed"),
        F.count_if(F.col("txt").isNotNull() & F.col("parsed").isNull()).alias("n_unparsable"),
        F.min("parsed").alias("first_instant"),
        F.max("parsed").alias("last_instant"),
    )


@query(
    "timestamp_multi_format",
    v.sql(
        "obs_raw",
        """SELECT seq % 3 AS layout, count(*) AS n, count(*) FILTER (seq % 3 < 2) AS n_parsed,
        min(CASE WHEN seq % 3 < 2 THEN date_trunc('minute', ts)::TIMESTAMP END) AS first_time,
        sum(CASE WHEN seq % 3 < 2 THEN extract(hour FROM ts) END)::BIGINT AS hour_sum
        FROM obs_raw GROUP BY ALL""",
    ),
)
def _(spark, sf):
    layout = F.col("seq") % 3
    txt = (
        F.when(layout == 0, F.date_format("ts", "yyyy-MM-dd hh:mm a"))
        .when(layout == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
        .otherwise("n/a")
    )
    df = v.obs_raw(spark, sf).select(layout.alias("layout"), fn.parsed_agency_time(txt).alias("t"))
    return df.groupBy("layout").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("t").alias("n_parsed"),
        F.min("t").alias("first_time"),
        F.sum(F.hour("t")).alias("hour_sum"),
    )


@query(
    "disguised_missing",
    v.sql(
        "obs_fault",
        """SELECT 'raw_value' AS "column", count(*) FILTER (raw_value = 'N/A') AS marker, count(*) FILTER (raw_value = '-999') AS sentinel,
        0::BIGINT AS unparsable, count(*) FILTER (raw_value NOT IN ('N/A', '-999')) AS kept,
        count(*) FILTER (TRY_CAST(raw_value AS DOUBLE) = 0) AS zero_kept FROM obs_fault
        UNION ALL SELECT 'pm10_raw', 0, count(*) FILTER (pm10_raw IN (-999, -9999)), 0, count(pm10_raw), count(*) FILTER (pm10_raw = 0) FROM obs_fault""",
    ),
)
def _(spark, sf):
    df = v.obs_fault(spark, sf).withColumn("pm10_raw", F.col("pm10_raw").cast("string"))
    return clean.marker_counts(df, ["raw_value", "pm10_raw"])


@query(
    "nonnegative_rule",
    v.sql(
        "obs_fault",
        """SELECT station_id, count(*) AS n, count(*) FILTER (x < 0) AS n_below_zero, count(x) FILTER (x >= 0) AS n_kept,
        round(min(x) FILTER (x >= 0), 6) AS lowest_kept, round(max(x), 6) AS highest
        FROM (SELECT station_id, TRY_CAST(raw_value AS DOUBLE) AS x FROM obs_fault) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    x = fn.parsed_number("raw_value")
    return (
        v.obs_fault(spark, sf)
        .select("station_id", x.alias("x"), fn.nonnegative(x).alias("kept"))
        .groupBy("station_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("x") < 0).alias("n_below_zero"),
            F.count("kept").alias("n_kept"),
            F.min("kept").alias("lowest_kept"),
            F.max("x").alias("highest"),
        )
    )


@query(
    "weather_bounds_rule",
    v.sql(
        "weather_raw",
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS variable, count({c}) AS n_raw, count(k) AS n_kept, round(min(k), 6) AS lowest,
            round(max(k), 6) AS highest, round(avg(k), 6) AS mean FROM (SELECT {c}, {k} AS k FROM weather_raw)"""
            for c, k in {
                "temperature": "CASE WHEN temperature BETWEEN 0 AND 50 THEN temperature END",
                "relative_humidity": "CASE WHEN relative_humidity BETWEEN 0 AND 100 THEN relative_humidity END",
                "wind_speed": "CASE WHEN wind_speed >= 0 THEN wind_speed END",
                "wind_direction": "CASE WHEN wind_direction < 0 THEN NULL WHEN wind_direction > 360 THEN wind_direction - 360 ELSE wind_direction END",
                "precipitation": "CASE WHEN precipitation >= 0 THEN precipitation END",
                "surface_pressure": "CASE WHEN surface_pressure BETWEEN 950 AND 1050 THEN surface_pressure END",
            }.items()
        )
        + ")",
    ),
)
def _(spark, sf):
    raw = v.weather_raw(spark, sf)
    aggs, rows = [], {}
    for c in v.WEATHER:
        k = fn.within_weather_bounds(c, c)
        parts = {
            "n_raw": F.count(c),
            "n_kept": F.count(k),
            "lowest": F.min(k),
            "highest": F.max(k),
            "mean": F.avg(k),
        }
        aggs += [a.alias(f"{c}__{n}") for n, a in parts.items()]
        rows[c] = {n: f"{c}__{n}" for n in parts}
    return clean.stacked(raw.agg(*aggs), rows, "variable")


@query(
    "cleaning_cause_counts",
    v.sql(
        "weather_raw",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS variable, count(*) FILTER ({c} IN (-999, -9999)) AS sentinel, 0::BIGINT AS unparsable,
            count(*) FILTER ({c} NOT IN (-999, -9999) AND {c} IS NOT NULL AND ({lost})) AS out_of_bounds FROM weather_raw"""
            for c, lost in {
                "temperature": "temperature NOT BETWEEN 0 AND 50",
                "relative_humidity": "relative_humidity NOT BETWEEN 0 AND 100",
                "wind_speed": "wind_speed < 0",
                "wind_direction": "wind_direction < 0",
                "precipitation": "precipitation < 0",
                "surface_pressure": "surface_pressure NOT BETWEEN 950 AND 1050",
            }.items()
        ),
    ),
)
def _(spark, sf):
    return clean.cause_counts(v.weather_raw(spark, sf), v.WEATHER)


@query(
    "subset_constraint",
    v.sql(
        "obs_clean",
        """SELECT count(g) AS n_pairs, count(*) FILTER (g > 0) AS n_strict, count(*) FILTER (g > 2.0) AS n_beyond_epsilon,
        round(max(g) FILTER (g > 0), 6) AS largest_inversion, count(pm25) FILTER (NOT coalesce(g > 0, false)) AS fine_kept,
        count(pm10) FILTER (NOT coalesce(g > 0, false)) AS coarse_kept
        FROM (SELECT pm25, pm10, pm25 - pm10 AS g FROM obs_clean)""",
    ),
)
def _(spark, sf):
    df = v.obs_clean(spark, sf)
    kept = clean.enforce_subset(df.withColumns({"f": F.col("pm25"), "c": F.col("pm10")}), "f", "c")
    gap = F.col("pm25") - F.col("pm10")
    return kept.agg(
        F.count(gap).alias("n_pairs"),
        F.count_if(gap > 0).alias("n_strict"),
        F.count_if(gap > S.SUBSET_EPSILON).alias("n_beyond_epsilon"),
        F.max(F.when(gap > 0, gap)).alias("largest_inversion"),
        F.count("f").alias("fine_kept"),
        F.count("c").alias("coarse_kept"),
    )


_QC = """CASE WHEN lower(trim(coalesce(qc, 'Missing'))) <> 'valid' THEN 'qc_' || lower(trim(coalesce(qc, 'Missing')))
 WHEN lower(trim(coalesce(unit, ''))) NOT IN ('ug/m3', 'µg/m3', 'μg/m3', 'ug/m^3', 'µg/m^3', 'μg/m^3') THEN 'invalid_unit'
 WHEN lower(trim(coalesce(dur, ''))) NOT IN ('1 hr', '1h', '1 hour', '60 min', '60 mins') THEN 'invalid_duration'
 WHEN TRY_CAST(raw_value AS DOUBLE) >= 0 THEN 'valid' ELSE 'sentinel_or_invalid_value' END"""


@query(
    "row_qc_verdict",
    v.sql(
        "obs_fault",
        f"""SELECT status, count(*) AS n, count(raw_value) AS n_with_value FROM (SELECT raw_value, {_QC} AS status FROM (
        SELECT raw_value, CASE seq % 10 WHEN 0 THEN NULL WHEN 1 THEN ' Invalid ' WHEN 2 THEN 'Suspect' ELSE 'VALID' END AS qc,
          CASE WHEN seq % 17 = 0 THEN 'ppb' ELSE 'UG/M3' END AS unit, CASE WHEN seq % 19 = 0 THEN '24 hr' ELSE '1 Hr' END AS dur
        FROM obs_fault)) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    seq = F.col("seq")
    df = v.obs_fault(spark, sf).select(
        "raw_value",
        F.when(seq % 10 == 0, None).when(seq % 10 == 1, " Invalid ").when(seq % 10 == 2, "Suspect").otherwise("VALID").alias("qc"),
        F.when(seq % 17 == 0, "ppb").otherwise("UG/M3").alias("unit"),
        F.when(seq % 19 == 0, "24 hr").otherwise("1 Hr").alias("dur"),
    )
    return (
        df.withColumn("status", fn.qc_status("raw_value", "qc", "unit", "dur"))
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("n"), F.count("raw_value").alias("n_with_value"))
    )


@query(
    "cyclical_time",
    v.sql(
        "obs_hourly",
        """SELECT hour, month, count(*) AS n, round(any_value(sin(2 * pi() * hour / 24)), 6) AS hour_sin, round(any_value(cos(2 * pi() * hour / 24)), 6) + 0.0 AS hour_cos,
        round(any_value(sin(2 * pi() * month / 12)), 6) AS month_sin, round(any_value(cos(2 * pi() * month / 12)), 6) AS month_cos
        FROM (SELECT extract(hour FROM timestamp + INTERVAL 7 HOUR) AS hour, extract(month FROM timestamp + INTERVAL 7 HOUR) AS month FROM obs_hourly) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    local = v.obs_hourly(spark, sf).select(fn.local_time("timestamp").alias("t"))
    keyed = local.select(
        F.hour("t").cast("long").alias("hour"),
        F.month("t").cast("long").alias("month"),
        *[c.alias(n) for n, c in fn.cyclical_time("t").items()],
    )
    return keyed.groupBy("hour", "month").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(c).alias(c) for c in ("hour_sin", "hour_cos", "month_sin", "month_cos")],
    )


_SEASON = """CASE WHEN month({0}) IN (12,1,2) THEN 'Winter' WHEN month({0}) IN (3,4,5) THEN 'Spring' WHEN month({0}) IN (6,7,8) THEN 'Summer' ELSE 'Autumn' END"""


@query(
    "season_label",
    v.sql(
        "daily_long",
        f"""SELECT {_SEASON.format('date')} AS season, CASE WHEN month(date) IN (12,1,2) THEN 'Winter (Dec-Feb)' WHEN month(date) IN (3,4,5) THEN 'Spring (Mar-May)'
        WHEN month(date) IN (6,7,8) THEN 'Summer (Jun-Aug)' ELSE 'Autumn (Sep-Nov)' END AS season_long, count(*) AS n, round(avg(v), 6) AS mean_v
        FROM daily_long GROUP BY ALL""",
    ),
)
def _(spark, sf):
    return (
        v.daily_long(spark, sf)
        .groupBy(fn.season("date").alias("season"), fn.season_long("date").alias("season_long"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_v"))
    )


@query(
    "season_year",
    v.sql(
        "daily_long",
        f"""SELECT season_year, count(*) AS n, count(winter_year) AS n_winter, min(date)::VARCHAR AS first_day FROM (
        SELECT date, year(date) + CASE WHEN month(date) = 12 THEN 1 ELSE 0 END AS season_year,
          CASE WHEN month(date) IN (12,1,2) THEN year(date) + CASE WHEN month(date) = 12 THEN 1 ELSE 0 END END AS winter_year FROM daily_long) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    return (
        v.daily_long(spark, sf)
        .select("date", fn.season_year("date").cast("long").alias("season_year"), fn.winter_year("date").alias("wy"))
        .groupBy("season_year")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("wy").alias("n_winter"),
            F.min("date").cast("string").alias("first_day"),
        )
    )


@query(
    "period_keys",
    v.sql(
        "daily_long",
        """SELECT strftime(date, '%Y-%m') AS year_month, printf('%04d-W%02d', isoyear(date), week(date)) AS iso_week, (isodow(date) - 1)::BIGINT AS dow,
        CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END::BIGINT AS is_weekend, count(*) AS n FROM daily_long GROUP BY ALL""",
    ),
)
def _(spark, sf):
    k = fn.period_keys("date")
    return (
        v.daily_long(spark, sf)
        .groupBy(
            k["year_month"].alias("year_month"),
            k["iso_week"].alias("iso_week"),
            k["dow"].cast("long").alias("dow"),
            k["is_weekend"].cast("long").alias("is_weekend"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "calm_and_interaction",
    v.sql(
        "weather_hourly",
        """SELECT count(*) AS n, sum(CASE WHEN wind_speed < 0.5 THEN 1 WHEN wind_speed IS NOT NULL THEN 0 END)::BIGINT AS n_calm, count(wind_speed) AS n_wind,
        round(avg(temperature * relative_humidity), 6) AS mean_product FROM weather_hourly""",
    ),
)
def _(spark, sf):
    return v.weather_hourly(spark, sf).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(fn.calm("wind_speed")).alias("n_calm"),
        F.count(fn.calm("wind_speed")).alias("n_wind"),
        F.avg(F.col("temperature") * F.col("relative_humidity")).alias("mean_product"),
    )


_TIER = """CASE WHEN {0} IS NULL THEN NULL WHEN {0} < 15 THEN '<15' WHEN {0} < 25 THEN '15-<25' WHEN {0} < 37.5 THEN '25-<37.5' WHEN {0} < 50 THEN '37.5-<50' WHEN {0} < 75 THEN '50-<75' ELSE '>=75' END"""


@query(
    "tier_bin",
    v.sql(
        "obs_hourly",
        f"SELECT tier, count(*) AS n, round(min(pm25), 6) AS lowest, round(max(pm25), 6) AS highest FROM (SELECT {_TIER.format('pm25')} AS tier, pm25 FROM obs_hourly WHERE pm25 IS NOT NULL) GROUP BY ALL",
    ),
)
def _(spark, sf):
    return (
        v.obs_hourly(spark, sf)
        .filter("pm25 is not null")
        .groupBy(fn.tier("pm25").alias("tier"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("pm25").alias("lowest"), F.max("pm25").alias("highest"))
    )


@query(
    "sector16",
    v.sql(
        "weather_raw",
        """SELECT CAST(floor(((d + 11.25) % 360) / 22.5) AS BIGINT) AS sector, count(*) AS n FROM
        (SELECT CASE WHEN wind_direction > 360 THEN wind_direction - 360 ELSE wind_direction END AS d FROM weather_raw WHERE wind_direction >= 0) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    d = fn.within_weather_bounds("wind_direction", "wind_direction")
    return (
        v.weather_raw(spark, sf)
        .select(fn.sector16(d).cast("long").alias("sector"))
        .filter("sector is not null")
        .groupBy("sector")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "log1p_diagnostic",
    v.sql(
        "obs_hourly",
        """SELECT *, abs(skew_log1p) < abs(skew_raw) AS improves FROM (SELECT station_id, count(pm25) AS n, count(*) FILTER (pm25 < 0) AS n_negative, round(skewness(pm25), 6) AS skew_raw,
        round(skewness(ln(1 + pm25)), 6) AS skew_log1p, round(kurtosis(pm25), 6) AS kurt_raw, round(kurtosis(ln(1 + pm25)), 6) AS kurt_log1p FROM obs_hourly GROUP BY ALL)""",
    ),
)
def _(spark, sf):
    return clean.log1p_diagnostic(v.obs_hourly(spark, sf), ["station_id"], "pm25")


@query(
    "haversine_km",
    v.sql(
        "station_dim",
        """SELECT station_id, glat, glon, round(2 * 6371.0088 * asin(sqrt(least(greatest(power(sin(radians(glat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(glat)) * power(sin(radians(glon - lon) / 2), 2), 0), 1))), 6) AS km
        FROM (SELECT *, round(lat * 4) / 4 AS glat, round(lon * 4) / 4 AS glon FROM station_dim)""",
    ),
)
def _(spark, sf):
    """Distance from each station to its quarter-degree weather cell, found arithmetically."""
    dim = v.station_dim(spark, sf)
    cells = dim.withColumns({"glat": F.round(F.col("lat") * 4) / 4, "glon": F.round(F.col("lon") * 4) / 4})
    return cells.select("station_id", "glat", "glon", fn.haversine_km("lat", "lon", "glat", "glon").alias("km"))


_CUT = "TIMESTAMP '2024-01-20'"


@query(
    "persistence_score",
    v.sql(
        "obs_grid",
        f"""SELECT g.station_id, count(*) AS n, round(avg(1 / (1 + exp(-greatest(-30, least(30, (coalesce(pm25, med) - 50) / 15))))), 6) AS mean_score,
        sum(CASE WHEN pm25 >= 50 THEN 1 ELSE 0 END)::BIGINT AS n_hard FROM obs_grid g
        JOIN (SELECT station_id, quantile_cont(pm25, 0.5) AS med FROM obs_grid WHERE timestamp < {_CUT} GROUP BY ALL) m USING (station_id) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    train = F.col("timestamp") < F.lit("2024-01-20").cast("timestamp")
    scored = clean.with_persistence(v.obs_grid(spark, sf), ["station_id"], "pm25", train)
    return scored.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.sum("hard").alias("n_hard")
    )


@query(
    "single_station",
    v.sql(
        "obs_hourly",
        """SELECT station_id, sum(c)::BIGINT AS n_rows, sum(c - 1)::BIGINT AS n_duplicate, count(*) FILTER (station_id IS NULL OR trim(station_id) = '') AS n_blank
        FROM (SELECT station_id, timestamp, count(*) AS c FROM obs_hourly GROUP BY ALL) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    per_key = v.obs_hourly(spark, sf).groupBy("station_id", "timestamp").agg(F.count(F.lit(1)).alias("c"))
    blank = F.col("station_id").isNull() | (F.trim("station_id") == "")
    return per_key.groupBy("station_id").agg(
        F.sum("c").alias("n_rows"), F.sum(F.col("c") - 1).alias("n_duplicate"), F.count_if(blank).alias("n_blank")
    )


@query(
    "file_period_parse",
    """SELECT CASE WHEN name LIKE '%_YTD%' THEN 'YTD' WHEN regexp_matches(name, '_[0-9]{2}_MTD') THEN 'MTD' END AS period_type,
        CASE WHEN regexp_matches(name, '_[0-9]{2}_MTD') THEN CAST(regexp_extract(name, '_([0-9]{2})_MTD', 1) AS BIGINT) END AS period_month, count(*) AS n
        FROM (SELECT 'HANOI_PM2.5_' || CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) || '_YTD.CSV' ELSE year(o_orderdate) || '_' || lpad(month(o_orderdate)::VARCHAR, 2, '0') || '_MTD.CSV' END AS name FROM orders) GROUP BY ALL""",
)
def _(spark, sf):
    d = F.col("o_orderdate")
    path = F.concat(
        F.lit(" Hanoi_PM2.5_"),
        F.year(d).cast("string"),
        F.when(F.col("o_orderkey") % 3 == 0, "_YTD.csv").otherwise(
            F.concat(F.lit("_"), F.lpad(F.month(d).cast("string"), 2, "0"), F.lit("_MTD.csv "))
        ),
    )
    p = fn.file_period(path)
    return (
        v.table(spark, sf, "orders")
        .select(p["period_type"].alias("period_type"), p["period_month"].cast("long").alias("period_month"))
        .groupBy("period_type", "period_month")
        .agg(F.count(F.lit(1)).alias("n"))
    )
