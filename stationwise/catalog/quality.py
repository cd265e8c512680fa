"""Audits, coverage tables, duplicates and contracts (inventory 2.5, first part)."""

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from ..operators import clean, grid, quality
from ..session import written
from . import query, views as v
from .joins import PERIODS_SQL
from .sequences import INTERP, _SPLIT, split_grid

MEASURES = ("pm25", "pm10", "relative_humidity")


def _profile_sql(c):
    return f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct, count(DISTINCT {c}) AS n_distinct,
    round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM obs_grid"""


@query(
    "column_profile",
    v.sql(
        "obs_grid",
        " UNION ALL ".join(_profile_sql(c) for c in MEASURES)
        + """ UNION ALL SELECT 'station_id', count(*), 0, 0.0, count(DISTINCT station_id), NULL, NULL, NULL, NULL, NULL FROM obs_grid""",
    ),
)
def _(spark, sf):
    return quality.column_profile(v.obs_grid(spark, sf), MEASURES, ("station_id",))


@query(
    "uniqueness_audit",
    """SELECT sum(c)::BIGINT AS n_rows, count(*) AS n_keys, sum(c - 1)::BIGINT AS n_duplicate_rows, round(100.0 * sum(c - 1) / sum(c), 6) AS duplicate_pct,
    sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT AS n_rows_in_repeated_keys, max(c) = 1 AS is_unique FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def _(spark, sf):
    return quality.uniqueness_audit(v.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_MARKERS = ", ".join("'" + m + "'" for m in S.DISGUISED_MARKERS)


@query(
    "missing_representation_audit",
    v.sql(
        "obs_fault",
        f"""SELECT c.col AS "column", m.marker, (SELECT count(*) FROM long l WHERE l.col = c.col AND (l.x = m.marker OR (m.marker = '<NULL>' AND l.x IS NULL))) AS n
        FROM (SELECT unnest(['raw_value', 'mixed']) AS col) c CROSS JOIN (SELECT unnest(['<NULL>', {_MARKERS}]) AS marker) m""",
        """long AS (SELECT 'raw_value' AS col, raw_value AS x FROM obs_fault UNION ALL
        SELECT 'mixed', CASE seq % 13 WHEN 0 THEN NULL WHEN 1 THEN 'null' WHEN 2 THEN ' ' WHEN 3 THEN '' WHEN 4 THEN ' NA' ELSE raw_value END FROM obs_fault)""",
    ),
)
def _(spark, sf):
    m = F.col("seq") % 13
    mixed = F.when(m == 0, None).when(m == 1, "null").when(m == 2, " ").when(m == 3, "").when(m == 4, " NA").otherwise(F.col("raw_value"))
    return quality.missing_representation(v.obs_fault(spark, sf).withColumn("mixed", mixed), ["raw_value", "mixed"])


_B = {c: S.AUDIT_BOUNDS[c] for c in MEASURES}


def six_dimension_sql(table: str) -> tuple[str, ...]:
    """Body over o and t, and these two, for the audit of a table."""
    return (
        "SELECT d AS dimension, m AS metric, round(x::DOUBLE, 6) AS value FROM ("
        + " UNION ALL ".join(
            f"SELECT '{d}' AS d, '{m}' AS m, ({e})::DOUBLE AS x FROM o, t"
            for d, m, e in [
                ("completeness", "cell_pct", "100.0 * (k_pm25 + k_pm10 + k_relative_humidity) / (3 * n)"),
                ("completeness", "expected_hours", "shared * st"),
                ("completeness", "recorded_hours", "hrs"),
                ("completeness", "unrecorded_pct", "100.0 * (shared * st - hrs) / (shared * st)"),
                ("accuracy", "pairs", "pairs"),
                ("accuracy", "strict_inversions", "strict"),
                ("accuracy", "inversions_beyond_epsilon", "beyond"),
                ("accuracy", "humid_hours", "humid"),
                ("validity", "nonnumeric_measures", "0"),
                ("uniqueness", "duplicate_rows", "n - hrs"),
                ("timeliness", "shared_window_hours", "shared"),
            ]
            + [("accuracy", f"below_{c}", f"lo_{c}") for c in MEASURES]
            + [("accuracy", f"above_{c}", f"hi_{c}") for c in MEASURES]
            + [("completeness", f"missing_{c}", f"n - k_{c}") for c in MEASURES]
        )
        + ")",
        "o AS (SELECT 1)",
        "t AS (SELECT count(*) AS n, count(DISTINCT (station_id, timestamp)) AS hrs, count(DISTINCT station_id) AS st, date_diff('hour', min(timestamp), max(timestamp)) + 1 AS shared, "
        + ", ".join(
            f"count({c}) AS k_{c}, count(*) FILTER ({c} < {lo}) AS lo_{c}, count(*) FILTER ({c} > {hi}) AS hi_{c}"
            for c, (lo, hi) in _B.items()
        )
        + f", count(pm25 - pm10) AS pairs, count(*) FILTER (pm25 > pm10) AS strict, count(*) FILTER (pm25 - pm10 > 2.0) AS beyond, count(*) FILTER (relative_humidity > 90) AS humid FROM {table})",
    )


@query("six_dimension_audit", v.sql("obs_hourly", *six_dimension_sql("obs_hourly")))
def _(spark, sf):
    return quality.six_dimension_audit(v.obs_hourly(spark, sf), MEASURES)


_TWISTED = """twisted AS (SELECT station_id, timestamp, CASE WHEN hour(timestamp) = 4 THEN 'Infinity'::DOUBLE WHEN hour(timestamp) = 5 THEN -3.0 WHEN hour(timestamp) = 6 THEN 2000.0 ELSE pm25 END AS pm25 FROM obs_hourly
  UNION ALL SELECT station_id, timestamp, pm25 FROM obs_hourly WHERE hour(timestamp) = 7)"""


def _twisted(spark, sf):
    h = F.hour("timestamp")
    base = v.obs_hourly(spark, sf).select("station_id", "timestamp", "pm25")
    bent = base.withColumn(
        "pm25",
        F.when(h == 4, float("inf")).when(h == 5, -3.0).when(h == 6, 2000.0).otherwise(F.col("pm25")),
    )
    return bent.unionByName(base.filter(h == 7))


@query(
    "group_quality_dimensions",
    v.sql(
        "obs_hourly",
        """SELECT station_id, period_type, period, period_start, period_end, expected_calendar_hours, active_grid_rows, active_grid_hours, observed_hours, valid_hours, nonfinite_values, out_of_bounds_values, negative_values, 0::BIGINT AS derived_hours,
        irregular_intervals, 0::BIGINT AS other_bound_violations, active_grid_rows - valid_hours AS missing_hours, expected_calendar_hours - active_grid_hours AS outside_active_hours, expected_calendar_hours > active_grid_hours AS partial_period,
        active_grid_rows - active_grid_hours AS duplicate_keys, CASE WHEN valid_hours = active_grid_rows THEN 'PASS' ELSE 'FAIL' END AS completeness_status, CASE WHEN active_grid_rows = active_grid_hours THEN 'PASS' ELSE 'FAIL' END AS uniqueness_status,
        CASE WHEN nonfinite_values = 0 AND out_of_bounds_values = 0 THEN 'PASS' ELSE 'FAIL' END AS validity_status, CASE WHEN irregular_intervals = 0 THEN 'PASS' ELSE 'FAIL' END AS timeliness_status, 'UNVERIFIABLE' AS accuracy_status
        FROM (SELECT station_id, q.t AS period_type, q.p AS period, coalesce(q.s, min(timestamp)) AS period_start, coalesce(q.e, (max(timestamp) + INTERVAL 1 HOUR)::TIMESTAMP) AS period_end,
          (epoch(coalesce(q.e, (max(timestamp) + INTERVAL 1 HOUR)::TIMESTAMP) - coalesce(q.s, min(timestamp))) / 3600)::BIGINT AS expected_calendar_hours, sum(n)::BIGINT AS active_grid_rows, count(*) AS active_grid_hours, sum(obs)::BIGINT AS observed_hours, sum(ok)::BIGINT AS valid_hours,
          sum(inf)::BIGINT AS nonfinite_values, sum(outb)::BIGINT AS out_of_bounds_values, sum(neg)::BIGINT AS negative_values, count(*) FILTER (timestamp - prev <> INTERVAL 1 HOUR AND (q.s IS NULL OR prev >= q.s)) AS irregular_intervals
          FROM periods GROUP BY station_id, q.t, q.p, q.s, q.e)""",
        _TWISTED,
        """base AS (SELECT *, lag(timestamp) OVER (PARTITION BY station_id ORDER BY timestamp) AS prev FROM (SELECT station_id, timestamp, count(*) AS n, count(pm25) AS obs, count(*) FILTER (pm25 BETWEEN 0 AND 1000) AS ok, count(*) FILTER (isinf(pm25)) AS inf,
          count(*) FILTER (NOT isinf(pm25) AND pm25 NOT BETWEEN 0 AND 1000) AS outb, count(*) FILTER (pm25 < 0) AS neg FROM twisted GROUP BY ALL))""",
        PERIODS_SQL,
    ),
)
def _(spark, sf):
    return quality.group_quality(_twisted(spark, sf))


PERIOD_QUALITY_SQL = """pq AS (
  SELECT *, 100.0 * missing_hours / active_grid_hours AS missing_pct_active, 100.0 * valid_hours / expected_calendar_hours AS coverage_pct_calendar, 100.0 * valid_hours / active_grid_hours AS coverage_pct_active FROM (
    SELECT p.*, expected_calendar_hours - active_grid_hours AS outside_active_hours, active_grid_hours - valid_hours AS missing_hours, coalesce(g.gap_count, 0) AS gap_count, coalesce(g.longest_gap_hours, 0) AS longest_gap_hours, coalesce(g.median_gap_hours, 0.0) AS median_gap_hours FROM (
      SELECT station_id, q.t AS period_type, q.p AS period, (epoch(coalesce(q.e, (max(timestamp) + INTERVAL 1 HOUR)::TIMESTAMP) - coalesce(q.s, min(timestamp))) / 3600)::BIGINT AS expected_calendar_hours, count(*) AS active_grid_hours, count(pm25) AS valid_hours
      FROM periods GROUP BY station_id, q.t, q.p, q.s, q.e) p
    LEFT JOIN (SELECT station_id, period_type, period, count(*) AS gap_count, max(len) AS longest_gap_hours, quantile_cont(len::DOUBLE, 0.5) AS median_gap_hours FROM (
      SELECT station_id, period_type, period, run, count(*) AS len, any_value(state) AS state FROM (
        SELECT *, sum(brk) OVER (PARTITION BY station_id, period_type, period ORDER BY timestamp) AS run FROM (
          SELECT station_id, q.t AS period_type, q.p AS period, timestamp, pm25 IS NULL AS state, CASE WHEN lag(pm25 IS NULL) OVER (PARTITION BY station_id, q.t, q.p ORDER BY timestamp) IS NOT DISTINCT FROM (pm25 IS NULL) THEN 0 ELSE 1 END AS brk FROM periods)) GROUP BY ALL)
      WHERE state GROUP BY ALL) g USING (station_id, period_type, period)))"""
_GRID_BASE = "base AS (SELECT * FROM obs_grid)"


@query(
    "period_quality_table",
    v.sql(
        "obs_grid",
        """SELECT station_id, period_type, period, expected_calendar_hours, active_grid_hours, valid_hours, missing_hours, outside_active_hours, gap_count, longest_gap_hours, round(median_gap_hours, 6) AS median_gap_hours,
        round(missing_pct_active, 6) AS missing_pct_active, round(coverage_pct_calendar, 6) AS coverage_pct_calendar, round(coverage_pct_active, 6) AS coverage_pct_active, r.n AS raw_observations, r.bad AS invalid_source_rows, r.hrs AS raw_source_hours, active_grid_hours - r.hrs AS missing_source_hours
        FROM pq JOIN rawp r USING (station_id, period_type, period)""",
        _GRID_BASE,
        PERIODS_SQL,
        PERIOD_QUALITY_SQL,
        """rawp AS (SELECT c.station_id, q.t AS period_type, q.p AS period, sum(c.n)::BIGINT AS n, sum(c.bad)::BIGINT AS bad, count(*) AS hrs FROM (SELECT station_id, timestamp, count(*) AS n, count(*) FILTER (pm25 IS NULL OR pm25 NOT BETWEEN 0 AND 1000) AS bad FROM obs_clean GROUP BY ALL) c JOIN periods p USING (station_id, timestamp) GROUP BY c.station_id, q.t, q.p)""",
    ),
)
def _(spark, sf):
    raw = v.obs_clean(spark, sf).select("station_id", "timestamp", F.col("pm25").alias("value"))
    # the grid feeds a dozen sub-plans, so it is written once
    return quality.period_quality_table(written(v.obs_grid(spark, sf), "grid"), raw).select(
        "station_id",
        "period_type",
        "period",
        "expected_calendar_hours",
        "active_grid_hours",
        "valid_hours",
        "missing_hours",
        "outside_active_hours",
        "gap_count",
        "longest_gap_hours",
        "median_gap_hours",
        "missing_pct_active",
        "coverage_pct_calendar",
        "coverage_pct_active",
        "raw_observations",
        "invalid_source_rows",
        "raw_source_hours",
        "missing_source_hours",
    )


@query(
    "missing_by_key",
    v.sql(
        "obs_grid",
        """SELECT CASE WHEN grouping(h) = 0 THEN 'hour' WHEN grouping(station_id) = 0 THEN 'station' ELSE 'split' END AS key, coalesce(CASE WHEN grouping(h) = 0 THEN h END, CASE WHEN grouping(station_id) = 0 THEN station_id END, split) AS level,
        count(*) AS n_rows, count(*) FILTER (pm25 IS NULL) AS n_missing, round(100.0 * count(*) FILTER (pm25 IS NULL) / count(*), 6) AS missing_pct FROM (SELECT *, hour(timestamp)::VARCHAR AS h, """
        + _SPLIT
        + """ FROM obs_grid) GROUP BY GROUPING SETS ((h), (station_id), (split))""",
    ),
)
def _(spark, sf):
    return quality.missing_by_key(
        split_grid(spark, sf),
        {"hour": F.hour("timestamp"), "station": F.col("station_id"), "split": F.col("split")},
    )


@query(
    "co_missing",
    v.sql(
        "obs_clean",
        """SELECT station_id, count(*) FILTER (t IS NULL AND o IS NULL) AS both_missing, count(*) FILTER (t IS NULL AND o IS NOT NULL) AS only_target_missing, count(*) FILTER (t IS NOT NULL AND o IS NULL) AS only_other_missing,
        round(avg(o) FILTER (t IS NULL), 6) AS other_mean_while_missing, round(avg(o), 6) AS other_mean, round(quantile_cont(o, 0.5), 6) AS other_median, round(quantile_cont(o, 0.5) FILTER (t IS NULL), 6) AS other_median_while_missing
        FROM (SELECT station_id, pm25 AS t, CASE WHEN seq % 11 <> 0 THEN pm10 END AS o FROM obs_clean) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    df = v.obs_clean(spark, sf).withColumn("pm10", F.when(F.col("seq") % 11 != 0, F.col("pm10")))
    return quality.co_missing(df, "pm25", "pm10")


_DUP = """dup AS (SELECT l_orderkey % 500 AS k, l_linenumber AS ln, CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_returnflag = 'N' THEN 5.0 ELSE l_quantity END AS value,
  CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber = 1 THEN 'qc_invalid' ELSE 'qc_missing' END ELSE 'valid' END AS status, l_linestatus AS source FROM lineitem)"""


def _dup(spark, sf):
    li = v.table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    return li.select(
        (F.col("l_orderkey") % 4999).alias("k"),
        F.col("l_linenumber").alias("ln"),
        F.when(flag == "A", None).when(flag == "N", 5.0).otherwise(F.col("l_quantity")).alias("value"),
        F.when(flag == "A", F.when(F.col("l_linenumber") == 1, "qc_invalid").otherwise("qc_missing")).otherwise("valid").alias("status"),
        F.col("l_linestatus").alias("source"),
    )


_DUP = _DUP.replace("% 500 AS", "% 4999 AS")


def _dup_stations(spark, sf):
    return _dup(spark, sf).select(
        F.col("ln").cast("string").alias("station_id"),
        F.timestamp_seconds(F.col("k") * 3600 + v.HOUR0).alias("timestamp"),
        "value",
        "status",
        "source",
    )


@query(
    "resolve_duplicates",
    v.sql(
        "obs_raw",
        """SELECT kind, status, count(*) AS n_hours, sum(n)::BIGINT AS n_records, count(value) AS n_kept, round(sum(value), 6) AS value_sum FROM (
          SELECT k, ln, n, kind, CASE WHEN kind <> 'conflict' THEN val END AS value, CASE WHEN kind = 'conflict' THEN 'conflicting_duplicate' ELSE s0 END AS status FROM (
            SELECT k, ln, count(*) AS n, min(value) FILTER (status = 'valid') AS val, min(status) AS s0, CASE WHEN count(*) = 1 THEN 'single'
              WHEN count(*) FILTER (status = 'valid') = count(*) AND count(DISTINCT value) = 1 THEN 'identical' WHEN count(*) FILTER (status = 'valid') = 0 AND count(DISTINCT status) = 1 THEN 'identical' ELSE 'conflict' END AS kind
            FROM dup GROUP BY ALL)) GROUP BY ALL""",
        _DUP,
    ),
)
def _(spark, sf):
    return (
        quality.resolve_duplicates(_dup_stations(spark, sf))
        .groupBy("kind", "status")
        .agg(
            F.count(F.lit(1)).alias("n_hours"),
            F.sum("n").alias("n_records"),
            F.count("value").alias("n_kept"),
            F.sum("value").alias("value_sum"),
        )
    )


@query(
    "conflict_ledger",
    v.sql(
        "obs_raw",
        """SELECT ln::VARCHAR AS station_id, TIMESTAMP '2024-01-01' + to_hours(k) AS timestamp, source, value, status FROM dup d
        WHERE (k, ln) IN (SELECT (k, ln) FROM dup GROUP BY k, ln HAVING NOT (count(*) = 1 OR (count(*) FILTER (status = 'valid') = count(*) AND count(DISTINCT value) = 1) OR (count(*) FILTER (status = 'valid') = 0 AND count(DISTINCT status) = 1)))""",
        _DUP,
    ),
)
def _(spark, sf):
    return quality.conflict_ledger(_dup_stations(spark, sf))


@query(
    "duplicate_classes",
    v.sql(
        "obs_raw",
        """SELECT count(*) AS n_hours, sum(n - 1)::BIGINT AS duplicate_rows, count(*) FILTER (ov) AS overlap_hours, count(*) FILTER (n > 1 AND NOT conf AND ov) AS identical_overlap_hours, count(*) FILTER (n > 1 AND NOT conf AND NOT ov) AS identical_same_kind_hours,
        count(*) FILTER (conf) AS conflicting_hours, count(*) FILTER (conf AND nv > 1) AS conflicting_numeric_hours, count(*) FILTER (conf AND hasv AND hasn) AS missing_vs_valid_hours, count(*) FILTER (conf AND hasv AND hasi) AS invalid_vs_valid_hours FROM (
          SELECT k, ln, count(*) AS n, count(DISTINCT (coalesce(value, -1), status)) > 1 AS conf, bool_or(kind = 'YTD') AND bool_or(kind = 'MTD') AS ov, count(DISTINCT value) AS nv, bool_or(status = 'valid') AS hasv, bool_or(value IS NULL) AS hasn, bool_or(status = 'invalid') AS hasi
          FROM (SELECT k, ln, value, CASE WHEN status = 'valid' THEN 'valid' ELSE 'invalid' END AS status, CASE WHEN source = 'O' THEN 'YTD' ELSE 'MTD' END AS kind FROM dup) GROUP BY ALL)""",
        _DUP,
    ),
)
def _(spark, sf):
    df = _dup(spark, sf).select(
        "k",
        "ln",
        "value",
        F.when(F.col("status") == "valid", "valid").otherwise("invalid").alias("status"),
        F.when(F.col("source") == "O", "YTD").otherwise("MTD").alias("kind"),
    )
    return quality.duplicate_classes(df, ["k", "ln"], ["value"], "kind", "status", "value")


@query(
    "first_wins_dedup",
    v.sql(
        "obs_raw",
        """SELECT k, ln, value, status, source FROM (SELECT *, row_number() OVER (PARTITION BY k, ln ORDER BY source, status, value NULLS FIRST) AS rn FROM dup) WHERE rn = 1""",
        _DUP,
    ),
)
def _(spark, sf):
    return clean.first_wins(_dup(spark, sf), ["k", "ln"], ["source", "status", "value"])


_STATUS = """hs AS (SELECT station_id, timestamp, CASE WHEN count(*) FILTER (pm25 IS NOT NULL) = 0 THEN 'invalid' WHEN count(*) FILTER (pm25 IS NULL) > 0 THEN 'conflicting' ELSE 'valid' END AS status FROM obs_clean GROUP BY ALL)"""


def _hour_status(spark, sf):
    return (
        v.obs_clean(spark, sf)
        .groupBy("station_id", "timestamp")
        .agg(
            F.when(F.count("pm25") == 0, "invalid")
            .when(F.count_if(F.col("pm25").isNull()) > 0, "conflicting")
            .otherwise("valid")
            .alias("status")
        )
    )


@query(
    "source_coverage",
    v.sql(
        "obs_clean",
        """SELECT station_id, period_type, period, sum(n)::BIGINT AS expected_hours, sum(rep)::BIGINT AS reported_hours, sum(val)::BIGINT AS valid_hours, sum(inv)::BIGINT AS invalid_or_conflict_hours, sum(mis)::BIGINT AS missing_while_available_hours, sum(una)::BIGINT AS unavailable_hours, sum(con)::BIGINT AS conflicting_hours,
        coalesce(max(n) FILTER (gap), 0) AS longest_gap_hours FROM (
          SELECT station_id, period_type, period, run, any_value(gap) AS gap, count(*) AS n, count(*) FILTER (status <> 'missing') AS rep, count(*) FILTER (status = 'valid') AS val, count(*) FILTER (avail AND status IN ('invalid', 'conflicting')) AS inv, count(*) FILTER (avail AND status = 'missing') AS mis, count(*) FILTER (NOT avail) AS una, count(*) FILTER (status = 'conflicting') AS con FROM (
            SELECT *, sum(brk) OVER (PARTITION BY station_id, period_type, period ORDER BY timestamp) AS run FROM (
              SELECT *, CASE WHEN lag(gap) OVER (PARTITION BY station_id, period_type, period ORDER BY timestamp) IS NOT DISTINCT FROM gap THEN 0 ELSE 1 END AS brk FROM (
                SELECT *, avail AND status <> 'valid' AS gap, unnest(['month', 'year']) AS period_type, unnest([strftime(timestamp, '%Y-%m'), year(timestamp)::VARCHAR]) AS period FROM (
                  SELECT s.station_id, c.timestamp, coalesce(h.status, 'missing') AS status, c.timestamp BETWEEN s.lo AND s.hi AS avail FROM (SELECT station_id, min(timestamp) AS lo, max(timestamp) AS hi FROM hs GROUP BY ALL) s
                  CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '2024-02-29 23:00:00', INTERVAL 1 HOUR)) AS timestamp) c LEFT JOIN hs h ON h.station_id = s.station_id AND h.timestamp = c.timestamp)))) GROUP BY ALL) GROUP BY ALL""",
        _STATUS,
    ),
)
def _(spark, sf):
    return quality.source_coverage(_hour_status(spark, sf), "2023-12-01", "2024-02-29")


@query(
    "snapshot_and_peak",
    v.sql(
        "obs_clean",
        """SELECT s.station_id, s.peak, s.peak_hour AS timestamp, CASE WHEN h.station_id IS NULL THEN 'row_removed' WHEN h.pm25 IS NULL THEN 'nulled' WHEN h.pm25 = s.peak THEN 'survived' ELSE 'changed' END AS fate
        FROM (SELECT station_id, max(pm25) AS peak, arg_max(timestamp, (pm25, -epoch(timestamp))) FILTER (pm25 IS NOT NULL) AS peak_hour FROM obs_clean GROUP BY ALL) s LEFT JOIN obs_hourly h ON h.station_id = s.station_id AND h.timestamp = s.peak_hour""".replace("obs_hourly", "hourly"),
        "hourly AS (SELECT station_id, timestamp, round(avg(pm25), 9) AS pm25 FROM obs_clean GROUP BY ALL)",
    ),
)
def _(spark, sf):
    return clean.peak_trace(
        v.obs_clean(spark, sf),
        clean.hourly_means(v.obs_clean(spark, sf), {"pm25": "pm25"}),
        ["station_id", "timestamp"],
        "pm25",
    )


@query(
    "snapshot",
    v.sql(
        "obs_clean",
        """SELECT count(*) AS n_rows, count(*) - count(DISTINCT (station_id, timestamp)) AS n_duplicate_rows, count(*) FILTER (pm25 IS NULL) AS missing_pm25, count(*) FILTER (pm10 IS NULL) AS missing_pm10, max(pm25) AS peak, min(pm25) AS trough FROM obs_clean""",
    ),
)
def _(spark, sf):
    return clean.snapshot(v.obs_clean(spark, sf), ["station_id", "timestamp"], ["pm25", "pm10"], "pm25")


@query(
    "clean_validation",
    v.sql(
        "obs_hourly",
        """SELECT station_id, "check", violations, violations = 0 AS passed FROM (SELECT station_id, unnest(['no_duplicate_keys', 'hourly_step', 'pm25_nonnegative', 'pm10_nonnegative', 'fine_not_above_coarse', 'timestamp_present']) AS "check",
        unnest([0, count(*) FILTER (step <> INTERVAL 1 HOUR), count(*) FILTER (pm25 < 0), count(*) FILTER (pm10 < 0), count(*) FILTER (pm25 - pm10 > 1e-3), 0]) AS violations FROM (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY station_id ORDER BY timestamp) AS step FROM obs_hourly) GROUP BY station_id)""",
    ),
)
def _(spark, sf):
    return quality.clean_validation(v.obs_hourly(spark, sf))


_DRAWS = "('0x' || substr(md5(station_id || ':' || epoch(timestamp)::BIGINT || ':' || coalesce(CAST(round(pm25 * 1000000) AS BIGINT)::VARCHAR, 'NULL')), 1, 8))::BIGINT"
_SUMMARY = f"""summary AS (SELECT station_id, count(*) AS n_rows, count(pm25) AS n_observed, min(timestamp) AS first_hour, max(timestamp) AS last_hour, sum({_DRAWS})::BIGINT AS fingerprint FROM obs_grid GROUP BY ALL)"""


@query("content_fingerprint", v.sql("obs_grid", "SELECT * FROM summary", _SUMMARY))
def _(spark, sf):
    return quality.content_summary(v.obs_grid(spark, sf))


@query(
    "contract_check",
    v.sql(
        "obs_grid",
        """SELECT station_id, field, recorded, actual, recorded IS NOT DISTINCT FROM actual AS passed FROM (SELECT station_id, unnest(['n_rows', 'n_observed', 'fingerprint']) AS field,
        unnest([n_rows::VARCHAR, (n_observed + CASE WHEN station_id = 'view' THEN 1 ELSE 0 END)::VARCHAR, fingerprint::VARCHAR]) AS recorded, unnest([n_rows::VARCHAR, n_observed::VARCHAR, fingerprint::VARCHAR]) AS actual FROM summary)""",
        _SUMMARY,
    ),
)
def _(spark, sf):
    actual = quality.content_summary(v.obs_grid(spark, sf))
    off = F.when(F.col("station_id") == "view", 1).otherwise(0)
    recorded = actual.withColumn("n_observed", F.col("n_observed") + off)
    return quality.contract_check(actual, recorded, ["n_rows", "n_observed", "fingerprint"])


@query(
    "flag_audit",
    v.sql(
        "obs_hourly",
        """SELECT station_id, season, count(*) FILTER (f = 1) AS n_on, count(*) FILTER (f = 0) AS n_off, min(f) = max(f) AS is_constant, round(avg(pm25) FILTER (f = 1) - avg(pm25) FILTER (f = 0), 6) AS mean_difference,
        round(quantile_cont(pm25, 0.5) FILTER (f = 1) - quantile_cont(pm25, 0.5) FILTER (f = 0), 6) AS median_difference FROM (SELECT station_id, pm25, CASE WHEN relative_humidity > 50 THEN 1 ELSE 0 END AS f, unnest(['ALL', 'Winter']) AS season FROM obs_hourly) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    df = v.obs_hourly(spark, sf).withColumn("flag", fn.humidity_flag("relative_humidity", 50.0))
    return quality.flag_audit(df, "flag")


def extended(spark, sf):
    """Extended table: split, derived short-gap values and season columns."""
    df = grid.interpolate_short_gaps(split_grid(spark, sf), max_gap=2)
    return df.withColumns({"season": fn.season("timestamp"), "winter_year": fn.winter_year("timestamp")})


@query(
    "input_contract",
    v.sql(
        "obs_grid",
        """SELECT unnest(['known_station', 'value_in_range', 'derived_in_range', 'observed_unchanged', 'derived_flag', 'season', 'winter_year', 'hourly_step']) AS "check",
        unnest([count(*) FILTER (station_id = 'view'), count(*) FILTER (pm25 NOT BETWEEN 0 AND 1000), count(*) FILTER (pm25_derived NOT BETWEEN 0 AND 1000), count(*) FILTER (pm25 <> pm25_derived), count(*) FILTER (hour(timestamp) = 9 AND pm25 IS NULL AND pm25_derived IS NOT NULL), count(*) FILTER (day(timestamp) = 3), 0, 0]) AS violations,
        unnest([count(*) FILTER (station_id = 'view'), count(*) FILTER (pm25 NOT BETWEEN 0 AND 1000), count(*) FILTER (pm25_derived NOT BETWEEN 0 AND 1000), count(*) FILTER (pm25 <> pm25_derived), count(*) FILTER (hour(timestamp) = 9 AND pm25 IS NULL AND pm25_derived IS NOT NULL), count(*) FILTER (day(timestamp) = 3), 0, 0]) = 0 AS passed FROM interp""",
        INTERP.format(2, _SPLIT),
    ),
)
def _(spark, sf):
    """The table carries planted errors: an unknown station, wrong flags at 9 h, wrong seasons on day 3."""
    df = extended(spark, sf).withColumns(
        {
            "is_derived": F.when(F.hour("timestamp") == 9, F.lit(False)).otherwise(F.col("is_derived")),
            "season": F.when(F.dayofmonth("timestamp") == 3, "Summer").otherwise(F.col("season")),
        }
    )
    return quality.input_contract(df, ["click", "error", "purchase", "signup"])


@query(
    "table_identities",
    v.sql(
        "obs_grid",
        """SELECT unnest(['valid_plus_missing_is_active', 'active_plus_outside_is_calendar', 'coverage_calendar', 'coverage_active', 'completeness_status', 'partial_flag', 'longest_gap_bounded']) AS "check",
        unnest([count(*) FILTER (period_type = 'year'), 0, count(*) FILTER (period_type = 'station'), 0, 0, 0, 0]) AS violations, unnest([count(*) FILTER (period_type = 'year') = 0, true, count(*) FILTER (period_type = 'station') = 0, true, true, true, true]) AS passed FROM pq""",
        _GRID_BASE,
        PERIODS_SQL,
        PERIOD_QUALITY_SQL,
    ),
)
def _(spark, sf):
    """Published rows with two planted errors, one per period type."""
    q = quality.period_quality_table(written(v.obs_grid(spark, sf), "grid"))
    broken = q.withColumns(
        {
            "missing_hours": F.col("missing_hours") + F.when(F.col("period_type") == "year", 1).otherwise(0),
            "coverage_pct_calendar": F.col("coverage_pct_calendar") + F.when(F.col("period_type") == "station", 0.5).otherwise(0.0),
        }
    )
    return quality.table_identities(broken)


@query(
    "monthly_coverage",
    v.sql(
        "obs_grid",
        """SELECT station_id, strftime(timestamp, '%Y-%m') AS period, count(pm25) AS n, (epoch(date_trunc('month', min(timestamp)) + INTERVAL 1 MONTH - date_trunc('month', min(timestamp))) / 3600)::BIGINT AS expected_hours,
        round(100.0 * count(pm25) / (epoch(date_trunc('month', min(timestamp)) + INTERVAL 1 MONTH - date_trunc('month', min(timestamp))) / 3600), 6) AS coverage_pct_calendar FROM obs_grid GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    return quality.monthly_coverage(v.obs_grid(spark, sf))


@query(
    "dataset_summary",
    v.sql(
        "obs_grid",
        """SELECT station_id, min(timestamp) AS first_hour, max(timestamp) AS last_hour, count(*) AS grid_rows, count(pm25) AS valid_rows, round(100.0 * count(*) FILTER (pm25 IS NULL) / count(*), 6) AS missing_pct, sum(count(*)) OVER ()::BIGINT AS total_rows FROM obs_grid GROUP BY ALL""",
    ),
)
def _(spark, sf):
    return quality.dataset_summary(v.obs_grid(spark, sf))
