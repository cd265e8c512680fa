"""Statistics over daily calendars (inventory 2.8, first part)."""

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import linear_core, stats
from ..plans import inference as plan
from . import query, views as v
from .panels import SEASON
from .profiles import bin_sql

MU = 255.0


def days(spark, sf):
    """Daily calendar with season, weekend and a calendar flag."""
    return v.daily_calendar(spark, sf).withColumns(
        {
            "season": fn.season("date"),
            "weekend": (F.weekday("date") >= 5).cast("int"),
            "flag": (F.dayofmonth("date") % 3 == 0).cast("int"),
        }
    )


DAYS = f"days AS (SELECT *, {SEASON.format('date')} AS season, (isodow(date) >= 6)::INT AS weekend, (day(date) % 3 = 0)::INT AS flag FROM daily_calendar)"
SEEN = "seen AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY pos) AS rn FROM days WHERE value IS NOT NULL)"


def rank_sql(value, part):
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0)"


@query(
    "distribution_diagnostics",
    v.sql(
        "daily_calendar",
        """SELECT station_id, n::BIGINT AS n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mn, 6) AS min, round(mx, 6) AS max, round(sk, 6) AS skewness, round(ku, 6) AS kurtosis, round(q25, 6) AS q25, round(med, 6) AS median, round(q75, 6) AS q75, round(q75 - q25, 6) AS iqr,
        CASE WHEN abs(sk) < 0.5 THEN 'symmetric' WHEN sk > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS shape, o AS n_outliers_3sd, round(n / 6 * (g1 * g1 + g2 * g2 / 4), 6) AS jarque_bera, round(z1 * z1 + z2 * z2, 6) AS dagostino_k2 FROM (
          SELECT *, ln(ya + sqrt(ya * ya + 1)) / sqrt(0.5 * ln(w2)) AS z1, ((1 - 2 / (9 * a)) - sign(core) * power(abs(core), 1.0::DOUBLE / 3)) / sqrt(2 / (9 * a)) AS z2 FROM (
          SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / sqrt(2 / (w2 - 1)) AS ya, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS core FROM (
          SELECT *, -1 + sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) AS w2, (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 + 8 / rt * (2 / rt + sqrt(1 + 4 / (rt * rt))) AS a FROM (
          SELECT *, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rt, sk * (n - 2) / sqrt(n * (n - 1)) AS g1, (ku * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1) AS g2 FROM (
          SELECT station_id, count(value)::DOUBLE AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx, skewness(value) AS sk, kurtosis(value) AS ku, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q75 FROM days GROUP BY ALL)))))
        JOIN (SELECT d.station_id, count(*) FILTER (abs(value - m) > 3 * s) AS o FROM days d JOIN (SELECT station_id, avg(value) AS m, stddev_samp(value) AS s FROM days GROUP BY ALL) USING (station_id) GROUP BY ALL) USING (station_id)""",
        DAYS,
    ),
)
def _(spark, sf):
    return stats.distribution_diagnostics(v.daily_calendar(spark, sf))


_LAGS = [1, 2, 3, 7, 14, 28]


@query(
    "autocorrelation",
    v.sql(
        "daily_calendar",
        "SELECT a.station_id, l.lag::BIGINT AS lag, count(*) AS n_pairs, round(corr(a.value, b.value), 6) AS rho FROM days a CROSS JOIN (SELECT unnest([1, 2, 3, 7, 14, 28]) AS lag) l JOIN days b ON a.station_id = b.station_id AND b.pos = a.pos - l.lag WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2",
        DAYS,
    ),
)
def _(spark, sf):
    return stats.autocorrelation(v.daily_calendar(spark, sf), _LAGS)


@query(
    "effective_n",
    v.sql(
        "daily_calendar",
        "SELECT station_id, n, round(r, 6) AS rho_lag1, round(n * (1 - r) / (1 + r), 6) AS n_effective, round((1 + r) / (1 - r), 6) AS inflation_factor FROM (SELECT station_id, count(value) AS n FROM days GROUP BY ALL) JOIN (SELECT a.station_id, corr(a.value, b.value) AS r FROM days a JOIN days b ON a.station_id = b.station_id AND b.pos = a.pos - 1 GROUP BY ALL) USING (station_id)",
        DAYS,
    ),
)
def _(spark, sf):
    return stats.effective_n(v.daily_calendar(spark, sf))


@query(
    "min_detectable_difference",
    v.sql(
        "daily_calendar",
        """SELECT station_id, n_a, n_b, round(p, 6) AS pooled_sd, round((1.959963984540054 + 0.8416212335729143) * p * sqrt(1 / n_a + 1 / n_b), 6) AS mde FROM (SELECT *, sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) AS p FROM (
        SELECT station_id, count(value) FILTER (weekend = 0) AS n_a, count(value) FILTER (weekend = 1) AS n_b, var_samp(value) FILTER (weekend = 0) AS va, var_samp(value) FILTER (weekend = 1) AS vb FROM days GROUP BY ALL))""",
        DAYS,
    ),
)
def _(spark, sf):
    return stats.min_detectable_difference(days(spark, sf), "weekend", 0, 1)


@query(
    "holm_adjust",
    v.sql(
        "daily_calendar",
        """SELECT station_id, test, round(p, 6) AS p, round(least(1, max(s) OVER (PARTITION BY station_id ORDER BY p, test ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS holm_p FROM (SELECT *, (count(*) OVER (PARTITION BY station_id) - row_number() OVER (PARTITION BY station_id ORDER BY p, test) + 1) * p AS s FROM (
        SELECT station_id, month(date)::VARCHAR AS test, least(1, exp(-abs(avg(value) - 255) / 4)) AS p FROM days GROUP BY ALL))""",
        DAYS,
    ),
)
def _(spark, sf):
    p = F.least(F.lit(1.0), F.exp(-F.abs(F.avg("value") - MU) / 4))
    tests = days(spark, sf).groupBy("station_id", F.month("date").cast("string").alias("test")).agg(p.alias("p"))
    return stats.holm(tests, ["station_id"], "p", "test")


@query(
    "mann_whitney",
    v.sql(
        "daily_calendar",
        f"""SELECT station_id, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(ma, 6) AS median_a, round(mb, 6) AS median_b, round(u, 6) AS u, round(2 * u / (n_a * n_b) - 1, 6) AS rank_biserial, round(ma - mb, 6) AS median_difference, round(mean_a - mean_b, 6) AS mean_difference,
        round((greatest(u, n_a * n_b - u) - n_a * n_b / 2 - 0.5) / sqrt(n_a * n_b / 12 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1)))), 6) AS z FROM (
          SELECT station_id, count(*) FILTER (weekend = 0) AS n_a, count(*) FILTER (weekend = 1) AS n_b, avg(value) FILTER (weekend = 0) AS mean_a, avg(value) FILTER (weekend = 1) AS mean_b, quantile_cont(value, 0.5) FILTER (weekend = 0) AS ma, quantile_cont(value, 0.5) FILTER (weekend = 1) AS mb,
            sum(r) FILTER (weekend = 0) - count(*) FILTER (weekend = 0) * (count(*) FILTER (weekend = 0) + 1) / 2 AS u, sum((c * c * c - c) / c::DOUBLE) AS ties FROM (SELECT *, {rank_sql('value', 'station_id')} AS r, count(*) OVER (PARTITION BY station_id, value) AS c FROM seen) GROUP BY ALL)""",
        DAYS,
        SEEN,
    ),
)
def _(spark, sf):
    return stats.mann_whitney(days(spark, sf), "weekend", 0, 1)


@query(
    "kruskal_wallis",
    v.sql(
        "daily_calendar",
        f"""SELECT station_id, n_groups, smallest_group::BIGINT AS smallest_group, n::BIGINT AS n, round(h, 6) AS h, n_groups - 1 AS df, round(least(greatest(h / (n - 1), 0), 1), 6) AS epsilon_squared FROM (
          SELECT station_id, count(*) AS n_groups, min(k) AS smallest_group, sum(k) AS n, (12 / (sum(k) * (sum(k) + 1)) * sum(rs * rs / k) - 3 * (sum(k) + 1)) / (1 - sum(ties) / (sum(k) * sum(k) * sum(k) - sum(k))) AS h FROM (
            SELECT station_id, season, count(*)::DOUBLE AS k, sum(r) AS rs, sum((c * c * c - c) / c::DOUBLE) AS ties FROM (SELECT *, {rank_sql('value', 'station_id')} AS r, count(*) OVER (PARTITION BY station_id, value) AS c FROM seen) GROUP BY ALL) GROUP BY ALL)""",
        DAYS,
        SEEN,
    ),
)
def _(spark, sf):
    return stats.kruskal_wallis(days(spark, sf), "season")


@query(
    "wilcoxon_signed_rank",
    v.sql(
        "daily_calendar",
        f"""SELECT station_id, n, n AS n_nonzero, round(wp, 6) AS w_plus, round(wm, 6) AS w_minus, round(median, 6) AS median, round(least(wp, wm), 6) AS w, round((wp - wm) / (wp + wm), 6) AS rank_biserial, round((least(wp, wm) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24), 6) AS z FROM (
          SELECT station_id, count(*) AS n, sum(r) FILTER (value > {MU}) AS wp, sum(r) FILTER (value < {MU}) AS wm, quantile_cont(value, 0.5) AS median, sum((c * c * c - c) / c::DOUBLE) AS ties FROM (SELECT *, {rank_sql('a', 'station_id')} AS r, count(*) OVER (PARTITION BY station_id, a) AS c FROM (SELECT *, abs(value - {MU}) AS a FROM seen)) GROUP BY ALL)""",
        DAYS,
        SEEN,
    ),
)
def _(spark, sf):
    return stats.signed_rank(days(spark, sf), MU)


@query(
    "one_sample_t",
    v.sql(
        "daily_calendar",
        f"SELECT station_id, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round((avg(value) - {MU}) / (stddev_samp(value) / sqrt(count(value))), 6) AS t, round((avg(value) - {MU}) / stddev_samp(value), 6) AS cohen_d, round(avg(value) - {MU}, 6) AS mean_difference FROM days GROUP BY ALL",
        DAYS,
    ),
)
def _(spark, sf):
    return stats.one_sample_t(days(spark, sf), MU)


@query(
    "welch_by_stratum",
    v.sql(
        "daily_calendar",
        """SELECT station_id, season, na AS n_flagged, nb AS n_unflagged, round(ma - mb, 6) AS difference, round(sqrt(va + vb), 6) AS se, round((va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)), 6) AS dof, round((ma - mb) / sqrt(va + vb), 6) AS t FROM (
        SELECT station_id, season, count(value) FILTER (flag = 1) AS na, count(value) FILTER (flag = 0) AS nb, avg(value) FILTER (flag = 1) AS ma, avg(value) FILTER (flag = 0) AS mb, var_samp(value) FILTER (flag = 1) / count(value) FILTER (flag = 1) AS va, var_samp(value) FILTER (flag = 0) / count(value) FILTER (flag = 0) AS vb FROM days GROUP BY ALL)""",
        DAYS,
    ),
)
def _(spark, sf):
    return stats.welch(days(spark, sf), "flag", ["station_id", "season"], "value")


@query(
    "ols_fit",
    v.sql(
        "daily_calendar",
        """SELECT station_id, n, round(r2, 6) AS r2, term, round(coef, 6) AS coef, round(se, 6) AS se FROM (SELECT station_id, n, r2, unnest(['intercept', 'trend']) AS term, unnest([b0, b1]) AS coef, unnest([sqrt(s2 * (1 / n + mx * mx / sxx)), sqrt(s2 / sxx)]) AS se FROM (
        SELECT station_id, count(*) AS n, regr_r2(value, x) AS r2, regr_intercept(value, x) AS b0, regr_slope(value, x) AS b1, regr_avgx(value, x) AS mx, regr_sxx(value, x) AS sxx, (regr_syy(value, x) - regr_slope(value, x) * regr_sxy(value, x)) / (count(*) - 2) AS s2 FROM (SELECT *, date_diff('day', min(date) OVER (PARTITION BY station_id), date) / 30.0::DOUBLE AS x FROM seen) GROUP BY ALL))""",
        DAYS,
        SEEN,
    ),
)
def _(spark, sf):
    design = stats.trend_design(days(spark, sf))
    xs = ["intercept", "trend"]
    return linear_core.coefficient_rows(linear_core.ols(design, ["station_id"], "value", xs), ["station_id"], xs)


_HAC2 = """hac2 AS (
  SELECT f.station_id, p.lag, f.n, f.b1, sqrt(greatest(0, f.n / (f.n - 2) * (f.i01 * f.i01 * m.m00 + 2 * f.i01 * f.i11 * m.m01 + f.i11 * f.i11 * m.m11))) AS se
  FROM (SELECT *, -sx / det AS i01, n / det AS i11 FROM (SELECT station_id, count(*)::DOUBLE AS n, sum(x) AS sx, count(*) * sum(x * x) - sum(x) * sum(x) AS det, regr_intercept(value, x) AS b0, regr_slope(value, x) AS b1 FROM sx GROUP BY ALL)) f
  CROSS JOIN (SELECT unnest([0, 7, 28]) AS lag) p
  JOIN LATERAL (SELECT sum(w * c00) AS m00, sum(w * c01) AS m01, sum(w * c11) AS m11 FROM (
      SELECT CASE WHEN l.l = 0 THEN 1.0 ELSE 1 - l.l / (p.lag + 1.0::DOUBLE) END AS w, CASE WHEN l.l = 0 THEN a.u * b.u ELSE 2 * a.u * b.u END AS c00, CASE WHEN l.l = 0 THEN a.u * b.u * b.x ELSE a.u * b.u * (a.x + b.x) END AS c01, CASE WHEN l.l = 0 THEN a.u * b.u * a.x * b.x ELSE 2 * a.u * b.u * a.x * b.x END AS c11
      FROM res a JOIN (SELECT unnest(range(29)) AS l) l ON l.l <= p.lag JOIN res b ON b.station_id = a.station_id AND b.rn = a.rn - l.l WHERE a.station_id = f.station_id)) m ON true)"""
_SX = "sx AS (SELECT *, date_diff('day', min(date) OVER (PARTITION BY station_id), date) / 30.0::DOUBLE AS x FROM seen)"
_RES = "res AS (SELECT s.station_id, s.rn, s.x, s.value - b0 - b1 * s.x AS u FROM sx s JOIN (SELECT station_id, regr_intercept(value, x) AS b0, regr_slope(value, x) AS b1 FROM sx GROUP BY ALL) USING (station_id))"


def _trend_fit(spark, sf, lags):
    design = stats.trend_design(days(spark, sf))
    xs = ["intercept", "trend"]
    return linear_core.hac_fit(design, ["station_id"], "value", xs, "pos", lags, size=None), xs


@query(
    "hac_covariance",
    v.sql(
        "daily_calendar",
        "SELECT station_id, lag::BIGINT AS lag, n::BIGINT AS n, round(b1, 6) AS coef, round(se, 6) AS se, round(b1 / se, 6) AS t FROM hac2",
        DAYS,
        SEEN,
        _SX,
        _RES,
        _HAC2,
    ),
)
def _(spark, sf):
    fit, xs = _trend_fit(spark, sf, [0, 7, 28])
    return linear_core.hac_rows(fit, ["station_id"], xs).filter("term = 'trend'").select(
        "station_id", "lag", "n", "coef", "se", "t"
    )


@query(
    "joint_wald",
    v.sql(
        "daily_calendar",
        "SELECT station_id, lag::BIGINT AS lag, round(power(b1 / se, 2), 6) AS f, 1::BIGINT AS df1, (n - 2)::BIGINT AS df2 FROM hac2",
        DAYS,
        SEEN,
        _SX,
        _RES,
        _HAC2,
    ),
)
def _(spark, sf):
    fit, xs = _trend_fit(spark, sf, [0, 7, 28])
    return linear_core.joint_wald(fit, xs, ["trend"]).select("station_id", "lag", "f", "df1", "df2")


@query("season_wald")
def _(spark, sf):
    """Season dummies beside a linear trend, tested jointly at two lags."""
    design = stats.trend_design(days(spark, sf))
    fit = linear_core.hac_fit(design, ["station_id"], "value", stats.SEASON_TERMS, "pos", [7, 28], size=None)
    return linear_core.joint_wald(fit, stats.SEASON_TERMS, stats.SEASON_TERMS[2:]).select(
        "station_id", "lag", "n", "f", "df1", "df2"
    )


@query(
    "trend_designs",
    v.sql(
        "daily_calendar",
        """SELECT station_id, date::VARCHAR AS date, 1.0::DOUBLE AS intercept, round(t, 6) AS trend, round(t * t, 6) AS trend2, (season = 'Spring')::INT::DOUBLE AS s_spring, (season = 'Summer')::INT::DOUBLE AS s_summer, (season = 'Autumn')::INT::DOUBLE AS s_autumn, weekend::DOUBLE AS weekend FROM (
        SELECT d.*, date_diff('day', f.d0, d.date) / 30.0::DOUBLE AS t FROM days d JOIN (SELECT station_id, min(date) FILTER (value IS NOT NULL) AS d0 FROM days GROUP BY ALL) f USING (station_id))""",
        DAYS,
    ),
)
def _(spark, sf):
    return stats.trend_design(v.daily_calendar(spark, sf)).select(
        "station_id", F.col("date").cast("string").alias("date"), "intercept", "trend", "trend2", "s_spring", "s_summer", "s_autumn", "weekend"
    )


_HACLOC = """hl AS (
  SELECT e.station_id, e.kind, p.lag, e.n, e.m AS estimate, e.nul, sqrt(greatest(0, (SELECT sum(CASE WHEN l.l = 0 THEN 1.0 ELSE 2 * (1 - l.l / (p.lag + 1.0::DOUBLE)) END * a.u * b.u) FROM cen a JOIN (SELECT unnest(range(29)) AS l) l ON l.l <= p.lag JOIN cen b ON b.station_id = a.station_id AND b.kind = a.kind AND b.rn = a.rn - l.l WHERE a.station_id = e.station_id AND a.kind = e.kind) / (e.n * e.n) * e.n / (e.n - 1))) AS se
  FROM (SELECT station_id, kind, any_value(nul) AS nul, count(*)::DOUBLE AS n, avg(y) AS m FROM kinds GROUP BY ALL) e CROSS JOIN (SELECT unnest([7, 28]) AS lag) p)"""


@query(
    "hac_location",
    v.sql(
        "daily_calendar",
        "SELECT station_id, kind, lag::BIGINT AS lag, n::BIGINT AS n, round(estimate, 6) AS estimate, round(se, 6) AS se, round((estimate - nul) / se, 6) AS t FROM hl",
        DAYS,
        SEEN,
        f"""kinds AS (SELECT station_id, rn, unnest(['mean', 'share', 'signed_rank']) AS kind, unnest([value, (value > {MU})::INT::DOUBLE, sign(value - {MU}) * r]) AS y, unnest([{MU}, 0.5, 0.0]) AS nul FROM (SELECT *, {rank_sql('a', 'station_id')} AS r FROM (SELECT *, abs(value - {MU}) AS a FROM seen)))""",
        "cen AS (SELECT k.station_id, k.kind, k.rn, k.y - avg(k.y) OVER (PARTITION BY k.station_id, k.kind) AS u FROM kinds k)",
        _HACLOC,
    ),
)
def _(spark, sf):
    return stats.hac_location(days(spark, sf), MU, [7, 28])


@query(
    "qq_points",
    v.sql(
        "daily_calendar",
        f"""SELECT station_id, round(value, 6) AS value, c AS cnt, round((r - 0.375) / (n + 0.25), 6) AS blom, round((value - m) / s, 6) AS z_sample FROM (SELECT DISTINCT station_id, value, {rank_sql('value', 'station_id')} AS r, count(*) OVER (PARTITION BY station_id, value) AS c, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM seen WINDOW w AS (PARTITION BY station_id))""",
        DAYS,
        SEEN,
    ),
)
def _(spark, sf):
    return stats.qq_points(days(spark, sf), quantile=False)


@query(
    "interaction_f_test",
    v.sql(
        "daily_calendar",
        """SELECT station_id, k AS n_strata, mc AS smallest_cell, n::BIGINT AS n, CASE WHEN mc >= 2 THEN 'tested' ELSE 'insufficient_data' END AS status, CASE WHEN mc >= 2 THEN round(b, 6) END AS additive_effect, k - 1 AS df1, (n - 2 * k)::BIGINT AS df2, CASE WHEN mc >= 2 THEN round(((yy - b * fy - ssf) / (k - 1)) / (ssf / (n - 2 * k)), 6) END AS f FROM (
          SELECT station_id, count(*) AS n, sum(y * y) AS yy, sum(f * y) AS fy, sum(f * y) / sum(f * f) AS b, sum(e * e) AS ssf, count(DISTINCT season) AS k, CASE WHEN count(DISTINCT (season, flag)) < 2 * count(DISTINCT season) THEN 0 ELSE min(cc) END AS mc FROM (
            SELECT station_id, season, flag AS flag, flag - avg(flag) OVER s AS f, value - avg(value) OVER s AS y, value - avg(value) OVER c AS e, count(*) OVER c AS cc FROM seen WINDOW s AS (PARTITION BY station_id, season), c AS (PARTITION BY station_id, season, flag)) GROUP BY ALL)""",
        DAYS,
        SEEN,
    ),
)
def _(spark, sf):
    return stats.interaction_f_test(days(spark, sf), "flag", "season", "value").drop("sse_full", "sse_additive")


@query(
    "stratum_contrasts",
    v.sql(
        "daily_calendar",
        """SELECT station_id, season, n1, n0, round(m1 - m0, 6) AS effect, round(sqrt(ssf / dfr * (1 / n1 + 1 / n0)), 6) AS se, round(m1 - m0 - (r1 - r0), 6) AS double_difference FROM (
          SELECT d.station_id, d.season, count(*) FILTER (d.flag = 1) AS n1, count(*) FILTER (d.flag = 0) AS n0, avg(d.value) FILTER (d.flag = 1) AS m1, avg(d.value) FILTER (d.flag = 0) AS m0,
            (SELECT avg(o.value) FROM seen o WHERE o.station_id = d.station_id AND o.season <> d.season AND o.flag = 1) AS r1, (SELECT avg(o.value) FROM seen o WHERE o.station_id = d.station_id AND o.season <> d.season AND o.flag = 0) AS r0 FROM seen d GROUP BY d.station_id, d.season)
        JOIN (SELECT station_id, sum(e * e) AS ssf, count(*) - 2 * count(DISTINCT season) AS dfr FROM (SELECT station_id, season, value - avg(value) OVER (PARTITION BY station_id, season, flag) AS e FROM seen) GROUP BY ALL) USING (station_id)""",
        DAYS,
        SEEN,
    ),
)
def _(spark, sf):
    seen = days(spark, sf).filter("value is not null")
    return stats.stratum_contrasts(seen, "flag", "season", "value")


def _mi_sql(b):
    return f"""SELECT station_id, {b}::BIGINT AS bins, n, round(sum(c / n * ln(c * n / (cb * cf)::DOUBLE)), 6) AS mi FROM (SELECT station_id, c, sum(c) OVER (PARTITION BY station_id)::BIGINT AS n, sum(c) OVER (PARTITION BY station_id, bin) AS cb, sum(c) OVER (PARTITION BY station_id, flag) AS cf FROM (SELECT station_id, bin, flag, count(*) AS c FROM b{b} GROUP BY ALL)) GROUP BY station_id, n"""


@query(
    "binned_mutual_information",
    v.sql(
        "daily_calendar",
        " UNION ALL ".join(_mi_sql(b) for b in (5, 10, 20)),
        DAYS,
        "seen AS (SELECT station_id, value, flag FROM days WHERE value IS NOT NULL)",
        *[bin_sql(f"b{b}", "seen", "value", b) for b in (5, 10, 20)],
    ),
)
def _(spark, sf):
    return stats.binned_mutual_information(days(spark, sf), "flag", [5, 10, 20])


@query(
    "calendar_diagnostics",
    v.sql(
        "daily_calendar",
        """SELECT station_id, sum(k)::BIGINT AS n_days, sum(k) FILTER (NOT miss)::BIGINT AS n_observed, round(sum(k) FILTER (miss) / sum(k), 6) AS missing_share, count(*) FILTER (miss) AS n_missing_runs, round(avg(k) FILTER (miss), 6) AS mean_missing_run, max(k) FILTER (miss) AS longest_missing_run FROM (
          SELECT station_id, run, any_value(miss) AS miss, count(*) AS k FROM (SELECT station_id, value IS NULL AS miss, pos - row_number() OVER (PARTITION BY station_id, value IS NULL ORDER BY pos) AS run FROM days) GROUP BY station_id, miss, run) GROUP BY ALL""",
        DAYS,
    ),
)
def _(spark, sf):
    return stats.calendar_diagnostics(v.daily_calendar(spark, sf))


@query(
    "season_generalisation",
    v.sql(
        "daily_calendar",
        f"""SELECT m.station_id, round(t.b1, 6) AS trend_per_month, round(m.contrast, 6) AS max_season_contrast, round(abs(t.b1 * 12) / m.contrast, 6) AS trend_to_contrast_ratio, m.n_seasons FROM (
          SELECT station_id, max(md) - min(md) AS contrast, count(*) AS n_seasons FROM (SELECT station_id, season, quantile_cont(value, 0.5) AS md FROM seen GROUP BY ALL) GROUP BY ALL) m
        JOIN (SELECT station_id, sum(ry * rx) / sum(rx * rx) AS b1 FROM (SELECT station_id, value - avg(value) OVER s AS ry, x - avg(x) OVER s AS rx FROM sx WINDOW s AS (PARTITION BY station_id, season)) GROUP BY ALL) t USING (station_id)""",
        DAYS,
        SEEN,
        _SX,
    ),
)
def _(spark, sf):
    return plan.season_generalisation(days(spark, sf))


@query("location_p_values")
def _(spark, sf):
    """Robust and classic location tests with p-values and intervals."""
    d = days(spark, sf)
    robust = stats.hac_location(d, MU, [28], p_values=True).select("station_id", "kind", "t", "p_value", "ci_low", "ci_high")
    classic = stats.one_sample_t(d, MU, p_values=True).select(
        "station_id", F.lit("classic_t").alias("kind"), "t", "p_value", "ci_low", "ci_high"
    )
    signed = stats.signed_rank(d, MU, p_values=True).select(
        "station_id", F.lit("wilcoxon").alias("kind"), F.col("z").alias("t"), "p_value",
        F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high"),
    )
    return robust.unionByName(classic).unionByName(signed)


@query("group_p_values")
def _(spark, sf):
    """Rank and F tests with p-values on the same groups."""
    d = days(spark, sf)
    mw = stats.mann_whitney(d, "weekend", 0, 1, p_values=True).select("station_id", F.lit("mann_whitney").alias("test"), F.col("u").alias("statistic"), "p_value")
    kw = stats.kruskal_wallis(d, "season", p_values=True).select("station_id", F.lit("kruskal_wallis").alias("test"), F.col("h").alias("statistic"), "p_value")
    ft = stats.interaction_f_test(d, "flag", "season", "value", p_values=True).select("station_id", F.lit("interaction").alias("test"), F.col("f").alias("statistic"), "p_value")
    return mw.unionByName(kw).unionByName(ft)


@query("qq_normal_quantiles")
def _(spark, sf):
    return stats.qq_points(days(spark, sf)).select("station_id", "value", "blom", "z_normal")
