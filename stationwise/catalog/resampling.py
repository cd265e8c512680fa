"""Block resampling, null tests and composed inference (inventory 2.8, second part).

The seeded hash makes every draw reproducible in SQL, so replicates are compared
value by value. Replicate counts are the reference's: N_CI for intervals, N_NULL
for p-values.
"""

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import resample
from ..plans import inference as plan
from ..session import written
from . import query, views as v
from .inference import DAYS, MU, SEEN, days, rank_sql
from .panels import WEEKDIFF, WEEKLY

N_CI, N_NULL, SEED = 1000, 5000, 42
SEASON_PAIRS = [("Winter", "Summer"), ("Spring", "Autumn")]


def calendar(spark, sf):
    """The calendar, written once for plans that read it many times."""
    return written(days(spark, sf), "calendar")


def draw(*parts):
    return f"('0x' || substr(md5({' || \':\' || '.join(parts)}), 1, 8))::BIGINT"


def reps_sql(name, src, blocks, n_boot, labels="", key="station_id"):
    """n_boot replicates of a calendar CTE (station_id, pos, value, labels...)."""
    keys = [k.strip() for k in key.split(",")]
    lab = "".join(f", d.{c}" for c in labels.split())
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    sel = ", ".join(f"s.{k}" for k in keys)
    return f"""{name} AS (SELECT {', '.join(f'x.{k}' for k in keys)}, x.block, x.b, x.dest, c.value{lab} FROM (
      SELECT {sel}, s.block, s.b, s.j * s.len + o.o AS dest, (s.start + o.o) % s.n AS src FROM (
        SELECT *, {draw(f"'{SEED}'", *keys, 'b', 'j')} % n AS start FROM (SELECT *, unnest(range(0, ceil(n / len)::BIGINT)) AS j FROM (SELECT *, least(block, n) AS len FROM (SELECT {key}, max(pos) + 1 AS n FROM {src} GROUP BY ALL) CROSS JOIN (SELECT unnest({list(blocks)}) AS block) CROSS JOIN (SELECT unnest(range(1, {n_boot} + 1)) AS b)))) s
      JOIN (SELECT unnest(range(0, {max(blocks)})) AS o) o ON o.o < s.len WHERE s.j * s.len + o.o < s.n) x
    JOIN {src} c ON {on('c', 'x')} AND c.pos = x.src JOIN {src} d ON {on('d', 'x')} AND d.pos = x.dest)"""


COMPACT = "compact AS (SELECT station_id, rn - 1 AS pos, value FROM seen)"
_CI = "SELECT station_id, block::BIGINT AS block, count(*) AS n_replicates, round(quantile_cont(stat, 0.025), 6) AS ci_low, round(quantile_cont(stat, 0.975), 6) AS ci_high, round(stddev_samp(stat), 6) AS replicate_sd, round(avg(obs), 6) AS mean_observed, round(any_value(point), 6) AS point FROM (SELECT station_id, block, b, {stat} AS stat, count(value) AS obs FROM reps GROUP BY ALL) JOIN (SELECT station_id, {stat} AS point FROM {src} GROUP BY ALL) USING (station_id) WHERE stat IS NOT NULL GROUP BY station_id, block"
_MEDIAN, _MEAN = "quantile_cont(value, 0.5)", "avg(value)"


@query(
    "block_bootstrap_ci",
    v.sql("daily_calendar", _CI.format(stat=_MEDIAN, src="compact"), DAYS, SEEN, COMPACT, reps_sql("reps", "compact", [28], N_CI)),
)
def _(spark, sf):
    return resample.compact_ci(days(spark, sf), "median", N_CI, 28, SEED)


@query(
    "calendar_bootstrap_ci",
    v.sql("daily_calendar", _CI.format(stat=_MEAN, src="days"), DAYS, reps_sql("reps", "days", [7, 28], N_CI)),
)
def _(spark, sf):
    return resample.calendar_ci(days(spark, sf), "mean", N_CI, [7, 28], SEED)


def null_sql(stat, observed, keys="station_id", alt="greater"):
    ge, le = f"(1 + n_ge) / ({N_NULL} + 1.0::DOUBLE)", f"(1 + n_le) / ({N_NULL} + 1.0::DOUBLE)"
    p = {"greater": ge, "two-sided": f"least(1, 2 * least({ge}, {le}))"}[alt]
    return f"""SELECT {keys}, block::BIGINT AS block, round(observed, 6) AS observed, n_replicates, n_ge, n_le, round({p}, 6) AS p_value FROM (
      SELECT {keys}, block, any_value(observed) AS observed, count(*) AS n_replicates, count(*) FILTER (stat >= observed) AS n_ge, count(*) FILTER (stat <= observed) AS n_le FROM ({stat}) JOIN ({observed}) USING ({keys}) GROUP BY {keys}, block)"""


def h_sql(label, k, reps="reps"):
    return f"""SELECT station_id, block, b, 12 / (sum(c) * (sum(c) + 1)) * sum(r * r / c) - 3 * (sum(c) + 1) AS stat FROM (SELECT station_id, block, b, {label}, sum(rk) AS r, count(*)::DOUBLE AS c FROM (SELECT *, {rank_sql('value', 'station_id, block, b')} AS rk FROM {reps} WHERE value IS NOT NULL) GROUP BY ALL) GROUP BY station_id, block, b HAVING count(*) = {k}"""


def h_observed(src, label):
    return f"""SELECT station_id, (12 / (sum(k) * (sum(k) + 1)) * sum(rs * rs / k) - 3 * (sum(k) + 1)) / (1 - sum(ties) / (sum(k) * sum(k) * sum(k) - sum(k))) AS observed FROM (SELECT station_id, {label}, count(*)::DOUBLE AS k, sum(r) AS rs, sum((c * c * c - c) / c::DOUBLE) AS ties FROM (SELECT *, {rank_sql('value', 'station_id')} AS r, count(*) OVER (PARTITION BY station_id, value) AS c FROM {src} WHERE value IS NOT NULL) GROUP BY ALL) GROUP BY ALL"""


@query(
    "calendar_null_test",
    v.sql("daily_calendar", null_sql(h_sql("season", 4), h_observed("days", "season")), DAYS, reps_sql("reps", "days", [14, 28], N_NULL, "season")),
)
def _(spark, sf):
    return resample.null_test_h(days(spark, sf), "season", 4, N_NULL, [14, 28], SEED)


_U_STAT = f"""SELECT station_id, block, b, sum(rk) FILTER (weekend = 0) - count(*) FILTER (weekend = 0) * (count(*) FILTER (weekend = 0) + 1) / 2 AS stat FROM (SELECT *, {rank_sql('value', 'station_id, block, b')} AS rk FROM reps WHERE value IS NOT NULL) GROUP BY ALL"""
_U_OBS = f"""SELECT station_id, sum(r) FILTER (weekend = 0) - count(*) FILTER (weekend = 0) * (count(*) FILTER (weekend = 0) + 1) / 2 AS observed FROM (SELECT *, {rank_sql('value', 'station_id')} AS r FROM seen) GROUP BY ALL"""


@query(
    "calendar_null_test_u",
    v.sql("daily_calendar", null_sql(_U_STAT, _U_OBS, alt="two-sided"), DAYS, SEEN, reps_sql("reps", "days", [28], N_NULL, "weekend")),
)
def _(spark, sf):
    return resample.null_test_u(days(spark, sf), "weekend", 0, 1, N_NULL, [28], SEED)


_T_STAT = "SELECT station_id, block, b, avg(value) / sqrt(var_samp(value) / count(value)) AS stat FROM reps GROUP BY ALL"
_T_OBS = f"SELECT station_id, (avg(value) - {MU}) / (stddev_samp(value) / sqrt(count(value))) AS observed FROM days GROUP BY ALL"


@query(
    "null_imposed_mean",
    v.sql(
        "daily_calendar",
        null_sql(_T_STAT, _T_OBS, alt="two-sided"),
        DAYS,
        "noise AS (SELECT station_id, pos, value - avg(value) OVER (PARTITION BY station_id) AS value FROM days)",
        reps_sql("reps", "noise", [7, 28], N_NULL),
    ),
)
def _(spark, sf):
    return resample.null_imposed_location(days(spark, sf), MU, "t", N_NULL, [7, 28], SEED)


_W_STAT = f"SELECT station_id, block, b, coalesce(sum(rk) FILTER (value > 0), 0) AS stat FROM (SELECT *, {rank_sql('a', 'station_id, block, b')} AS rk FROM (SELECT *, abs(value) AS a FROM reps WHERE value IS NOT NULL)) GROUP BY ALL"


def w_obs(src, mu):
    return f"SELECT station_id, sum(r) FILTER (value > {mu}) AS observed FROM (SELECT *, {rank_sql('a', 'station_id')} AS r FROM (SELECT *, abs(value - {mu}) AS a FROM {src} WHERE value IS NOT NULL AND value <> {mu})) GROUP BY ALL"


@query(
    "null_imposed_location",
    v.sql(
        "daily_calendar",
        null_sql(_W_STAT, w_obs("seen", MU), alt="two-sided"),
        DAYS,
        SEEN,
        "noise AS (SELECT d.station_id, d.pos, d.value - m.m AS value FROM days d JOIN (SELECT station_id, quantile_cont(value, 0.5) AS m FROM days GROUP BY ALL) m USING (station_id))",
        reps_sql("reps", "noise", [28], N_NULL),
    ),
)
def _(spark, sf):
    return resample.null_imposed_location(days(spark, sf), MU, "signed_rank", N_NULL, [28], SEED)


@query(
    "percentile_pvalue",
    v.sql(
        "daily_calendar",
        f"""SELECT station_id, round(point, 6) AS point, round((1 + count(*) FILTER (abs(stat - point) >= abs({MU} - point))) / ({N_NULL} + 1.0::DOUBLE), 6) AS p_value FROM (SELECT station_id, b, {_MEDIAN} AS stat FROM reps GROUP BY ALL) JOIN (SELECT station_id, {_MEDIAN} AS point FROM days GROUP BY ALL) USING (station_id) GROUP BY station_id, point""",
        DAYS,
        SEEN,
        COMPACT,
        reps_sql("reps", "compact", [28], N_NULL),
    ),
)
def _(spark, sf):
    return resample.percentile_pvalue(days(spark, sf), MU, "median", N_NULL, 28, SEED)


@query(
    "dense_block_null_test",
    v.sql(
        "daily_calendar",
        null_sql(h_sql("third", 3), h_observed("dense", "third")),
        DAYS,
        SEEN,
        COMPACT,
        "dense AS (SELECT *, pos % 3 AS third FROM compact)",
        reps_sql("reps", "dense", [28], N_NULL, "third"),
    ),
)
def _(spark, sf):
    dense = resample.compact_calendar(days(spark, sf)).withColumn("third", F.col("pos") % 3)
    return resample.dense_null_test(dense, "h", N_NULL, 28, SEED, label="third", n_labels=3)


_CONTRAST = [
    "seg AS (SELECT *, min(pos) OVER g AS first, count(*) OVER g AS len FROM (SELECT station_id, pos, value, season, pos - row_number() OVER (PARTITION BY station_id, season ORDER BY pos) AS isl FROM days) WINDOW g AS (PARTITION BY station_id, season, isl))",
    "win AS (SELECT station_id, season, first, pos, least(28, len) AS wl, obs FROM (SELECT *, count(value) OVER (PARTITION BY station_id, season, first ORDER BY pos RANGE BETWEEN CURRENT ROW AND 27 FOLLOWING) AS obs FROM seg) WHERE obs > 0 AND pos <= first + len - least(28, len))",
    "wseg AS (SELECT s.station_id, s.season, s.first, s.so, s.so / w.mo AS weight, w.k FROM (SELECT station_id, season, first, count(value) AS so FROM seg GROUP BY ALL) s JOIN (SELECT station_id, season, first, avg(obs) AS mo, count(*) AS k FROM win GROUP BY ALL) w USING (station_id, season, first))",
    "prob AS (SELECT *, sum(weight) OVER (PARTITION BY station_id, season) AS total, sum(so) OVER (PARTITION BY station_id, season)::BIGINT AS target FROM wseg)",
    "cum AS (SELECT w.station_id, w.season, w.pos, w.wl, w.obs, p.target, min(w.obs) OVER (PARTITION BY w.station_id, w.season) AS least_obs, sum(p.weight / p.total / p.k) OVER (PARTITION BY w.station_id, w.season ORDER BY w.pos ROWS UNBOUNDED PRECEDING) AS hi0, lead(w.pos) OVER (PARTITION BY w.station_id, w.season ORDER BY w.pos) AS nx FROM win w JOIN prob p USING (station_id, season, first))",
    "bounds AS (SELECT *, CASE WHEN nx IS NULL THEN 1.0 ELSE hi0 END AS hi, lag(hi0, 1, 0.0) OVER (PARTITION BY station_id, season ORDER BY pos) AS lo FROM cum)",
    f"draws AS (SELECT *, {draw(f"'{SEED}'", 'station_id', 'season', 'b', 'j')} / 4294967296.0::DOUBLE AS u FROM (SELECT *, unnest(range(0, ceil(target / least_obs)::BIGINT)) AS j FROM (SELECT DISTINCT station_id, season, target, least_obs FROM cum) CROSS JOIN (SELECT unnest(range(1, {N_CI} + 1)) AS b)))",
    "hits AS (SELECT d.station_id, d.season, d.b, d.j, d.target, w.pos, w.wl, coalesce(sum(w.obs) OVER (PARTITION BY d.station_id, d.season, d.b ORDER BY d.j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM draws d JOIN bounds w ON w.station_id = d.station_id AND w.season = d.season AND d.u >= w.lo AND d.u < w.hi)",
    "vals AS (SELECT * FROM (SELECT h.station_id, h.season, h.b, h.target, h.before + row_number() OVER (PARTITION BY h.station_id, h.season, h.b, h.j ORDER BY c.pos) AS nth, c.value FROM hits h JOIN seen c ON c.station_id = h.station_id AND c.pos BETWEEN h.pos AND h.pos + h.wl - 1 WHERE h.before < h.target) WHERE nth <= target)",
    f"stats AS (SELECT station_id, season, b, {_MEDIAN} AS stat FROM vals GROUP BY ALL)",
    f"pts AS (SELECT station_id, season, {_MEDIAN} AS point FROM days GROUP BY ALL)",
]


@query(
    "contrast_ci",
    v.sql(
        "daily_calendar",
        """SELECT station_id, group_a, group_b, round(point, 6) AS point, round(CASE WHEN point BETWEEN lo AND hi THEN lo ELSE point - half END, 6) AS ci_low, round(CASE WHEN point BETWEEN lo AND hi THEN hi ELSE point + half END, 6) AS ci_high, CASE WHEN point BETWEEN lo AND hi THEN 'percentile' ELSE 'symmetric_absolute_deviation' END AS ci_method, n AS n_replicates, round(sd, 6) AS replicate_sd FROM (
        SELECT a.station_id, p.group_a, p.group_b, any_value(pa.point - pz.point) AS point, count(*) AS n, quantile_cont(a.stat - z.stat, 0.025) AS lo, quantile_cont(a.stat - z.stat, 0.975) AS hi, quantile_cont(abs(a.stat - z.stat - (pa.point - pz.point)), 0.95) AS half, stddev_samp(a.stat - z.stat) AS sd
        FROM (SELECT unnest(['Winter', 'Spring']) AS group_a, unnest(['Summer', 'Autumn']) AS group_b) p JOIN stats a ON a.season = p.group_a JOIN stats z ON z.season = p.group_b AND z.station_id = a.station_id AND z.b = a.b
        JOIN pts pa ON pa.station_id = a.station_id AND pa.season = p.group_a JOIN pts pz ON pz.station_id = a.station_id AND pz.season = p.group_b GROUP BY ALL)""",
        DAYS,
        SEEN,
        *_CONTRAST,
    ),
)
def _(spark, sf):
    return resample.contrast_ci(calendar(spark, sf), "season", SEASON_PAIRS, "median", 28, N_CI, SEED)


_WPOS = "(SELECT *, date_diff('week', min(week_start) OVER (PARTITION BY station_id), week_start) AS pos FROM {0})"


@query(
    "paired_weekly",
    v.sql(
        "daily_calendar",
        f"""SELECT t.station_id, o.n, round(o.wp, 6) AS w_plus, round((2 * o.wp - o.n * (o.n + 1) / 2) / (o.n * (o.n + 1) / 2), 6) AS rank_biserial, round(o.med, 6) AS median, round(o.mean, 6) AS mean_difference, round(o.share, 6) AS share_weekday_higher, t.p_value, t.n_ge, t.n_le, round(c.lo, 6) AS ci_low, round(c.hi, 6) AS ci_high
        FROM ({null_sql(_W_STAT, w_obs('wd', 0.0), alt='two-sided')}) t JOIN (SELECT station_id, count(*) AS n, sum(r) FILTER (value > 0) AS wp, quantile_cont(value, 0.5) AS med, avg(value) AS mean, count(*) FILTER (value > 0) / count(*) AS share FROM (SELECT *, {rank_sql('a', 'station_id')} AS r FROM (SELECT *, abs(value) AS a FROM wd WHERE value IS NOT NULL)) GROUP BY ALL) o USING (station_id)
        JOIN (SELECT station_id, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM (SELECT station_id, b, {_MEDIAN} AS stat FROM reps2 GROUP BY ALL) WHERE stat IS NOT NULL GROUP BY ALL) c USING (station_id)""",
        DAYS,
        WEEKDIFF,
        f"wd AS (SELECT station_id, pos, difference AS value FROM {_WPOS.format('weekdiff')})",
        "noise AS (SELECT d.station_id, d.pos, d.value - m.m AS value FROM wd d JOIN (SELECT station_id, quantile_cont(value, 0.5) AS m FROM wd GROUP BY ALL) m USING (station_id))",
        reps_sql("reps", "noise", [4], N_NULL),
        reps_sql("reps2", "wd", [4], N_CI),
    ),
)
def _(spark, sf):
    return plan.paired_weekly(days(spark, sf), N_NULL, N_CI, SEED).drop("p_independence")


@query(
    "weekly_season",
    v.sql(
        "daily_calendar",
        f"""SELECT t.station_id, o.n::BIGINT AS n, t.observed AS h, round(least(greatest(x.observed / (o.n - 1), 0), 1), 6) AS epsilon_squared, t.p_value, t.n_replicates, t.n_ge FROM ({null_sql(h_sql('season', 4), h_observed('wk', 'season'))}) t JOIN ({h_observed('wk', 'season')}) x USING (station_id) JOIN (SELECT station_id, count(value) AS n FROM wk GROUP BY ALL) o USING (station_id)""",
        DAYS,
        WEEKLY,
        f"wk AS (SELECT station_id, pos, week_mean AS value, season FROM {_WPOS.format('weekly')})",
        reps_sql("reps", "wk", [4], N_NULL, "season"),
    ),
)
def _(spark, sf):
    return plan.weekly_season(days(spark, sf), N_NULL, SEED).drop("p_independence")


@query(
    "inference_sensitivity",
    v.sql(
        "obs_grid",
        f"""SELECT station_id, min_hours::BIGINT AS min_hours, block::BIGINT AS block, count(*) AS n_replicates, round(quantile_cont(stat, 0.025), 6) AS ci_low, round(quantile_cont(stat, 0.975), 6) AS ci_high, round(stddev_samp(stat), 6) AS replicate_sd, round(avg(obs), 6) AS mean_observed, round(any_value(point), 6) AS point FROM (SELECT station_id, min_hours, block, b, {_MEDIAN} AS stat, count(value) AS obs FROM reps GROUP BY ALL)
        JOIN (SELECT station_id, min_hours, {_MEDIAN} AS point FROM cal GROUP BY ALL) USING (station_id, min_hours) WHERE stat IS NOT NULL GROUP BY station_id, min_hours, block""",
        "dd AS (SELECT station_id, CAST(timestamp AS DATE) AS date, count(pm25) AS k, avg(pm25) AS m FROM obs_grid GROUP BY ALL)",
        "cal AS (SELECT station_id, min_hours, date_diff('day', min(date) OVER (PARTITION BY station_id), date) AS pos, CASE WHEN k >= min_hours THEN m END AS value FROM dd CROSS JOIN (SELECT unnest([12, 18, 24]) AS min_hours))",
        reps_sql("reps", "cal", S.SENSITIVITY_BLOCKS, N_CI, key="station_id, min_hours"),
    ),
)
def _(spark, sf):
    return plan.inference_sensitivity(v.obs_grid(spark, sf), [12, 18, 24], S.SENSITIVITY_BLOCKS, N_CI, SEED)


@query(
    "yearly_sensitivity",
    v.sql(
        "daily_calendar",
        f"""SELECT station_id, year, block::BIGINT AS block, count(*) AS n_replicates, round(quantile_cont(stat, 0.025), 6) AS ci_low, round(quantile_cont(stat, 0.975), 6) AS ci_high, round(stddev_samp(stat), 6) AS replicate_sd, round(avg(obs), 6) AS mean_observed, round(any_value(point), 6) AS point FROM (SELECT station_id, year, block, b, {_MEDIAN} AS stat, count(value) AS obs FROM reps GROUP BY ALL)
        JOIN (SELECT station_id, year, {_MEDIAN} AS point FROM cal GROUP BY ALL) USING (station_id, year) WHERE stat IS NOT NULL GROUP BY station_id, year, block""",
        DAYS,
        "cal AS (SELECT station_id, year, pos - min(pos) OVER w AS pos, value FROM (SELECT *, year(date) AS year, count(value) OVER (PARTITION BY station_id, year(date)) AS k FROM days) WHERE k >= 30 WINDOW w AS (PARTITION BY station_id, year))",
        reps_sql("reps", "cal", [28], N_CI, key="station_id, year"),
    ),
)
def _(spark, sf):
    return plan.yearly_sensitivity(days(spark, sf), N_CI, 28, SEED)


@query(
    "without_partial_winters",
    v.sql(
        "daily_calendar",
        """SELECT station_id, count(*) AS n_days, count(value) AS n_before, count(CASE WHEN NOT (season = 'Winter' AND obs / total < 0.45) THEN value END) AS n_after FROM (SELECT *, count(value) OVER (PARTITION BY station_id, season, sy) AS obs, date_diff('day', make_date(sy - 1, 12, 1), make_date(sy, 3, 1)) AS total FROM (SELECT *, year(date) + (month(date) = 12)::INT AS sy FROM days)) GROUP BY ALL""",
        DAYS,
    ),
)
def _(spark, sf):
    d = days(spark, sf)
    after = plan.without_partial_winters(d, full_share=0.45).select("station_id", "pos", F.col("value").alias("after"))
    return d.join(after, ["station_id", "pos"]).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.count("value").alias("n_before"), F.count("after").alias("n_after")
    )


@query("season_effect")
def _(spark, sf):
    return plan.season_effect(calendar(spark, sf), N_NULL, SEED)


@query("weekday_effect")
def _(spark, sf):
    return plan.weekday_effect(calendar(spark, sf), N_NULL, SEED)


@query("location_effect")
def _(spark, sf):
    return plan.location_effect(calendar(spark, sf), MU, "median", "median_location", N_NULL, SEED)


@query("posthoc_pairs")
def _(spark, sf):
    return plan.posthoc_pairs(calendar(spark, sf), N_NULL, N_CI, SEED)


@query("inference_suite")
def _(spark, sf):
    return plan.inference_suite(days(spark, sf), MU, 250.0, N_NULL, SEED)


@query("inference_recheck")
def _(spark, sf):
    """Bootstrap intervals of the mean, checked by prefix sums and by the closed form."""
    d = calendar(spark, sf)
    reported = written(resample.compact_mean_report(d, N_NULL, S.SENSITIVITY_BLOCKS, SEED), "reported")
    return plan.inference_recheck(reported, d, N_NULL, S.SENSITIVITY_BLOCKS, SEED)
