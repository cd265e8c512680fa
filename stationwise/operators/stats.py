"""Dependence-aware statistics over daily calendars, all stations in one job.

Tables hold one row per (station, day): value (NULL = missing), pos (dense day
number) and optional labels. p-values are added on result rows only. A station's
group is bounded by the calendar, so plain windows and built-in percentiles are
used here (size=None, bounded=True).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import dist
from ..functions import scalar as fn
from .linear_core import hac_fit, hac_rows
from .profile import quantile_bins
from .ranks import average_ranks, cumulative_counts, quantiles
from .sequence import runs, windowed

KEYS = (S.STATION,)


def holm(df: DataFrame, family: Sequence[str], p: str, order: str) -> DataFrame:
    """Step-down adjusted p within a family of tests (a handful of rows); ties keep the given order; rows without p are not in the family."""
    w = W.partitionBy(*family)
    ordered = w.orderBy(F.col(p).asc_nulls_last(), F.col(order))
    m, rank = F.count(p).over(w), F.row_number().over(ordered)
    step = df.withColumn("_step", (m - rank + 1) * F.col(p))
    return step.withColumn(
        "holm_p",
        F.when(
            F.col(p).isNotNull(),
            F.least(F.lit(1.0), F.max("_step").over(ordered.rowsBetween(W.unboundedPreceding, 0))),
        ),
    ).drop("_step")


def distribution_diagnostics(df: DataFrame, value: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    """Moments, quartiles, 3-sd outliers, shape words and the two moment tests of normality."""
    keys = list(keys)
    v = F.col(value)
    base = df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        fn.sample_skewness(value).alias("skewness"),
        fn.sample_kurtosis(value).alias("kurtosis"),
        F.skewness(v).alias("_g1"),
        F.kurtosis(v).alias("_g2"),
    )
    q = quantiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, bounded=True)
    out3 = (
        df.join(base.select(*keys, "mean", "sd"), keys)
        .groupBy(*keys)
        .agg(F.count_if(F.abs(v - F.col("mean")) > 3 * F.col("sd")).alias("n_outliers_3sd"))
    )
    n = F.col("n").cast("double")
    b = F.col("_g1")
    # D'Agostino: transformed skewness
    y = b * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    ya = y / F.sqrt(2.0 / (w2 - 1))
    z1 = F.log(ya + F.sqrt(ya * ya + 1)) / F.sqrt(0.5 * F.log(w2))
    # Anscombe-Glynn: transformed kurtosis
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("_g2") + 3 - e) / F.sqrt(var)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / root * (2.0 / root + F.sqrt(1 + 4.0 / (root * root)))
    core = (1 - 2.0 / a) / (1 + x * F.sqrt(2.0 / (a - 4.0)))
    z2 = ((1 - 2.0 / (9.0 * a)) - F.signum(core) * F.pow(F.abs(core), F.lit(1 / 3))) / F.sqrt(2.0 / (9.0 * a))
    skew = F.col("skewness")
    return (
        base.join(q, keys, "left")
        .join(out3, keys, "left")
        .withColumns(
            {
                "iqr": F.col("q75") - F.col("q25"),
                "shape": F.when(F.abs(skew) < 0.5, "symmetric").when(skew > 0, "right-skewed").otherwise("left-skewed"),
                "jarque_bera": n / 6 * (b * b + F.col("_g2") * F.col("_g2") / 4),
                "dagostino_k2": F.when(n >= 8, z1 * z1 + z2 * z2),
            }
        )
        .drop("_g1", "_g2")
    )


def autocorrelation(
    df: DataFrame, lags: Sequence[int], value: str = "value", keys: Sequence[str] = KEYS, pos: str = "pos"
) -> DataFrame:
    """Pairwise-complete Pearson correlation at calendar distance l; needs three pairs and two varying sides."""
    lags = sorted(set(lags))
    moved = windowed(
        df.select(*keys, pos, value),
        list(keys),
        pos,
        {f"_l{l}": lambda w, l=l: F.max(value).over(w.rangeBetween(-l, -l)) for l in lags},
        back=max(lags),
        size=None,
    )
    aggs = []
    for l in lags:
        x = F.when(F.col(f"_l{l}").isNotNull(), F.col(value))
        z = F.when(F.col(value).isNotNull(), F.col(f"_l{l}"))
        aggs += [F.count(x).alias(f"_n{l}"), F.when(F.count(x) >= 3, fn.safe_corr(x, z)).alias(f"_r{l}")]
    wide = moved.groupBy(*keys).agg(*aggs)
    cells = [
        F.struct(F.lit(l).cast("long").alias("lag"), F.col(f"_n{l}").alias("n_pairs"), F.col(f"_r{l}").alias("rho"))
        for l in lags
    ]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("_r")).select(*keys, "_r.*")


def effective_n(df: DataFrame, value: str = "value", keys: Sequence[str] = KEYS, pos: str = "pos") -> DataFrame:
    """n shrunk by lag-1 dependence; a constant series counts as almost perfectly dependent."""
    rho = autocorrelation(df, [1], value, keys, pos).select(*keys, "rho")
    n = df.groupBy(*keys).agg(
        F.count(value).alias("n"), ((F.count(value) >= 3) & (F.min(value) == F.max(value))).alias("_constant")
    )
    r = F.least(F.when(F.col("_constant"), 0.999999).otherwise(F.col("rho")), F.lit(0.999999))
    r = F.when(F.col("_constant") | F.col("rho").isNotNull(), r)
    eff = F.try_divide(F.col("n") * (1 - F.col("rho_lag1")), 1 + F.col("rho_lag1"))
    joined = n.join(rho, list(keys), "left").withColumn("rho_lag1", r).drop("rho", "_constant")
    return joined.withColumn("n_effective", eff).withColumn(
        "inflation_factor", F.try_divide("n", "n_effective")
    )


def two_group_moments(df: DataFrame, group: str, a, b, value: str, keys: Sequence[str]) -> DataFrame:
    one = lambda g: F.when(F.col(group) == F.lit(g), F.col(value))
    return df.groupBy(*keys).agg(
        *[
            c
            for tag, g in (("a", a), ("b", b))
            for c in (
                F.count(one(g)).alias(f"n_{tag}"),
                F.avg(one(g)).alias(f"mean_{tag}"),
                F.var_samp(one(g)).alias(f"var_{tag}"),
            )
        ]
    )


def min_detectable_difference(
    df: DataFrame, group: str, a, b, value: str = "value", keys: Sequence[str] = KEYS, z_alpha: float = 1.959963984540054, z_power: float = 0.8416212335729143
) -> DataFrame:
    m = two_group_moments(df, group, a, b, value, keys)
    n1, n2 = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(F.try_divide((n1 - 1) * F.col("var_a") + (n2 - 1) * F.col("var_b"), n1 + n2 - 2))
    return m.select(
        *keys,
        "n_a",
        "n_b",
        pooled.alias("pooled_sd"),
        ((z_alpha + z_power) * pooled * F.sqrt(F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))).alias("mde"),
    )


def rank_groups(df: DataFrame, group: str, value: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    """Rank sums and sizes per group plus the tie term, from counted values."""
    keys = list(keys)
    ranks = average_ranks(df, keys, value, bounded=True)
    ties = ranks.groupBy(*keys).agg(
        F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt")).alias("tie_sum"), F.max("n").alias("n")
    )
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("_c"))
    sums = (
        counted.join(ranks.select(*keys, value, "avg_rank"), [*keys, value])
        .groupBy(*keys, group)
        .agg(
            F.sum("_c").alias("n_group"),
            F.sum(F.col("_c") * F.col("avg_rank")).alias("rank_sum"),
            F.sum(F.col("_c") * F.col(value)).alias("_v"),
        )
    )
    return sums.join(ties, keys).withColumn("mean_group", F.col("_v") / F.col("n_group")).drop("_v")


def mann_whitney(df: DataFrame, group: str, a, b, value: str = "value", keys: Sequence[str] = KEYS, p_values: bool = False) -> DataFrame:
    """U of group a, rank-biserial effect, medians and means; normal p with tie and continuity correction."""
    keys = list(keys)
    two = df.filter(F.col(group).isin(a, b))
    g = rank_groups(two, group, value, keys)
    pick = lambda tag, c: F.max(F.when(F.col(group) == F.lit(tag), F.col(c)))
    wide = g.groupBy(*keys).agg(
        pick(a, "n_group").alias("n_a"),
        pick(b, "n_group").alias("n_b"),
        pick(a, "rank_sum").alias("_ra"),
        pick(a, "mean_group").alias("mean_a"),
        pick(b, "mean_group").alias("mean_b"),
        F.max("tie_sum").alias("_ties"),
        F.max("n").alias("_n"),
    )
    med = quantiles(two, [*keys, group], value, {"_m": 0.5}, bounded=True).groupBy(*keys).agg(
        pick(a, "_m").alias("median_a"), pick(b, "_m").alias("median_b")
    )
    na, nb, n = F.col("n_a").cast("double"), F.col("n_b").cast("double"), F.col("_n").cast("double")
    out = wide.join(med, keys).withColumn("u", F.col("_ra") - na * (na + 1) / 2)
    out = out.withColumns(
        {
            "rank_biserial": 2 * F.col("u") / (na * nb) - 1,
            "median_difference": F.col("median_a") - F.col("median_b"),
            "mean_difference": F.col("mean_a") - F.col("mean_b"),
        }
    )
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.try_divide("_ties", n * (n - 1))))
    big = F.greatest(F.col("u"), na * nb - F.col("u"))
    z = F.try_divide(big - na * nb / 2 - 0.5, sd)
    out = out.withColumn("z", z).drop("_ra", "_ties", "_n")
    return out.withColumn("p_value", dist.norm_two_sided(F.greatest(F.col("z"), F.lit(0.0)))) if p_values else out


def kruskal_wallis(df: DataFrame, group: str, value: str = "value", keys: Sequence[str] = KEYS, p_values: bool = False) -> DataFrame:
    """H with tie correction and epsilon squared."""
    keys = list(keys)
    g = rank_groups(df, group, value, keys)
    n = F.col("n").cast("double")
    out = (
        g.groupBy(*keys)
        .agg(
            F.sum(F.pow("rank_sum", F.lit(2)) / F.col("n_group")).alias("_s"),
            F.count(F.lit(1)).alias("n_groups"),
            F.min("n_group").alias("smallest_group"),
            F.max("n").alias("n"),
            F.max("tie_sum").alias("_ties"),
        )
        .withColumn(
            "h",
            F.try_divide(12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1), 1 - F.try_divide("_ties", n * n * n - n)),
        )
    )
    out = out.withColumns(
        {
            "df": F.col("n_groups") - 1,
            "epsilon_squared": F.least(F.greatest(F.try_divide("h", n - 1), F.lit(0.0)), F.lit(1.0)),
        }
    ).drop("_s", "_ties")
    return out.withColumn("p_value", dist.chi2_sf(F.col("h"), F.col("df"))) if p_values else out


def signed_rank(df: DataFrame, mu: float, value: str = "value", keys: Sequence[str] = KEYS, p_values: bool = False) -> DataFrame:
    """Wilcoxon signed rank around mu; zero differences are dropped."""
    keys = list(keys)
    d = df.select(*keys, (F.col(value) - mu).alias("_d")).filter(F.col("_d").isNotNull())
    total = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    nz = d.filter("_d <> 0").select(*keys, F.abs("_d").alias("_a"), (F.col("_d") > 0).alias("_pos"))
    ranks = average_ranks(nz, keys, "_a", bounded=True)
    counted = nz.groupBy(*keys, "_a").agg(F.count_if("_pos").alias("_up"), F.count_if(~F.col("_pos")).alias("_down"))
    agg = (
        counted.join(ranks.select(*keys, "_a", "avg_rank", "cnt"), [*keys, "_a"])
        .groupBy(*keys)
        .agg(
            F.sum(F.col("_up") + F.col("_down")).alias("n_nonzero"),
            F.sum(F.col("_up") * F.col("avg_rank")).alias("w_plus"),
            F.sum(F.col("_down") * F.col("avg_rank")).alias("w_minus"),
            F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt")).alias("_ties"),
        )
    )
    med = quantiles(df, keys, value, {"median": 0.5}, bounded=True)
    n = F.col("n_nonzero").cast("double")
    out = total.join(agg, keys).join(med, keys).withColumns(
        {
            "w": F.least("w_plus", "w_minus"),
            "rank_biserial": (F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus")),
        }
    )
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_ties") / 2) / 24)
    out = out.withColumn("z", F.try_divide(F.col("w") - n * (n + 1) / 4, se)).drop("_ties")
    return out.withColumn("p_value", dist.norm_two_sided(F.col("z"))) if p_values else out


def one_sample_t(df: DataFrame, mu: float, value: str = "value", keys: Sequence[str] = KEYS, p_values: bool = False) -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    se = F.try_divide("sd", F.sqrt("n"))
    out = out.withColumns(
        {
            "t": F.try_divide(F.col("mean") - mu, se),
            "cohen_d": F.try_divide(F.col("mean") - mu, F.col("sd")),
            "mean_difference": F.col("mean") - mu,
        }
    )
    if not p_values:
        return out
    df_ = F.col("n") - 1
    crit = dist.t_ppf(0.975, df_)
    return out.withColumn("_crit", crit).withColumns(
        {
            "p_value": dist.t_two_sided(F.col("t"), df_),
            "ci_low": F.col("mean") - F.col("_crit") * se,
            "ci_high": F.col("mean") + F.col("_crit") * se,
        }
    ).drop("_crit")


def welch(df: DataFrame, flag: str, keys: Sequence[str], value: str, p_values: bool = False) -> DataFrame:
    """Mean difference flag 1 - flag 0 per stratum with Welch's t and degrees of freedom."""
    m = two_group_moments(df, flag, 1, 0, value, keys)
    va, vb = F.try_divide("var_a", "n_a"), F.try_divide("var_b", "n_b")
    se = F.sqrt(va + vb)
    dof = F.try_divide(
        (va + vb) * (va + vb),
        F.try_divide(va * va, F.col("n_a") - 1) + F.try_divide(vb * vb, F.col("n_b") - 1),
    )
    out = m.filter((F.col("n_a") > 1) & (F.col("n_b") > 1)).select(
        *keys,
        F.col("n_a").alias("n_flagged"),
        F.col("n_b").alias("n_unflagged"),
        (F.col("mean_a") - F.col("mean_b")).alias("difference"),
        se.alias("se"),
        dof.alias("dof"),
        F.try_divide(F.col("mean_a") - F.col("mean_b"), se).alias("t"),
    )
    if not p_values:
        return out
    return out.withColumn("_crit", dist.t_ppf(0.975, F.col("dof"))).withColumns(
        {
            "p_value": dist.t_two_sided(F.col("t"), F.col("dof")),
            "ci_low": F.col("difference") - F.col("_crit") * F.col("se"),
            "ci_high": F.col("difference") + F.col("_crit") * F.col("se"),
        }
    ).drop("_crit")


SEASON_TERMS = ("intercept", "trend", "s_spring", "s_summer", "s_autumn")
WEEKEND_TERMS = ("intercept", "trend", "weekend")


def trend_design(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Design columns: intercept, months since the first observed day, its square, season and weekend dummies."""
    first = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min("date").alias("_d0"))
    t = F.datediff("date", "_d0") / 30.0
    s = fn.season("date")
    return df.join(first, list(keys)).withColumns(
        {
            "intercept": F.lit(1.0),
            "trend": t,
            "trend2": t * t,
            "s_spring": (s == "Spring").cast("double"),
            "s_summer": (s == "Summer").cast("double"),
            "s_autumn": (s == "Autumn").cast("double"),
            "weekend": (F.weekday("date") >= 5).cast("double"),
        }
    ).drop("_d0")


def hac_location(df: DataFrame, mu: float, lags: Sequence[int], value: str = "value", keys: Sequence[str] = KEYS, p_values: bool = False) -> DataFrame:
    """Three robust location tests at once: mean against mu, share above mu against one half, signed ranks against 0."""
    keys = list(keys)
    seen = df.filter(F.col(value).isNotNull())
    a = F.abs(F.col(value) - mu)
    base = seen.withColumn("_a", a)
    ranks = average_ranks(base, keys, "_a", bounded=True).select(*keys, "_a", "avg_rank")
    d = F.col(value) - mu
    long = base.join(ranks, [*keys, "_a"]).select(
        *keys,
        "pos",
        F.explode(
            F.array(
                F.struct(F.lit("mean").alias("kind"), F.col(value).alias("y"), F.lit(float(mu)).alias("_null")),
                F.struct(F.lit("share").alias("kind"), (d > 0).cast("double").alias("y"), F.lit(0.5).alias("_null")),
                F.struct(F.lit("signed_rank").alias("kind"), (F.signum(d) * F.col("avg_rank")).alias("y"), F.lit(0.0).alias("_null")),
            )
        ).alias("_s"),
    ).select(*keys, "pos", "_s.*", F.lit(1.0).alias("one"))
    k = [*keys, "kind", "_null"]
    out = hac_rows(hac_fit(long, k, "y", ["one"], "pos", lags, size=None), k, ["one"])
    out = out.select(
        *keys,
        "kind",
        "lag",
        "n",
        F.col("coef").alias("estimate"),
        "se",
        F.try_divide(F.col("coef") - F.col("_null"), F.col("se")).alias("t"),
    )
    if not p_values:
        return out
    dof = F.col("n") - 1
    return out.withColumn("_crit", dist.t_ppf(0.975, dof)).withColumns(
        {
            "p_value": dist.t_two_sided(F.col("t"), dof),
            "ci_low": F.col("estimate") - F.col("_crit") * F.col("se"),
            "ci_high": F.col("estimate") + F.col("_crit") * F.col("se"),
        }
    ).drop("_crit")


def calendar_diagnostics(df: DataFrame, value: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    """Calendar days, observed days and runs of missing days."""
    r = runs(df, list(keys), "pos", F.col(value).isNull(), size=None)
    head = F.col(value).isNull() & (F.col("run_first") == F.col("pos"))
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count(value).alias("n_observed"),
        (F.count_if(F.col(value).isNull()) / F.count(F.lit(1))).alias("missing_share"),
        F.count_if(head).alias("n_missing_runs"),
        F.avg(F.when(head, F.col("run_len"))).alias("mean_missing_run"),
        F.coalesce(F.max(F.when(head, F.col("run_len"))), F.lit(0)).alias("longest_missing_run"),
    )


def interaction_f_test(df: DataFrame, flag: str, stratum: str, value: str, keys: Sequence[str] = KEYS, min_cell: int = 2, p_values: bool = False) -> DataFrame:
    """Full cell-means model against flag + stratum: F with (strata - 1) df, from one cell-level aggregate.

    The additive model has one flag effect, found from the cells in closed form:
    within each stratum the flag contrast is weighted by n1 * n0 / (n1 + n0). Groups with
    a cell of fewer than min_cell values get no test and the status insufficient_data.
    """
    keys = list(keys)
    cells = df.filter(F.col(value).isNotNull() & F.col(flag).isNotNull()).groupBy(*keys, stratum).agg(
        F.count(F.when(F.col(flag) == 1, F.col(value))).alias("n1"),
        F.count(F.when(F.col(flag) == 0, F.col(value))).alias("n0"),
        F.avg(F.when(F.col(flag) == 1, F.col(value))).alias("m1"),
        F.avg(F.when(F.col(flag) == 0, F.col(value))).alias("m0"),
        F.var_pop(F.when(F.col(flag) == 1, F.col(value))).alias("v1"),
        F.var_pop(F.when(F.col(flag) == 0, F.col(value))).alias("v0"),
    )
    w = F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0"))
    d = F.col("m1") - F.col("m0")
    agg = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_strata"),
        F.min(F.least("n1", "n0")).alias("smallest_cell"),
        F.sum(F.col("n1") + F.col("n0")).alias("n"),
        F.sum(F.col("n1") * F.coalesce("v1", F.lit(0.0)) + F.col("n0") * F.coalesce("v0", F.lit(0.0))).alias("sse_full"),
        F.sum(w).alias("_w"),
        F.sum(w * d).alias("_wd"),
        F.sum(w * d * d).alias("_wdd"),
    )
    enough = F.col("smallest_cell") >= min_cell
    out = agg.withColumn("status", F.when(enough, "tested").otherwise("insufficient_data")).withColumns(
        {
            "additive_effect": F.when(enough, F.try_divide("_wd", "_w")),
            "df1": F.col("n_strata") - 1,
            "df2": F.col("n") - 2 * F.col("n_strata"),
        }
    ).withColumn("sse_additive", F.col("sse_full") + F.col("_wdd") - F.try_divide(F.col("_wd") * F.col("_wd"), F.col("_w")))
    out = out.withColumn(
        "f",
        F.when(
            enough,
            F.try_divide(
                F.try_divide(F.col("sse_additive") - F.col("sse_full"), F.col("df1")), F.try_divide("sse_full", "df2")
            ),
        ),
    ).drop("_w", "_wd", "_wdd")
    return out.withColumn("p_value", dist.f_sf(F.col("f"), F.col("df1"), F.col("df2"))) if p_values else out


def stratum_contrasts(df: DataFrame, flag: str, stratum: str, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Flag effect per stratum under the full model, with its pooled standard error, and against the rest pooled."""
    keys = list(keys)
    cell = lambda f: F.when(F.col(flag) == f, F.col(value))
    cells = df.groupBy(*keys, stratum).agg(
        F.count(cell(1)).alias("n1"),
        F.count(cell(0)).alias("n0"),
        F.avg(cell(1)).alias("m1"),
        F.avg(cell(0)).alias("m0"),
        F.var_pop(cell(1)).alias("v1"),
        F.var_pop(cell(0)).alias("v0"),
    )
    tot = cells.groupBy(*keys).agg(
        F.sum(F.col("n1") * F.coalesce("v1", F.lit(0.0)) + F.col("n0") * F.coalesce("v0", F.lit(0.0))).alias("_sse"),
        (F.sum(F.col("n1") + F.col("n0")) - 2 * F.count(F.lit(1))).alias("_df"),
        F.sum("n1").alias("_n1"),
        F.sum("n0").alias("_n0"),
        F.sum(F.col("n1") * F.col("m1")).alias("_s1"),
        F.sum(F.col("n0") * F.col("m0")).alias("_s0"),
    )
    j = cells.join(tot, keys)
    effect = F.col("m1") - F.col("m0")
    rest = F.try_divide(F.col("_s1") - F.col("n1") * F.col("m1"), F.col("_n1") - F.col("n1")) - F.try_divide(
        F.col("_s0") - F.col("n0") * F.col("m0"), F.col("_n0") - F.col("n0")
    )
    return j.select(
        *keys,
        stratum,
        "n1",
        "n0",
        effect.alias("effect"),
        F.sqrt(F.try_divide("_sse", "_df") * (F.try_divide(F.lit(1.0), "n1") + F.try_divide(F.lit(1.0), "n0"))).alias("se"),
        (effect - rest).alias("double_difference"),
    )


def binned_mutual_information(df: DataFrame, flag: str, bins: Sequence[int], value: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    """Mutual information (nats) of a quantile bin and a flag, for several bin counts."""
    out = None
    seen = df.filter(F.col(value).isNotNull() & F.col(flag).isNotNull()).select(*keys, value, flag)
    for b in bins:
        joint = quantile_bins(seen, list(keys), value, b).groupBy(*keys, "bin", flag).agg(F.count(F.lit(1)).alias("c"))
        k = W.partitionBy(*keys)
        pr = joint.select(
            *keys,
            "c",
            F.sum("c").over(k).alias("n"),
            F.sum("c").over(W.partitionBy(*keys, "bin")).alias("cb"),
            F.sum("c").over(W.partitionBy(*keys, flag)).alias("cf"),
        )
        mi = pr.groupBy(*keys).agg(
            F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cb") * F.col("cf")))).alias("mi"),
            F.max("n").alias("n"),
        ).withColumn("bins", F.lit(b).cast("long"))
        out = mi if out is None else out.unionByName(mi)
    return out


def qq_points(df: DataFrame, value: str = "value", keys: Sequence[str] = KEYS, quantile: bool = True) -> DataFrame:
    """Blom plotting positions and standardised sample per distinct value."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    ranked = cumulative_counts(df, keys, value, bounded=True).join(m, keys)
    i = F.col("below") + (F.col("cnt") + 1) / 2.0
    out = ranked.select(
        *keys,
        value,
        "cnt",
        ((i - 0.375) / (F.col("n") + 0.25)).alias("blom"),
        F.try_divide(F.col(value) - F.col("_m"), F.col("_s")).alias("z_sample"),
    )
    return out.withColumn("z_normal", dist.norm_ppf(F.col("blom"))) if quantile else out
