"""Composed statistical tests: primary, supporting and sensitivity results for all stations at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import dist
from ..functions import scalar as fn
from ..operators import linear_core as lin
from ..operators import packed, panel, resample, stats
from ..operators.ranks import quantiles
from ..session import written

KEYS = [S.STATION]
SEASONS = ("Winter", "Spring", "Summer", "Autumn")


def labelled(calendar: DataFrame) -> DataFrame:
    """Daily calendar with the labels the tests need."""
    return calendar.withColumns(
        {"season": fn.season("date"), "weekend": (F.weekday("date") >= 5).cast("int")}
    )


def season_generalisation(days: DataFrame) -> DataFrame:
    """Trend per month (season-adjusted), largest season contrast, and how the two compare."""
    design = stats.trend_design(days)
    fit = lin.ols(design, KEYS, "value", stats.SEASON_TERMS)
    med = quantiles(days, [*KEYS, "season"], "value", {"_m": 0.5}, bounded=True).groupBy(*KEYS).agg(
        (F.max("_m") - F.min("_m")).alias("max_season_contrast"), F.count(F.lit(1)).alias("n_seasons")
    )
    return fit.select(*KEYS, F.col("beta")[1].alias("trend_per_month")).join(med, KEYS).withColumn(
        "trend_to_contrast_ratio",
        F.when(F.col("max_season_contrast") > 0, F.abs(F.col("trend_per_month") * 12) / F.col("max_season_contrast")),
    )


def _status(primary: str, supporting: str, stable: str, alpha: float):
    """Exploratory when the sensitivity settings or the supporting test disagree with the primary one."""
    agree = (F.col(primary) < alpha) == (F.col(supporting) < alpha)
    return F.when(F.col(stable) & agree, "confirmatory").otherwise("exploratory")


def _stable(p: DataFrame, by: str, main: float, alpha: float, name: str = "stable") -> DataFrame:
    """Do all sensitivity settings reach the decision of the main setting?"""
    ref = F.max(F.when(F.col(by) == main, (F.col("p_value") < alpha).cast("int")))
    hits = F.sum((F.col("p_value") < alpha).cast("int"))
    agg = p.groupBy(*KEYS).agg(ref.alias("_ref"), hits.alias("_hits"), F.count(F.lit(1)).alias("_n"))
    return agg.select(*KEYS, F.when(F.col("_ref") == 1, F.col("_hits") == F.col("_n")).otherwise(F.col("_hits") == 0).alias(name))


def season_effect(days: DataFrame, n_boot: int, seed: int, block: int = S.BLOCK_DAYS, blocks: Sequence[int] = S.SENSITIVITY_BLOCKS, lag: int = S.HAC_LAG, alpha: float = S.ALPHA, drawn: DataFrame | None = None) -> DataFrame:
    """Omnibus season test: calendar null bootstrap of H; HAC Wald with trend as the supporting test. Always exploratory.

    `drawn` is a table of replicate statistics by `primary_replicates`, where several tests share one.

    A station with fewer than 3 days of a season stays, without p-values and with the status insufficient_data.
    """
    enough = F.col("smallest_group") >= 3
    kw = stats.kruskal_wallis(days, "season", p_values=True).select(
        *KEYS, F.col("h").alias("statistic"), "n", "epsilon_squared", F.col("p_value").alias("p_independence"), "smallest_group"
    )
    if drawn is None:
        boot = resample.null_test_h(days, "season", len(SEASONS), n_boot, sorted({block, *blocks}), seed)
    else:
        boot = resample.null_p(drawn.withColumn("stat", F.col("season_h")), resample.observed_h(days, "season"), n_boot, KEYS, "greater")
    main = boot.filter(F.col("block") == block).select(*KEYS, F.col("p_value").alias("p_value"))
    stable = _stable(boot, "block", block, alpha)
    design = stats.trend_design(days)
    fit = lin.hac_fit(design, KEYS, "value", stats.SEASON_TERMS, "pos", [lag], size=None)
    wald = lin.joint_wald(fit, stats.SEASON_TERMS, stats.SEASON_TERMS[2:])
    sup = wald.select(*KEYS, dist.f_sf(F.col("f"), F.col("df1"), F.col("df2")).alias("p_supporting"))
    return (
        kw.join(main, KEYS, "left")
        .join(sup, KEYS, "left")
        .join(stable, KEYS, "left")
        .select(
            *KEYS,
            F.lit("season_effect").alias("test"),
            F.lit("H").alias("statistic_name"),
            "statistic",
            F.col("statistic").alias("estimate"),
            F.lit(None).cast("double").alias("ci_low"),
            F.lit(None).cast("double").alias("ci_high"),
            F.lit("epsilon_squared").alias("effect_name"),
            F.col("epsilon_squared").alias("effect"),
            "n",
            *[F.when(enough, F.col(c)).alias(c) for c in ("p_value", "p_supporting", "p_independence", "stable")],
            F.when(enough, "exploratory").otherwise("insufficient_data").alias("status"),
        )
    )


def weekday_effect(days: DataFrame, n_boot: int, seed: int, block: int = S.BLOCK_DAYS, lags: Sequence[int] = S.SENSITIVITY_BLOCKS, lag: int = S.HAC_LAG, alpha: float = S.ALPHA, drawn: DataFrame | None = None) -> DataFrame:
    """Weekend coefficient beside a trend (HAC); calendar null bootstrap of U as the supporting test."""
    design = stats.trend_design(days)
    fit = lin.hac_fit(design, KEYS, "value", stats.WEEKEND_TERMS, "pos", sorted({lag, *lags}), size=None)
    rows = lin.hac_rows(fit, KEYS, stats.WEEKEND_TERMS).filter("term = 'weekend'")
    dof = F.col("n") - F.col("k")
    rows = written(rows.withColumns({"p_value": dist.t_two_sided(F.col("t"), dof), "_crit": dist.t_ppf(0.975, dof)}), "hac_rows")
    main = rows.filter(F.col("lag") == lag)
    mw = stats.mann_whitney(days, "weekend", 0, 1, p_values=True).select(
        *KEYS, F.col("rank_biserial").alias("effect"), F.col("p_value").alias("p_independence")
    )
    if drawn is None:
        boot = resample.null_test_u(days, "weekend", 0, 1, n_boot, [block], seed)
    else:
        boot = resample.null_p(drawn.withColumn("stat", F.col("weekend_u")), resample.observed_u(days, "weekend", 0, 1), n_boot, KEYS)
    boot = boot.select(*KEYS, F.col("p_value").alias("p_supporting"))
    return (
        main.join(mw, KEYS)
        .join(boot, KEYS)
        .join(_stable(rows, "lag", lag, alpha), KEYS)
        .select(
            *KEYS,
            F.lit("weekday_effect").alias("test"),
            F.lit("t (HAC)").alias("statistic_name"),
            F.col("t").alias("statistic"),
            F.col("coef").alias("estimate"),
            (F.col("coef") - F.col("_crit") * F.col("se")).alias("ci_low"),
            (F.col("coef") + F.col("_crit") * F.col("se")).alias("ci_high"),
            F.lit("rank_biserial").alias("effect_name"),
            "effect",
            "n",
            "p_value",
            "p_supporting",
            "p_independence",
            "stable",
            _status("p_value", "p_supporting", "stable", alpha).alias("status"),
        )
    )


def location_effect(days: DataFrame, mu: float, kind: str, test: str, n_boot: int, seed: int, block: int = S.BLOCK_DAYS, lags: Sequence[int] = S.SENSITIVITY_BLOCKS, lag: int = S.HAC_LAG, alpha: float = S.ALPHA, drawn: DataFrame | None = None) -> DataFrame:
    """Mean against mu (HAC t) or median against mu (share above mu, HAC t); null-imposed bootstrap as the supporting test."""
    robust = stats.hac_location(days, mu, sorted({lag, *lags}), p_values=True).filter(
        F.col("kind") == ("mean" if kind == "mean" else "share")
    )
    main = robust.filter(F.col("lag") == lag)
    way = "t" if kind == "mean" else "signed_rank"
    if drawn is None:
        boot = resample.null_imposed_location(days, mu, way, n_boot, [block], seed)
    else:
        boot = resample.null_p(drawn.withColumn("stat", F.col(f"{kind}_{way}")), resample.observed_location(days, mu, way), n_boot, KEYS)
    boot = boot.select(*KEYS, F.col("p_value").alias("p_supporting"))
    if kind == "mean":
        classic = stats.one_sample_t(days, mu, p_values=True).select(
            *KEYS, F.col("cohen_d").alias("effect"), F.col("p_value").alias("p_independence")
        )
        names = ("t (HAC)", "cohen_d")
    else:
        classic = stats.signed_rank(days, mu, p_values=True).select(
            *KEYS, F.col("rank_biserial").alias("effect"), F.col("p_value").alias("p_independence")
        )
        names = ("t (share, HAC)", "r_rb_pairs")
    return (
        main.join(classic, KEYS)
        .join(boot, KEYS)
        .join(_stable(robust, "lag", lag, alpha), KEYS)
        .select(
            *KEYS,
            F.lit(test).alias("test"),
            F.lit(names[0]).alias("statistic_name"),
            F.col("t").alias("statistic"),
            "estimate",
            "ci_low",
            "ci_high",
            F.lit(names[1]).alias("effect_name"),
            "effect",
            "n",
            F.col("p_value"),
            "p_supporting",
            "p_independence",
            "stable",
            _status("p_value", "p_supporting", "stable", alpha).alias("status"),
        )
    )


def primary_replicates(days: DataFrame, n_boot: int, seed: int, block: int = S.BLOCK_DAYS, blocks: Sequence[int] = S.SENSITIVITY_BLOCKS) -> DataFrame:
    """Statistics of the four primary tests of each replicate, from one set of draws: block, b, season_h, weekend_u, median_signed_rank, mean_t.

    The location tests see the same days with the mean or median taken off, so that H0 holds.
    """
    centre = days.groupBy(*KEYS).agg(F.avg("value").alias("_mean"))
    middle = quantiles(days, KEYS, "value", {"_median": 0.5}, bounded=True)
    noise = days.join(centre, KEYS).join(middle, KEYS).withColumns({"_of_mean": F.col("value") - F.col("_mean"), "_of_median": F.col("value") - F.col("_median")})
    statistics = [
        packed.kruskal("season", len(SEASONS), name="season_h"),
        packed.rank_sums("weekend", [(0, 1)], names=["weekend_u"], blocks=[block]),
        packed.signed_ranks("_of_median", "median_signed_rank", blocks=[block]),
        packed.student("_of_mean", "mean_t", blocks=[block]),
    ]
    return packed.replicate_stats(noise, n_boot, sorted({block, *blocks}), seed, statistics, KEYS)


def inference_suite(days: DataFrame, median_limit: float, mean_limit: float, n_boot: int, seed: int, alpha: float = S.ALPHA) -> DataFrame:
    """Four primary tests per station, Holm over the family, decision and evidence labels.

    The calendar (one row per station-day) feeds some thirty sub-plans, and the tests share
    their replicates, so both are written once instead of being derived again.
    """
    days = written(days, "calendar")
    drawn = written(primary_replicates(days, n_boot, seed), "replicates")
    same = {"alpha": alpha, "drawn": drawn}
    tests = (
        season_effect(days, n_boot, seed, **same)
        .unionByName(weekday_effect(days, n_boot, seed, **same))
        .unionByName(location_effect(days, median_limit, "median", "median_location", n_boot, seed, **same))
        .unionByName(location_effect(days, mean_limit, "mean", "mean_location", n_boot, seed, **same))
    )
    out = stats.holm(tests, KEYS, "p_value", "test")
    reject = F.col("holm_p") < alpha
    # Decision and evidence labels.
    return out.withColumns(
        {
            "decision": F.when(F.col("p_value").isNull(), "not_tested").when(reject, "reject_h0_after_holm").otherwise("do_not_reject_h0_after_holm"),
            "evidence": F.when(F.col("p_value").isNull(), "not_tested").when((F.col("status") == "exploratory") & reject, "exploratory_signal")
            .when(F.col("status") == "exploratory", "no_exploratory_signal")
            .when(reject, "confirmatory_evidence")
            .otherwise("no_confirmatory_evidence"),
        }
    )


def posthoc_pairs(days: DataFrame, n_boot: int, n_ci: int, seed: int, block: int = S.BLOCK_DAYS) -> DataFrame:
    """All season pairs: rank-biserial null bootstrap restricted to the pair, contrast interval, Holm within the station."""
    pairs = [(a, b) for i, a in enumerate(SEASONS) for b in SEASONS[i + 1 :]]
    cells = F.array(*[F.struct(F.lit(a).alias("season_a"), F.lit(b).alias("season_b")) for a, b in pairs])

    def by_pair(df: DataFrame, columns) -> DataFrame:
        mine = F.filter(cells, lambda p: (p["season_a"] == F.col("season")) | (p["season_b"] == F.col("season")))
        return (
            df.withColumn("_p", F.explode(mine))
            .select(*columns, "_p.*")
            .withColumn("side", (F.col("season") == F.col("season_b")).cast("int"))
        )

    keyed = by_pair(days, days.columns)
    k = [*KEYS, "season_a", "season_b"]
    mw = stats.mann_whitney(keyed, "side", 0, 1, keys=k, p_values=True)
    observed = mw.select(*k, F.col("rank_biserial").alias("observed"))
    names = [f"_pair{i}" for i in range(len(pairs))]
    own = packed.rank_sums("season", pairs, biserial=True, names=names)
    reps = packed.replicate_stats(days, n_boot, [block], seed, [own], KEYS)
    each = F.array(*[F.struct(F.lit(a).alias("season_a"), F.lit(b).alias("season_b"), F.col(c).alias("stat")) for (a, b), c in zip(pairs, names)])
    boot = resample.null_p(reps.select(*KEYS, "block", F.explode(each).alias("_p")).select(*KEYS, "block", "_p.*"), observed, n_boot, k)
    ci = resample.contrast_ci(days, "season", pairs, "median", block, n_ci, seed).select(
        *KEYS, F.col("group_a").alias("season_a"), F.col("group_b").alias("season_b"), "point", "ci_low", "ci_high", "ci_method"
    )
    out = (
        mw.select(*k, "n_a", "n_b", "u", "rank_biserial", F.col("p_value").alias("p_independence"))
        .join(boot.select(*k, "p_value"), k)
        .join(ci, k)
        .withColumn("pair", F.concat_ws(" - ", "season_a", "season_b"))
    )
    return stats.holm(out, KEYS, "p_value", "pair").drop("season_a", "season_b")


def weekly_frames(days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weekly calendar and weekly differences with dense week positions."""
    def dense(w: DataFrame, value: str, *extra: str) -> DataFrame:
        first = w.groupBy(*KEYS).agg(F.min("week_start").alias("_w0"))
        return w.join(first, KEYS).select(
            *KEYS, (F.datediff("week_start", "_w0") / 7).cast("long").alias("pos"), F.col(value).alias("value"), *extra
        )

    return (
        dense(panel.weekly_calendar(days), "week_mean", "season"),
        dense(panel.weekly_difference(days), "difference"),
    )


def paired_weekly(days: DataFrame, n_boot: int, n_ci: int, seed: int, block_weeks: int = 4) -> DataFrame:
    """Signed-rank test of weekly weekday-weekend differences; noise centred at the median, positive rank sums compared."""
    _, diff = weekly_frames(days)
    test = resample.null_imposed_location(diff, 0.0, "signed_rank", n_boot, [block_weeks], seed)
    sr = stats.signed_rank(diff, 0.0, p_values=True).select(
        *KEYS, "n", "w_plus", "rank_biserial", "median", F.col("p_value").alias("p_independence")
    )
    share = diff.groupBy(*KEYS).agg(
        F.avg("value").alias("mean_difference"),
        (F.count_if(F.col("value") > 0) / F.count("value")).alias("share_weekday_higher"),
    )
    ci = resample.calendar_ci(diff, "median", n_ci, [block_weeks], seed).select(*KEYS, "ci_low", "ci_high")
    return sr.join(share, KEYS).join(test.select(*KEYS, "p_value", "n_ge", "n_le"), KEYS).join(ci, KEYS)


def weekly_season(days: DataFrame, n_boot: int, seed: int, block_weeks: int = 4) -> DataFrame:
    """Season test on ISO-week means with four-week blocks."""
    weeks, _ = weekly_frames(days)
    test = resample.null_test_h(weeks, "season", len(SEASONS), n_boot, [block_weeks], seed)
    kw = stats.kruskal_wallis(weeks, "season", p_values=True).select(
        *KEYS, "n", "h", "epsilon_squared", F.col("p_value").alias("p_independence")
    )
    return kw.join(test.select(*KEYS, "p_value", "n_replicates", "n_ge"), KEYS)


def inference_sensitivity(hourly: DataFrame, min_hours: Sequence[int], blocks: Sequence[int], n_boot: int, seed: int, value: str = S.TARGET) -> DataFrame:
    """Median of daily means under several completeness rules and block lengths, in one job."""
    daily = panel.daily_values(hourly, value, median=False)
    settings = daily.withColumn("min_hours", F.explode(F.array(*[F.lit(h).cast("long") for h in min_hours])))
    gated = settings.select(
        S.STATION,
        "min_hours",
        "date",
        F.when(F.col("valid_hours") >= F.col("min_hours"), F.col("mean_value")).alias("value"),
    )
    keys = [S.STATION, "min_hours"]
    dense = panel.dense_days(gated, ["value"], keys)
    return resample.calendar_ci(dense, "median", n_boot, blocks, seed, keys=keys)


def yearly_sensitivity(days: DataFrame, n_boot: int, block: int, seed: int, min_days: int = 30) -> DataFrame:
    """The same interval per calendar year with enough observed days."""
    keyed = days.withColumn("year", F.year("date").cast("long"))
    enough = keyed.groupBy(*KEYS, "year").agg(F.count("value").alias("_n"), F.min("pos").alias("_p0")).filter(
        F.col("_n") >= min_days
    )
    k = [*KEYS, "year"]
    cal = keyed.join(enough, k).select(*k, (F.col("pos") - F.col("_p0")).alias("pos"), "value")
    return resample.calendar_ci(cal, "median", n_boot, [block], seed, keys=k)


def without_partial_winters(days: DataFrame, full_share: float = 0.9) -> DataFrame:
    """Blank the days of winters whose coverage is below the share; the calendar keeps its length."""
    cohorts = panel.season_cohorts(days, full_share=full_share).filter("season = 'Winter' and cohort = 'partial'").select(
        *KEYS, F.col("season_year").alias("_wy")
    )
    tagged = days.withColumn("_wy", fn.winter_year("date").cast("long"))
    part = cohorts.withColumn("_partial", F.lit(True))
    return tagged.join(part, [*KEYS, "_wy"], "left").withColumn(
        "value", F.when(F.col("_partial").isNull(), F.col("value"))
    ).drop("_wy", "_partial")


def inference_recheck(reported: DataFrame, days: DataFrame, n_boot: int, blocks: Sequence[int], seed: int, z: float = 5.0) -> DataFrame:
    """Reported bootstrap means of observed days (as `compact_mean_report` has them) checked by two other paths.

    Relational: the same replicates from prefix sums joined by block start; interval,
    spread and number must be the same (to 1e-9 of their size). Closed form: the estimate
    must be the expected mean, and the spread within z standard errors of the exact one.
    A reported or a recomputed row without its counterpart fails.
    """
    dense = written(resample.compact_calendar(days), "dense")
    k = [S.STATION, "block"]
    again = resample.percentile_ci(resample.mean_by_prefix_sums(dense, n_boot, blocks, seed), k).select(
        *k, *[F.col(c).cast("double").alias(f"_{c}") for c in ("n_replicates", "ci_low", "ci_high", "replicate_sd")]
    )
    exact = resample.closed_form_mean(dense, blocks)
    both = reported.join(again, k, "full_outer").join(exact, k, "full_outer")
    same = lambda c: F.greatest(F.lit(1.0), F.abs(F.col(c))) * 1e-9
    checks = [(f"relational: {c}", c, f"_{c}", same(f"_{c}")) for c in ("n_replicates", "ci_low", "ci_high", "replicate_sd")]
    checks += [("closed form: mean", "point", "expected", same("expected")), ("closed form: spread", "replicate_sd", "sd", z * F.col("sd") / F.sqrt(F.lit(2.0 * n_boot)) + 1e-9)]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("check"), F.col(a).cast("double").alias("reported"), F.col(b).alias("recomputed"), tol.alias("tolerance"))
            for name, a, b, tol in checks
        ]
    )
    out = both.select(*k, F.explode(rows).alias("_r")).select(*k, "_r.*")
    return out.withColumn("passed", F.coalesce(F.abs(F.col("reported") - F.col("recomputed")) <= F.col("tolerance"), F.lit(False)))
