"""Completeness-gated daily and weekly panels, calendars and compliance tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from .ranks import quantiles


def dense_days(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (S.STATION,)) -> DataFrame:
    """Every calendar day between a station's first and last day; pos counts days from the first."""
    spans = df.groupBy(*keys).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    days = spans.select(
        *keys, "_lo", F.explode(F.expr("sequence(_lo, _hi, interval 1 day)")).alias("date")
    )
    return days.join(df.select(*keys, "date", *columns), [*keys, "date"], "left").select(
        *keys, "date", *columns, F.datediff("date", "_lo").cast("long").alias("pos")
    )


def daily_values(
    df: DataFrame, value: str = S.TARGET, keys: Sequence[str] = (S.STATION,), median: bool = True
) -> DataFrame:
    """Valid hours, mean and median per station and local day.

    The table is unique per station and hour, so a group holds at most 24 rows
    and the built-in exact median is safe.
    """
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("valid_hours"),
        F.avg(value).alias("mean_value"),
    ]
    if median:
        aggs.append(F.median(value).alias("median_value"))
    return df.groupBy(*keys, F.col(S.TIME).cast("date").alias("date")).agg(*aggs)


def with_day_labels(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(
        {
            "season": fn.season(date),
            "dow": F.weekday(date).cast("long"),
            "is_weekend": (F.weekday(date) >= 5).cast("long"),
            "iso_week": fn.iso_week_key(date),
        }
    )


def daily_panel(df: DataFrame, min_hours: int = S.MIN_DAY_HOURS, value: str = S.TARGET) -> DataFrame:
    """Only days with enough valid hours; stations stay apart."""
    days = daily_values(df, value).filter(F.col("valid_hours") >= min_hours)
    return with_day_labels(days)


def daily_panel_audit(df: DataFrame, min_hours: int = S.MIN_DAY_HOURS, value: str = S.TARGET) -> DataFrame:
    """How the panel came about: every calendar day falls into exactly one class."""
    days = dense_days(
        daily_values(df, value, median=False), ["n_rows", "valid_hours"]
    ).withColumn("valid_hours", F.coalesce("valid_hours", F.lit(0)))
    kept = F.col("valid_hours") >= min_hours
    weekend = F.weekday("date") >= 5
    return days.groupBy(S.STATION).agg(
        F.sum(F.coalesce("n_rows", F.lit(0))).alias("n_rows"),
        F.sum("valid_hours").alias("n_valid_hours"),
        F.count(F.lit(1)).alias("span_days"),
        F.count_if(F.col("valid_hours") > 0).alias("days_any"),
        F.count_if(F.col("valid_hours") == 0).alias("days_none"),
        F.count_if(F.col("valid_hours") == 24).alias("days_full"),
        F.count_if(kept).alias("days_kept"),
        F.count_if(~kept & (F.col("valid_hours") > 0)).alias("days_dropped"),
        F.count_if(kept & weekend).alias("kept_weekend"),
        *[F.count_if(kept & (fn.season("date") == s)).alias(f"kept_{s.lower()}") for s in ("Winter", "Spring", "Summer", "Autumn")],
    )


def dropped_days(df: DataFrame, min_hours: int = S.MIN_DAY_HOURS, value: str = S.TARGET) -> DataFrame:
    """The dropped dates themselves, one row each."""
    return daily_values(df, value, median=False).filter(
        (F.col("valid_hours") > 0) & (F.col("valid_hours") < min_hours)
    ).select(S.STATION, "date", "valid_hours")


def daily_calendar(
    df: DataFrame, min_hours: int = S.MIN_DAY_HOURS, value: str = S.TARGET, statistic: str = "mean"
) -> DataFrame:
    """Every day; the value is NULL where the day is incomplete. The axis of all resampling."""
    days = daily_values(df, value, median=statistic == "median")
    gated = days.select(
        S.STATION,
        "date",
        "valid_hours",
        F.when(F.col("valid_hours") >= min_hours, F.col(f"{statistic}_value")).alias("value"),
    )
    dense = dense_days(gated, ["valid_hours", "value"])
    return with_day_labels(dense.withColumn("valid_hours", F.coalesce("valid_hours", F.lit(0))))


def weekly_calendar(days: DataFrame, value: str = "value") -> DataFrame:
    """One row per ISO week of a daily calendar: mean of observed days, count, start, first season."""
    return days.groupBy(S.STATION, fn.iso_week_key("date").alias("iso_week")).agg(
        F.min(F.date_sub("date", F.weekday("date"))).alias("week_start"),
        F.avg(value).alias("week_mean"),
        F.count(value).alias("observed_days"),
        F.min_by(fn.season("date"), "date").alias("season"),
    )


def weekly_difference(
    days: DataFrame, value: str = "value", min_weekdays: int = S.MIN_WEEKDAYS, min_weekend: int = S.MIN_WEEKEND_DAYS
) -> DataFrame:
    """Weekday mean minus weekend mean per ISO week, where both sides have enough days."""
    weekend = F.weekday("date") >= 5
    v = F.col(value)
    week = days.groupBy(S.STATION, fn.iso_week_key("date").alias("iso_week")).agg(
        F.min(F.date_sub("date", F.weekday("date"))).alias("week_start"),
        F.count(F.when(~weekend, v)).alias("n_weekdays"),
        F.count(F.when(weekend, v)).alias("n_weekend"),
        F.avg(F.when(~weekend, v)).alias("_wd"),
        F.avg(F.when(weekend, v)).alias("_we"),
    )
    enough = (F.col("n_weekdays") >= min_weekdays) & (F.col("n_weekend") >= min_weekend)
    return week.withColumn("difference", F.when(enough, F.col("_wd") - F.col("_we"))).drop("_wd", "_we")


def day_status(df: DataFrame, min_hours: int = S.MIN_DAY_HOURS, value: str = S.TARGET) -> DataFrame:
    """Dense day table with valid / incomplete_obs / no_obs and the boundary-day flag."""
    days = dense_days(
        daily_values(df, value, median=False), ["n_rows", "valid_hours", "mean_value"]
    ).withColumns(
        {"n_rows": F.coalesce("n_rows", F.lit(0)), "valid_hours": F.coalesce("valid_hours", F.lit(0))}
    )
    last = days.groupBy(S.STATION).agg(F.max("pos").alias("_last"))
    valid = F.col("valid_hours") >= min_hours
    return days.join(last, S.STATION).select(
        S.STATION,
        "date",
        "n_rows",
        "valid_hours",
        F.when(valid, "valid").when(F.col("valid_hours") == 0, "no_obs").otherwise("incomplete_obs").alias("day_status"),
        (((F.col("pos") == 0) | (F.col("pos") == F.col("_last"))) & (F.col("n_rows") < 24)).alias("is_boundary_day"),
        F.when(valid, F.col("mean_value")).alias("daily_mean"),
    )


def tier_counts(value: Column) -> list[Column]:
    """One conditional count per regulatory tier."""
    t = fn.tier(value)
    return [F.count_if(t == label).alias(f"tier_{i}") for i, label in enumerate(S.TIER_LABELS)]


def daily_compliance(df: DataFrame, min_hours: int = S.MIN_DAY_HOURS, value: str = S.TARGET) -> DataFrame:
    """Per station: day classes, tier counts, limits and the annual-sufficiency verdict."""
    days = day_status(df, min_hours, value)
    m = F.col("daily_mean")
    year = F.year("date")
    per_year = days.groupBy(S.STATION, year.alias("_y")).agg(F.count(m).alias("_valid"))
    years = per_year.groupBy(S.STATION).agg(
        F.count(F.lit(1)).alias("n_years"), F.max("_valid").alias("max_valid_days_in_year")
    )
    q = quantiles(days, [S.STATION], "daily_mean", {"p99_daily": 0.99, "median_daily": 0.5})
    base = days.groupBy(S.STATION).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count(m).alias("n_valid_days"),
        F.count_if(F.col("day_status") == "no_obs").alias("n_no_obs"),
        F.count_if(F.col("day_status") == "incomplete_obs").alias("n_incomplete"),
        F.count_if("is_boundary_day").alias("n_boundary_partial"),
        *tier_counts(m),
        F.count_if(m >= 50).alias("n_ge_50"),
        F.count_if(m < 15).alias("n_lt_15"),
        F.count_if(m >= 15).alias("n_ge_15"),
        F.count_if(m > 15).alias("n_gt_15"),
        F.max(m).alias("max_daily"),
        F.avg(m).alias("mean_daily"),
    )
    out = base.join(years, S.STATION).join(q, S.STATION, "left")
    for i in range(len(S.TIER_LABELS)):
        out = out.withColumn(f"tier_{i}_pct_valid", F.try_divide(100.0 * F.col(f"tier_{i}"), F.col("n_valid_days")))
        out = out.withColumn(f"tier_{i}_pct_all", 100.0 * F.col(f"tier_{i}") / F.col("n_days"))
    excluded = F.col("n_days") - F.col("n_valid_days")
    return out.withColumn(
        "sufficient_for_annual",
        (F.col("max_valid_days_in_year") >= S.ANNUAL_MIN_DAYS)
        & (F.col("n_years") == 1)
        & (excluded <= 365 - S.ANNUAL_MIN_DAYS),
    )


def wilson_interval(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = hits / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def season_cohorts(days: DataFrame, value: str = "value", full_share: float = 0.9) -> DataFrame:
    """Per station and season-year: calendar days of the whole season, observed days, coverage, cohort."""
    sy = fn.season_year("date")
    s = fn.season("date")
    start_month = F.when(s == "Winter", 12).when(s == "Spring", 3).when(s == "Summer", 6).otherwise(9)
    start = F.make_date(sy - F.when(s == "Winter", 1).otherwise(0), start_month, F.lit(1))
    seen = days.groupBy(
        S.STATION, s.alias("season"), sy.cast("long").alias("season_year"), start.alias("_start")
    ).agg(F.count(value).alias("observed_days"), F.count(F.lit(1)).alias("days_in_span"))
    total = F.datediff(F.add_months("_start", 3), F.col("_start"))
    return seen.withColumns(
        {
            "calendar_days": total.cast("long"),
            "coverage": F.col("observed_days") / total,
            "cohort": F.when(F.col("observed_days") / total >= full_share, "full").otherwise("partial"),
        }
    ).drop("_start")


def repeated_seasons(cohorts: DataFrame) -> DataFrame:
    """Seasons observed in at least two years, per station."""
    return (
        cohorts.filter("observed_days > 0")
        .groupBy(S.STATION, "season")
        .agg(F.count(F.lit(1)).alias("n_years"))
        .filter("n_years >= 2")
    )


def multi_year_summary(df: DataFrame, min_hours: int = S.MIN_DAY_HOURS, value: str = S.TARGET) -> DataFrame:
    """Station x year x season: hourly moments and quantiles beside daily exceedances."""
    keyed = df.select(
        S.STATION,
        F.year(S.TIME).cast("long").alias("year"),
        fn.season(S.TIME).alias("season"),
        F.col(S.TIME),
        F.col(value).alias("_v"),
    )
    keys = [S.STATION, "year", "season"]
    hours = keyed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_hours"),
        F.count_if(F.col("_v").isNull()).alias("n_missing"),
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("sd"),
    )
    q = quantiles(keyed, keys, "_v", {"median": 0.5, "q25": 0.25, "q75": 0.75, "p90": 0.9, "p95": 0.95})
    days = (
        daily_values(keyed.withColumnRenamed("_v", value), value, keys, median=False)
        .filter(F.col("valid_hours") >= min_hours)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("valid_days"),
            F.count_if(F.col("mean_value") > 50).alias("days_gt_50"),
            F.count_if(F.col("mean_value") > 15).alias("days_gt_15"),
        )
    )
    out = hours.join(q, keys, "left").join(days, keys, "left")
    for c in ("valid_days", "days_gt_50", "days_gt_15"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    return out.withColumns(
        {
            "iqr": F.col("q75") - F.col("q25"),
            "pct_gt_50": F.try_divide(100.0 * F.col("days_gt_50"), F.col("valid_days")),
            "pct_gt_15": F.try_divide(100.0 * F.col("days_gt_15"), F.col("valid_days")),
        }
    ).drop("q25", "q75")
