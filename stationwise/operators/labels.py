"""Label coverage, prevalence and split-date tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from .ranks import quantiles
from .sequence import CHUNK, hour_number, windowed

MEASURES = ("grid_hours", "valid_hours", "missing_hours", "labelled", "evaluable", "positives", "positives_evaluable")


def labelled_grid(
    df: DataFrame,
    cut: str,
    value: str = S.TARGET,
    window: int = S.ALERT_WINDOW,
    min_periods: int = S.ALERT_MIN_PERIODS,
    threshold: float = S.ALERT_THRESHOLD,
    size: int = CHUNK,
) -> DataFrame:
    """Alert label, availability of past features and split, all from one windowed pass."""
    now = lambda w: w.rangeBetween(-(window - 1), 0)
    past = lambda w: w.rangeBetween(-window, -1)
    out = windowed(
        df.select(S.STATION, S.TIME, value, hour_number(S.TIME).alias("_hour")),
        [S.STATION],
        "_hour",
        {
            "_n": lambda w: F.count(value).over(now(w)),
            "_m": lambda w: F.avg(value).over(now(w)),
            "_p": lambda w: F.count(value).over(past(w)),
        },
        back=window,
        size=size,
    )
    return out.select(
        S.STATION,
        S.TIME,
        value,
        F.when(F.col("_n") >= min_periods, (F.round("_m", 9) >= threshold).cast("int")).alias("alert"),
        (F.col("_p") >= min_periods).alias("has_past"),
        F.when(F.col(S.TIME) < F.lit(cut).cast("timestamp"), "train").otherwise("test").alias("split"),
    )


def _sums(value: str = S.TARGET):
    y, evaluable = F.col("alert"), F.col("alert").isNotNull() & F.col("has_past")
    return [
        F.count(F.lit(1)).alias("grid_hours"),
        F.count(value).alias("valid_hours"),
        F.count_if(F.col(value).isNull()).alias("missing_hours"),
        F.count(y).alias("labelled"),
        F.count_if(evaluable).alias("evaluable"),
        F.count_if(y == 1).alias("positives"),
        F.count_if((y == 1) & F.col("has_past")).alias("positives_evaluable"),
    ]


def coverage_by_stratum(df: DataFrame) -> DataFrame:
    """Counts and rates by station x {year, season, month} x split."""
    strata = F.array(
        F.struct(F.lit("year").alias("kind"), F.year(S.TIME).cast("string").alias("stratum")),
        F.struct(F.lit("season").alias("kind"), fn.season(S.TIME).alias("stratum")),
        F.struct(F.lit("month").alias("kind"), F.date_format(S.TIME, "yyyy-MM").alias("stratum")),
    )
    long = df.select("*", F.explode(strata).alias("_s")).select(*df.columns, "_s.*")
    out = long.groupBy(S.STATION, "kind", "stratum", "split").agg(*_sums())
    pct = lambda a, b: F.try_divide(100.0 * F.col(a), F.col(b))
    return out.withColumns(
        {
            "valid_pct": pct("valid_hours", "grid_hours"),
            "labelled_pct": pct("labelled", "grid_hours"),
            "evaluable_pct": pct("evaluable", "grid_hours"),
            "positive_pct_labelled": pct("positives", "labelled"),
            "positive_pct_evaluable": pct("positives_evaluable", "evaluable"),
        }
    )


def conservation(strata: DataFrame, df: DataFrame) -> DataFrame:
    """Every stratification must add up to the ungrouped totals, split by split."""
    a = strata.groupBy("kind", "split").agg(*[F.sum(m).alias(m) for m in MEASURES])
    b = df.groupBy("split").agg(*_sums())
    la = a.unpivot(["kind", "split"], list(MEASURES), "measure", "total_strata")
    lb = b.unpivot(["split"], list(MEASURES), "measure", "total_rows")
    return la.join(lb, ["split", "measure"], "full_outer").withColumn(
        "conserved", F.col("total_strata").eqNullSafe(F.col("total_rows"))
    )


def population_funnel(df: DataFrame, value: str = S.TARGET) -> DataFrame:
    """All rows, observed, labelled, evaluable; with positives, by station and split."""
    y, obs = F.col("alert"), F.col(value).isNotNull()
    stages = {
        "all": F.lit(True),
        "observed": obs,
        "labelled": y.isNotNull(),
        "evaluable": y.isNotNull() & F.col("has_past"),
    }
    wide = df.groupBy(S.STATION, "split").agg(
        *[F.count_if(c).alias(f"n_{s}") for s, c in stages.items()],
        *[F.count_if(c & (y == 1)).alias(f"p_{s}") for s, c in stages.items()],
    )
    cells = F.array(
        *[
            F.struct(F.lit(s).alias("stage"), F.col(f"n_{s}").alias("n"), F.col(f"p_{s}").alias("positives"))
            for s in stages
        ]
    )
    return wide.select(S.STATION, "split", F.explode(cells).alias("_r")).select(S.STATION, "split", "_r.*")


def label_prevalence(df: DataFrame, value: str = S.TARGET, severe: float = 100.0) -> DataFrame:
    """Severe hours and alerts by split, each against all rows and against its own denominator."""
    out = df.groupBy(S.STATION, "split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n_observed"),
        F.count_if(F.col(value) > severe).alias("n_severe"),
        F.count("alert").alias("n_labelled"),
        F.count_if(F.col("alert") == 1).alias("n_alert"),
    )
    pct = lambda a, b: F.try_divide(100.0 * F.col(a), F.col(b))
    return out.withColumns(
        {
            "severe_pct_rows": pct("n_severe", "n_rows"),
            "severe_pct_observed": pct("n_severe", "n_observed"),
            "alert_pct_rows": pct("n_alert", "n_rows"),
            "alert_pct_labelled": pct("n_alert", "n_labelled"),
        }
    )


def month_exceedance(df: DataFrame, value: str = S.TARGET) -> DataFrame:
    return df.groupBy(S.STATION, F.date_format(S.TIME, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n_observed"),
        F.count_if(F.col(value) > 50).alias("hours_gt_50"),
        F.count_if(F.col(value) > 100).alias("hours_gt_100"),
        F.avg(value).alias("mean"),
    )


def split_candidates(df: DataFrame, cuts: Sequence[str], value: str = S.TARGET, severe: float = 100.0) -> DataFrame:
    """Shares, severe hours and p90 on both sides of each candidate cut date."""
    long = df.select(
        S.STATION, S.TIME, value, F.explode(F.array(*[F.lit(c).cast("timestamp") for c in cuts])).alias("cut")
    ).withColumn("_side", F.when(F.col(S.TIME) < F.col("cut"), "train").otherwise("test"))
    keys = [S.STATION, "cut"]
    train = F.col("_side") == "train"
    counts = long.groupBy(*keys).agg(
        F.count_if(train).alias("n_train"),
        F.count_if(~train).alias("n_test"),
        (F.count_if(train) / F.count(F.lit(1))).alias("train_share"),
        F.count_if(train & (F.col(value) > severe)).alias("severe_train"),
        F.count_if(~train & (F.col(value) > severe)).alias("severe_test"),
    )
    q = quantiles(long, [*keys, "_side"], value, {"_p90": 0.9}).groupBy(*keys).agg(
        F.max(F.when(train, F.col("_p90"))).alias("p90_train"), F.max(F.when(~train, F.col("_p90"))).alias("p90_test")
    )
    return counts.join(q, keys, "left")
