"""Trailing-window labels and features, evaluated in chunks with a halo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from .ranks import cumulative_counts
from .sequence import CHUNK, CHUNK_ID, hour_number, windowed, with_halo


def _hourly(df: DataFrame, columns, back: int, size: int) -> DataFrame:
    return windowed(
        df.withColumn("_hour", hour_number(S.TIME)), [S.STATION], "_hour", columns, back=back, size=size
    ).drop("_hour")


def _label(n: Column, mean: Column, need: int, threshold: float) -> Column:
    return F.when(n >= need, (mean >= threshold).cast("int"))


def alert_label(
    df: DataFrame,
    value: str = S.TARGET,
    window: int = S.ALERT_WINDOW,
    min_periods: int = S.ALERT_MIN_PERIODS,
    threshold: float = S.ALERT_THRESHOLD,
    size: int = CHUNK,
) -> DataFrame:
    """Three-valued alert: trailing mean including the current hour; NULL where the window is short.

    The frame is by hour, so a missing row and a NULL value both count as a
    missing hour and the result does not depend on the table being dense.
    """
    frame = lambda w: w.rangeBetween(-(window - 1), 0)
    out = _hourly(
        df,
        {
            "window_n": lambda w: F.count(value).over(frame(w)),
            "window_mean": lambda w: F.avg(value).over(frame(w)),
        },
        window - 1,
        size,
    )
    return out.withColumn(
        "alert", _label(F.col("window_n"), F.round("window_mean", 9), min_periods, threshold)
    )


def rolling_means(df: DataFrame, value: str = S.TARGET, windows=None, size: int = CHUNK) -> DataFrame:
    """Left-open, right-closed trailing means over hours, each with its own minimum count."""
    windows = windows or S.ROLLING_WINDOWS
    cols = {}
    for hours, need in windows.items():
        frame = lambda w, h=hours: w.rangeBetween(-(h - 1), 0)
        cols[f"rolling_{hours}h"] = lambda w, f=frame, k=need: F.when(
            F.count(value).over(f(w)) >= k, F.avg(value).over(f(w))
        )
    return _hourly(df, cols, max(windows) - 1, size)


def rolling_means_exact(
    df: DataFrame, hours: int, need: int, value: str = S.TARGET, size_hours: int = 0
) -> DataFrame:
    """Trailing mean over (t - hours, t] for readings at any instant, to the microsecond.

    Each reading enters the sum at its own time and leaves it `hours` later, so a
    running sum of both events is the window sum: the cost does not depend on how
    many readings a window holds. Sums restart in every chunk (from its halo),
    which keeps rounding errors at the size of one chunk. A chunk is as long as the
    window unless size_hours is longer, so a station is cut by time, however dense.
    """
    hour = 3_600_000_000
    span, chunk = hours * hour, max(size_hours, hours) * hour
    v = F.col(value)
    haloed = with_halo(df.withColumn("_us", F.unix_micros(S.TIME)), "_us", span, 0, chunk)
    seen = v.isNotNull().cast("int")
    amount = F.coalesce(v, F.lit(0.0))
    events = F.array(
        F.struct(F.col("_us").alias("_at"), amount.alias("_v"), seen.alias("_c"), F.lit(True).alias("_enters")),
        F.struct((F.col("_us") + span).alias("_at"), (-amount).alias("_v"), (-seen).alias("_c"), F.lit(False).alias("_enters")),
    )
    flow = haloed.withColumn("_e", F.explode(events)).select(*df.columns, CHUNK_ID, "_home", "_e.*")
    upto = W.partitionBy(S.STATION, CHUNK_ID).orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    sums = flow.withColumns({"_n": F.sum("_c").over(upto), "_t": F.sum("_v").over(upto)})
    return sums.filter("_home and _enters").select(
        *df.columns, F.when(F.col("_n") >= need, F.col("_t") / F.col("_n")).alias(f"rolling_{hours}h")
    )


def past_features(
    df: DataFrame, value: str = S.TARGET, window: int = 24, min_periods: int = 24, size: int = CHUNK
) -> DataFrame:
    """Mean and sd of the hours strictly before t, and the value exactly `window` hours ago."""
    past = lambda w: w.rangeBetween(-window, -1)
    n = lambda w: F.count(value).over(past(w))
    return _hourly(
        df,
        {
            "past_n": n,
            "past_mean": lambda w: F.when(n(w) >= min_periods, F.avg(value).over(past(w))),
            "past_sd": lambda w: F.when(n(w) >= min_periods, F.stddev_samp(value).over(past(w))),
            f"lag_{window}h": lambda w: F.max(value).over(w.rangeBetween(-window, -window)),
        },
        window,
        size,
    )


def label_sensitivity(df: DataFrame, configs: Sequence[tuple[int, int, float]], partition: str | None = None, value: str = S.TARGET) -> DataFrame:
    """Positives and prevalence for many (window, min_periods, threshold) settings in one job.

    With a partition column the windows restart inside each part, which shows
    what rolling after splitting would lose.
    """
    cols = {}
    for w_, need, thr in configs:
        frame = lambda w, h=w_: w.rangeBetween(-(h - 1), 0)
        cols[f"_y_{w_}_{need}_{int(thr)}"] = lambda w, f=frame, k=need, t=thr: F.when(
            F.count(value).over(f(w)) >= k, (F.round(F.avg(value).over(f(w)), 9) >= t).cast("int")
        )
    keys = [S.STATION] + ([partition] if partition else [])
    out = windowed(
        df.withColumn("_hour", hour_number(S.TIME)),
        keys,
        "_hour",
        cols,
        back=max(c[0] for c in configs) - 1,
    )
    cells = [
        F.struct(
            F.lit(w_).cast("long").alias("window"),
            F.lit(need).cast("long").alias("min_periods"),
            F.lit(float(thr)).alias("threshold"),
            F.col(f"_y_{w_}_{need}_{int(thr)}").alias("y"),
        )
        for w_, need, thr in configs
    ]
    long = out.select(S.STATION, F.explode(F.array(*cells)).alias("_r")).select(S.STATION, "_r.*")
    return long.groupBy(S.STATION, "window", "min_periods", "threshold").agg(
        F.count("y").alias("n_labelled"),
        F.coalesce(F.sum("y"), F.lit(0)).alias("n_positive"),
        F.try_divide(100.0 * F.sum("y"), F.count("y")).alias("prevalence_pct"),
    )


def avg_rank_rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average rank of every distinct value with its multiplicity."""
    return cumulative_counts(df, keys, value).withColumn("avg_rank", F.col("below") + (F.col("cnt") + 1) / 2.0)
