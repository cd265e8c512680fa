"""Chronological splits, train-only preprocessing and leakage-safe model frames."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

from .clean import unpivoted
from .joins import value_at_offset
from .quality import verdicts
from .ranks import cumulative_counts, quantiles
from .sequence import CHUNK, hour_number, running, windowed

# Columns that must never become features.
NON_PREDICTORS = ("station_id", "timestamp", "location", "split", "season", "winter_year", "pm10")
FUTURE_NAME = re.compile(r"(^|_)(lead|future|next|target)(_|$)|t\+", re.IGNORECASE)


def guard_features(df: DataFrame, target: str, features: Sequence[str] | None = None) -> list[str]:
    """Plan-time check: refuse the target, its derivatives, identifiers and future-named columns.

    Without a list, all numeric columns that pass are returned.
    """
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short")}

    def problem(c: str) -> str | None:
        if c == target or c.startswith(f"{target}_derived") or c.startswith(f"{target}_alert") or c in ("alert", "is_derived"):
            return "target or derived from it"
        if c in NON_PREDICTORS:
            return "not a predictor"
        if FUTURE_NAME.search(c):
            return "named after the future"
        return None

    if features is None:
        return [c for c in df.columns if c in numeric and problem(c) is None]
    bad = {c: problem(c) for c in features if problem(c)}
    missing = [c for c in features if c not in df.columns]
    if bad or missing:
        raise ValueError(f"features refused: {bad}, missing: {missing}")
    return list(features)


def cut_split(df: DataFrame, cut: str, time: str = S.TIME) -> DataFrame:
    """Rows before the cut are train, the rest test."""
    return df.withColumn("split", F.when(F.col(time) < F.lit(cut).cast("timestamp"), "train").otherwise("test"))


def cut_verdict(df: DataFrame, cut: str, time: str = S.TIME) -> DataFrame:
    """Errors a chronological cut must not have: null times, an empty side, a lost row."""
    t = F.col(time)
    c = F.lit(cut).cast("timestamp")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(t.isNull()).alias("n_null_time"),
        F.count_if(t < c).alias("n_train"),
        F.count_if(t >= c).alias("n_test"),
        (
            (F.count_if(t.isNull()) == 0) & (F.count_if(t < c) > 0) & (F.count_if(t >= c) > 0)
        ).alias("valid"),
    )


def station_split(df: DataFrame, fraction: float = 0.8, size: int = CHUNK) -> DataFrame:
    """First floor(fraction * n) rows of each station are train, clamped to 1..n-1."""
    numbered = running(
        df.withColumn("_hour", hour_number(S.TIME)), [S.STATION], "_hour", {"_rn": F.lit(1)}, size
    )
    n = df.groupBy(S.STATION).agg(F.count(F.lit(1)).alias("_n"))
    last = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.col("_n") * fraction)))
    return (
        numbered.join(n, S.STATION)
        .withColumn("split", F.when(F.col("_rn") <= last, "train").otherwise("test"))
        .drop("_hour", "_rn", "_n")
    )


def pooled_split(df: DataFrame, fraction: float = 0.8) -> DataFrame:
    """Cut the pooled rows by (time, station) position.

    The cut position is found on counts per hour; rows of the cut hour are
    ranked by station among themselves. No window ever spans the raw rows.
    """
    secs = df.select("*", F.unix_seconds(S.TIME).cast("double").alias("_s"))
    per_time = cumulative_counts(secs, [], "_s", bucket=F.floor(F.col("_s") / (3600 * 24)).cast("long"))
    place = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") * fraction)))
    at = per_time.filter((F.col("below") < place) & (place <= F.col("below") + F.col("cnt"))).agg(
        F.max("_s").alias("cut_s"), F.max(place - F.col("below")).alias("take")
    )
    cut_s, take = at.select("cut_s").scalar(), at.select("take").scalar()
    edge = cumulative_counts(
        secs.filter(F.col("_s") == cut_s).withColumn("_one", F.lit(1)), ["_s"], S.STATION, bucket=F.lit(0).cast("long")
    ).select("_s", S.STATION, F.col("below").alias("_before"))
    j = secs.join(edge, ["_s", S.STATION], "left")
    train = (F.col("_s") < cut_s) | ((F.col("_s") == cut_s) & (F.col("_before") < take))
    return j.withColumn("split", F.when(train, "train").otherwise("test")).drop("_s", "_before")


def split_check(df: DataFrame, pooled: bool = False) -> DataFrame:
    """Split invariants as verdict rows: both sides present, known labels, train ends before test starts."""
    tr, te = F.col("split") == "train", F.col("split") == "test"
    per = df.groupBy(S.STATION).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(tr).alias("n_train"),
        F.count_if(te).alias("n_test"),
        F.count_if(~(tr | te) | F.col("split").isNull()).alias("n_other"),
        F.max(F.when(tr, F.col(S.TIME))).alias("train_end"),
        F.min(F.when(te, F.col(S.TIME))).alias("test_start"),
    )
    checks = {
        "both_sides": (F.col("n_train") > 0) & (F.col("n_test") > 0),
        "known_labels": F.col("n_other") == 0,
        "train_before_test": F.col("train_end") < F.col("test_start"),
    }
    if not pooled:
        return verdicts(per, checks, [S.STATION])
    whole = per.agg(
        F.lit("ALL").alias(S.STATION),
        F.min("n_train").alias("n_train"),
        F.min("n_test").alias("n_test"),
        F.sum("n_other").alias("n_other"),
        F.max("train_end").alias("train_end"),
        F.min("test_start").alias("test_start"),
    )
    return verdicts(whole, checks, [S.STATION])


def fit_scaler(df: DataFrame, features: Sequence[str], train: Column, keys: Sequence[str] = (S.STATION,)) -> DataFrame:
    """Train-only parameters per key and feature: median (also the fill value) and interquartile range."""
    long = unpivoted(df.filter(train), keys, features, "feature", "v")
    q = quantiles(long, [*keys, "feature"], "v", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    every = df.select(*keys).distinct().withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    iqr = F.col("q75") - F.col("q25")
    return every.join(q, [*keys, "feature"], "left").select(
        *keys,
        "feature",
        F.coalesce("median", F.lit(0.0)).alias("median"),
        F.when(iqr > 0, iqr).otherwise(1.0).alias("scale"),
    )


def scaler_wide(params: DataFrame, features: Sequence[str], keys: Sequence[str] = (S.STATION,)) -> DataFrame:
    """One row per key with a median and a scale column per feature."""
    pick = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    return params.groupBy(*keys).agg(
        *[pick(f, "median").alias(f"_med_{f}") for f in features],
        *[pick(f, "scale").alias(f"_iqr_{f}") for f in features],
    )


def apply_scaler(df: DataFrame, params: DataFrame, features: Sequence[str], keys: Sequence[str] = (S.STATION,), scale: bool = True) -> DataFrame:
    """Fill with the train median and, if asked, centre and divide by the train IQR."""
    wide = scaler_wide(params, features, keys)
    j = df.join(wide, list(keys))
    cols = {}
    for f in features:
        x = F.coalesce(F.col(f).cast("double"), F.col(f"_med_{f}"))
        cols[f] = (x - F.col(f"_med_{f}")) / F.col(f"_iqr_{f}") if scale else x
    return j.withColumns(cols).drop(*[f"_med_{f}" for f in features], *[f"_iqr_{f}" for f in features])


def leakage_check(df: DataFrame, params: DataFrame, features: Sequence[str], keys: Sequence[str] = (S.STATION,)) -> DataFrame:
    """Learned parameters must equal a train refit, differ from a test refit, and train must end first."""
    k = [*keys, "feature"]
    train = fit_scaler(df, features, F.col("split") == "train", keys).select(*k, F.col("median").alias("_tm"), F.col("scale").alias("_ts"))
    test = fit_scaler(df, features, F.col("split") == "test", keys).select(*k, F.col("median").alias("_em"), F.col("scale").alias("_es"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9
    j = params.join(train, k).join(test, k)
    per_key = j.groupBy(*keys).agg(
        F.count_if(~(close("median", "_tm") & close("scale", "_ts"))).alias("n_unlike_train"),
        F.count_if(~(close("median", "_em") & close("scale", "_es"))).alias("n_unlike_test"),
    )
    ends = df.groupBy(*keys).agg(
        F.max(F.when(F.col("split") == "train", F.col(S.TIME))).alias("_end"),
        F.min(F.when(F.col("split") == "test", F.col(S.TIME))).alias("_start"),
    )
    return per_key.join(ends, list(keys)).select(
        *keys,
        (F.col("n_unlike_train") == 0).alias("equals_train_refit"),
        (F.col("n_unlike_test") > 0).alias("differs_from_test_refit"),
        (F.col("_end") < F.col("_start")).alias("train_before_test"),
    )


def regression_frame(df: DataFrame, cut: str, target: str = S.TARGET, features: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Observed-target rows with allowed predictors and the split."""
    allowed = guard_features(df, target, features)
    return cut_split(df.filter(F.col(target).isNotNull()), cut).select(
        S.STATION, S.TIME, target, *allowed, "split"
    ), allowed


def predictor_ranges(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (S.STATION,)) -> DataFrame:
    """Train range and median per predictor, and the share of test values outside the range."""
    long = unpivoted(df, [*keys, "split"], features, "feature", "v")
    k = [*keys, "feature"]
    train = long.filter("split = 'train'")
    r = train.groupBy(*k).agg(F.min("v").alias("train_min"), F.max("v").alias("train_max"))
    m = quantiles(train, k, "v", {"train_median": 0.5})
    out = F.count_if((F.col("v") < F.col("train_min")) | (F.col("v") > F.col("train_max")))
    test = long.filter("split = 'test'").join(r, k).groupBy(*k).agg(
        F.count("v").alias("n_test"), F.try_divide(100.0 * out, F.count("v")).alias("outside_pct")
    )
    return r.join(m, k, "left").join(test, k, "left")


def alert_features(
    df: DataFrame,
    value: str = S.TARGET,
    window: int = S.ALERT_WINDOW,
    min_periods: int = S.ALERT_MIN_PERIODS,
    threshold: float = S.ALERT_THRESHOLD,
    size: int = CHUNK,
) -> DataFrame:
    """Label at t (window ending at t) and past-only features (window ending at t-1), one windowed pass.

    Both share 23 of 24 hours, which is why a label at horizon 0 is almost
    determined by its features; longer horizons are the honest ones.
    """
    now = lambda w: w.rangeBetween(-(window - 1), 0)
    past = lambda w: w.rangeBetween(-window, -1)
    out = windowed(
        df.withColumn("_hour", hour_number(S.TIME)),
        [S.STATION],
        "_hour",
        {
            "_n": lambda w: F.count(value).over(now(w)),
            "_m": lambda w: F.avg(value).over(now(w)),
            "_pn": lambda w: F.count(value).over(past(w)),
            "_pm": lambda w: F.avg(value).over(past(w)),
            "_ps": lambda w: F.stddev_samp(value).over(past(w)),
            f"lag_{window}h": lambda w: F.max(value).over(w.rangeBetween(-window, -window)),
        },
        back=window,
        size=size,
    )
    enough = F.col("_pn") >= min_periods
    return out.withColumns(
        {
            "alert": F.when(F.col("_n") >= min_periods, (F.round("_m", 9) >= threshold).cast("int")),
            "past_mean": F.when(enough, F.col("_pm")),
            "past_sd": F.when(enough, F.col("_ps")),
        }
    ).drop("_hour", "_n", "_m", "_pn", "_pm", "_ps")


def classification_frame(features: DataFrame, cut: str, horizon: int = 0) -> DataFrame:
    """Model rows: label at t + horizon by timestamp, complete history, purged train border."""
    cut_ts = F.lit(cut).cast("timestamp")
    if horizon:
        labelled = value_at_offset(features.select(S.STATION, S.TIME, "alert"), -horizon, "alert", "label").select(
            S.STATION, S.TIME, "label"
        )
        base = features.join(labelled, [S.STATION, S.TIME], "left")
    else:
        base = features.withColumn("label", F.col("alert"))
    part = F.when(F.col(S.TIME) < cut_ts, "train").otherwise("test")
    reach = F.timestamp_seconds(F.unix_seconds(S.TIME) + horizon * 3600)
    kept = F.col("label").isNotNull() & F.col("past_mean").isNotNull()
    purged = (F.col("split") == "train") & (reach >= cut_ts) if horizon else F.lit(False)
    return base.withColumn("split", part).withColumn("row_state", F.when(~kept, "incomplete").when(purged, "purged").otherwise("used"))


def frame_counts(frame: DataFrame) -> DataFrame:
    """Rows, labelled rows, used rows and prevalence with both denominators, by station and split."""
    used = F.col("row_state") == "used"
    return frame.groupBy(S.STATION, "split").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count("label").alias("n_labelled"),
        F.count_if(used).alias("n_used"),
        F.count_if(F.col("row_state") == "purged").alias("n_purged"),
        F.count_if(used & (F.col("label") == 1)).alias("n_positive"),
        F.try_divide(F.count_if(used & (F.col("label") == 1)), F.count_if(used)).alias("prevalence_used"),
        (F.count_if(used & (F.col("label") == 1)) / F.count(F.lit(1))).alias("prevalence_all"),
    )


def expanding_folds(df: DataFrame, n_folds: int, keys: Sequence[str] = (S.STATION,), time: str = S.TIME, size: int = CHUNK) -> DataFrame:
    """Block number 0..n_folds of each row: fold i trains on blocks below i and validates on block i.

    Validation blocks hold n // (n_folds + 1) rows; the remainder goes to block 0.
    """
    numbered = running(df.withColumn("_hour", hour_number(time)), list(keys), "_hour", {"_rn": F.lit(1)}, size)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    test = F.floor(F.col("_n") / (n_folds + 1))
    first = F.col("_n") - n_folds * test
    block = F.when(F.col("_rn") <= first, 0).otherwise(F.floor((F.col("_rn") - first - 1) / test) + 1)
    return numbered.join(n, list(keys)).withColumn("block", block.cast("int")).drop("_hour", "_rn", "_n")


def guard_verdicts(df: DataFrame, target: str, candidates: Mapping[str, Sequence[str]]) -> list[tuple[str, bool]]:
    """Outcome of guard_features for several candidate lists; runs no job."""
    out = []
    for name, cols in candidates.items():
        try:
            guard_features(df, target, cols)
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return out
