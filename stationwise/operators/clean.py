"""Key repair, dedup, hourly roll-up and cleaning statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from .ranks import quantiles


def hourly_means(
    df: DataFrame, columns: Mapping[str, str], keys: Sequence[str] = (S.STATION,), decimals: int = 9
) -> DataFrame:
    """Mean per key and hour; partial sums combine before the shuffle, an all-NULL hour stays NULL."""
    return df.groupBy(*keys, S.TIME).agg(
        *[F.round(F.avg(src), decimals).alias(name) for name, src in columns.items()]
    )


def hourly_pivot(long: DataFrame, parameters: Sequence[str], keys: Sequence[str] = (S.STATION,)) -> DataFrame:
    """Sub-hourly long readings to one wide row per local hour; an absent parameter is a NULL column.

    Input: keys, timestamp (local), parameter, value. The parameter list is fixed, so
    no extra job looks for distinct values.
    """
    return (
        long.withColumn(S.TIME, F.date_trunc("hour", S.TIME))
        .groupBy(*keys, S.TIME)
        .pivot("parameter", list(parameters))
        .agg(F.round(F.avg(fn.nonnegative(fn.null_normalise("value"))), 9))
    )


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key by an explicit order.

    A struct minimum combines on the map side, so a key repeated billions of
    times never meets in one task, unlike a ranked window.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in [*order, *rest]]).select(
        *df.columns
    )


def marker_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column: conversions by kind and kept values, in one aggregate."""
    kinds = {}
    for c in columns:
        n = fn.parsed_number(c)
        kinds[c] = [
            F.count_if(fn.is_marker(c)).alias(f"{c}__marker"),
            F.count_if(fn.is_sentinel(n)).alias(f"{c}__sentinel"),
            F.count_if(F.col(c).isNotNull() & ~fn.is_marker(c) & n.isNull()).alias(f"{c}__unparsable"),
            F.count(fn.undisguised(c)).alias(f"{c}__kept"),
            F.count_if(fn.undisguised(c) == 0).alias(f"{c}__zero_kept"),
        ]
    wide = df.agg(*[k for ks in kinds.values() for k in ks])
    names = ("marker", "sentinel", "unparsable", "kept", "zero_kept")
    return stacked(wide, {c: {k: f"{c}__{k}" for k in names} for c in columns}, "column")


def stacked(wide: DataFrame, rows: Mapping[str, Mapping[str, str | Column]], label: str, keys=()) -> DataFrame:
    """Turn one wide row into labelled rows without another pass over the data."""
    structs = [
        F.struct(
            F.lit(name).alias(label),
            *[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in cols.items()],
        )
        for name, cols in rows.items()
    ]
    return wide.select(*keys, F.explode(F.array(*structs)).alias("_r")).select(*keys, "_r.*")


def unpivoted(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name="variable", value="value") -> DataFrame:
    """Long form of measure columns."""
    return df.select(*keys, *columns).unpivot(list(keys), list(columns), name, value)


def cause_counts(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Lost raw values per variable and cause; source NULLs are not losses."""
    causes = ("sentinel", "unparsable", "out_of_bounds")
    wide = df.agg(
        *[
            F.count_if(fn.weather_loss_cause(v, F.col(v).cast("string")) == cause).alias(f"{v}__{cause}")
            for v in variables
            for cause in causes
        ]
    )
    return stacked(wide, {v: {c: f"{v}__{c}" for c in causes} for v in variables}, "variable")


def enforce_subset(df: DataFrame, fine: str, coarse: str) -> DataFrame:
    """Every strict inversion empties both sides."""
    bad = F.coalesce(fn.inverted(fine, coarse), F.lit(False))
    return df.withColumns(
        {fine: F.when(~bad, F.col(fine)), coarse: F.when(~bad, F.col(coarse))}
    )


def subset_evidence(df: DataFrame, fine: str, coarse: str, epsilon: float = S.SUBSET_EPSILON) -> DataFrame:
    gap = F.col(fine) - F.col(coarse)
    return df.agg(
        F.count(gap).alias("n_pairs"),
        F.count_if(gap > 0).alias("n_strict"),
        F.count_if(gap > epsilon).alias("n_beyond_epsilon"),
        F.max(F.when(gap > 0, gap)).alias("largest_inversion"),
    )


def log1p_diagnostic(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Shape before and after log1p; negative input is reported, not transformed."""
    raw = F.when(F.col(value) >= 0, F.col(value))
    return (
        df.select(*keys, F.col(value), F.log1p(raw).alias("_log"))
        .groupBy(*keys)
        .agg(
            F.count(value).alias("n"),
            F.count_if(F.col(value) < 0).alias("n_negative"),
            fn.sample_skewness(value).alias("skew_raw"),
            fn.sample_skewness("_log").alias("skew_log1p"),
            fn.sample_kurtosis(value).alias("kurt_raw"),
            fn.sample_kurtosis("_log").alias("kurt_log1p"),
        )
        .withColumn("improves", F.abs("skew_log1p") < F.abs("skew_raw"))
    )


def chronology(df: DataFrame, keys: Sequence[str], seq: str, time: str, size: int = 1 << 20) -> DataFrame:
    """Rows that arrive earlier than the row before them in ingest order.

    The previous row is found inside a block of sequence numbers; block borders
    are compared through one row per block.
    """
    blocked = df.withColumn("_block", F.floor(F.col(seq) / size))
    inside = W.partitionBy(*keys, "_block").orderBy(seq)
    marked = blocked.select(*keys, "_block", seq, time, F.lag(time).over(inside).alias("_prev"))
    per_block = marked.groupBy(*keys, "_block").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(time) < F.col("_prev")).alias("late"),
        F.count_if(F.col(time) == F.col("_prev")).alias("tied"),
        F.min_by(time, seq).alias("_first"),
        F.max_by(time, seq).alias("_last"),
    )
    borders = W.partitionBy(*keys).orderBy("_block")
    before = F.lag("_last").over(borders)
    joined = per_block.select(
        *keys,
        "n_rows",
        (F.col("late") + F.coalesce((F.col("_first") < before).cast("int"), F.lit(0))).alias("late"),
        (F.col("tied") + F.coalesce((F.col("_first") == before).cast("int"), F.lit(0))).alias("tied"),
    )
    return joined.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("late").alias("n_out_of_order"),
        F.sum("tied").alias("n_equal_times"),
        (F.sum("late") == 0).alias("is_ordered"),
    )


def snapshot(df: DataFrame, keys: Sequence[str], measures: Sequence[str], target: str) -> DataFrame:
    """Rows, distinct keys, missing cells and the target's extremes, in one aggregate."""
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(m).isNull()).alias(f"_miss_{m}") for m in measures],
        F.max(target).alias("_hi"),
        F.min(target).alias("_lo"),
    )
    return per_key.agg(
        F.sum("_rows").alias("n_rows"),
        (F.sum("_rows") - F.count(F.lit(1))).alias("n_duplicate_rows"),
        *[F.sum(f"_miss_{m}").alias(f"missing_{m}") for m in measures],
        F.max("_hi").alias("peak"),
        F.min("_lo").alias("trough"),
    )


def peak_trace(before: DataFrame, after: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Per station: the input's peak row and what the cleaned table holds at that key."""
    station = keys[0]
    rest = list(keys[1:])
    order = F.struct(F.col(target), *[-F.unix_seconds(k) for k in rest])
    peaks = before.groupBy(station).agg(
        F.max(target).alias("peak"),
        *[F.max_by(k, F.when(F.col(target).isNotNull(), order)).alias(k) for k in rest],
    )
    return peaks.join(
        after.select(*keys, F.col(target).alias("_after"), F.lit(True).alias("_present")), list(keys), "left"
    ).select(
        *keys,
        "peak",
        F.when(F.col("_present").isNull(), "row_removed")
        .when(F.col("_after").isNull(), "nulled")
        .when(F.col("_after") == F.col("peak"), "survived")
        .otherwise("changed")
        .alias("fate"),
    )


def with_persistence(df: DataFrame, keys: Sequence[str], value: str, train: Column) -> DataFrame:
    """Persistence score with the train median as fallback, per key."""
    med = quantiles(df.filter(train), keys, value, {"_train_median": 0.5})
    return (
        df.join(med, list(keys), "left")
        .withColumn("score", fn.persistence_probability(value, F.col("_train_median")))
        .withColumn("hard", F.coalesce((F.col(value) >= S.ALERT_THRESHOLD).cast("int"), F.lit(0)))
        .drop("_train_median")
    )
