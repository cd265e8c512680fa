"""Exact ranks and quantiles that survive a hot group.

A group's values are first reduced to (value, count); the value axis is then
cut into ordered magnitude buckets, so the prefix sum of a group that holds a
third of all rows is spread over hundreds of tasks. Nothing is approximated.

Groups that are bounded by the calendar (daily or weekly values of a station)
may say bounded=True: then one window per group and the built-in exact
percentile do the same work with fewer shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets for a factor of e, and the magnitude below which buckets are of equal width. A factor of
#: 1.1, such as the whole range of an air pressure, is some 400 buckets; so is that of small scores.
BUCKETS_PER_E = 4096
LEAST = 1e-6


def magnitude_bucket(value: str | Column) -> Column:
    """Order-preserving bucket of a double: a larger value never gets a smaller bucket."""
    v = F.col(value) if isinstance(value, str) else value
    return F.floor(F.signum(v) * F.log1p(F.abs(v) / LEAST) * BUCKETS_PER_E).cast("long")


def cumulative_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: Column | None = None,
    bucket: Column | None = None,
    bounded: bool = False,
) -> DataFrame:
    """One row per (keys, value): cnt, rows strictly below, and group size n.

    bucket may replace the magnitude bucket by any other non-decreasing
    function of the value, such as equal widths for uniform draws.
    """
    keys = list(keys)
    values = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("cnt"))
    )
    if bounded:
        group = W.partitionBy(*keys)
        below = group.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        return values.select(
            *keys,
            value,
            "cnt",
            F.coalesce(F.sum("cnt").over(below), F.lit(0)).alias("below"),
            F.sum("cnt").over(group).alias("n"),
        )
    counted = values.withColumn("_bucket", magnitude_bucket(value) if bucket is None else bucket)
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    totals = (
        counted.groupBy(*keys, "_bucket")
        .agg(F.sum("cnt").alias("_total"))
        .select(
            *keys,
            "_bucket",
            F.coalesce(
                F.sum("_total").over(whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("_before"),
            F.sum("_total").over(whole).alias("n"),
        )
    )
    inside = (
        W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        counted.join(totals, [*keys, "_bucket"])
        .withColumn("below", F.col("_before") + F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
        .select(*keys, value, "cnt", "below", "n")
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, bounded: bool = False) -> DataFrame:
    """Average rank per distinct value: ties share the mean of their ordinal ranks."""
    return cumulative_counts(df, keys, value, bounded=bounded).withColumn(
        "avg_rank", F.col("below") + (F.col("cnt") + 1) / 2.0
    )


def _at_rank(value: str, rank: Column) -> Column:
    hit = (F.col("below") <= rank) & (rank < F.col("below") + F.col("cnt"))
    return F.max(F.when(hit, F.col(value)))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    weight: Column | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, as named columns."""
    if bounded and weight is None:
        return (
            df.filter(F.col(value).isNotNull())
            .groupBy(*keys)
            .agg(*[F.percentile(value, F.lit(float(p))).alias(name) for name, p in probs.items()])
        )
    ranked = cumulative_counts(df, keys, value, weight)
    picks = []
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        picks += [
            _at_rank(value, F.floor(at)).alias(f"_lo_{name}"),
            _at_rank(value, F.ceil(at)).alias(f"_hi_{name}"),
        ]
    found = ranked.groupBy(*keys).agg(F.max("n").alias("_n"), *picks)
    out = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*keys, *out)
