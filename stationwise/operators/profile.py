"""Descriptive profiles: moments, quantiles, circular statistics, densities and correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from .clean import stacked, unpivoted
from .ranks import average_ranks, cumulative_counts, quantiles

PERCENTILES = {"p10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def circular(degrees: Column) -> dict[str, Column]:
    """Circular mean, circular standard deviation (degrees) and resultant length."""
    s, c = F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    r = F.sqrt(s * s + c * c)
    return {
        "circular_mean": F.pmod(F.degrees(F.atan2(s, c)) + 360.0, F.lit(360.0)),
        "circular_sd": F.degrees(F.sqrt(-2 * F.log(r))),
        "resultant": r,
    }


def statistical_profile(df: DataFrame, keys: Sequence[str], variables: Sequence[str], angle: str | None = "wind_direction") -> DataFrame:
    """Full profile per group and variable; the mode is NULL unless it is unique."""
    long = unpivoted(df, keys, variables)
    k = [*keys, "variable"]
    moments = long.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("value").alias("n"),
        (100.0 * F.count_if(F.col("value").isNull()) / F.count(F.lit(1))).alias("missing_pct"),
        F.avg("value").alias("mean"),
        F.var_samp("value").alias("variance"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        fn.sample_skewness("value").alias("skewness"),
        fn.sample_kurtosis("value").alias("kurtosis"),
        *[
            (F.when(F.first("variable") == angle, c) if angle else F.lit(None).cast("double")).alias(n)
            for n, c in circular(F.col("value")).items()
        ],
    )
    q = quantiles(long, k, "value", PERCENTILES)
    modes = (
        cumulative_counts(long, k, "value")
        .groupBy(*k)
        .agg(
            F.max_by("value", F.struct("cnt", "value")).alias("_hi"),
            F.max_by("value", F.struct(F.col("cnt"), -F.col("value"))).alias("_lo"),
        )
        .select(*k, F.when(F.col("_hi") == F.col("_lo"), F.col("_hi")).alias("mode"))
    )
    return (
        moments.join(q, k, "left")
        .join(modes, k, "left")
        .withColumns({"iqr": F.col("q75") - F.col("q25"), "range": F.col("max") - F.col("min")})
    )


def group_stats(df: DataFrame, levels: Mapping[str, Column], value: str = S.TARGET, keys: Sequence[str] = (S.STATION,)) -> DataFrame:
    """n, mean and quantiles by each calendar level (hour, weekday, month, ...) in one job."""
    tags = F.array(
        *[F.struct(F.lit(n).alias("level"), c.cast("string").alias("key")) for n, c in levels.items()]
    )
    long = df.select(*keys, value, F.explode(tags).alias("_t")).select(*keys, value, "_t.*")
    k = [*keys, "level", "key"]
    base = long.groupBy(*k).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    q = quantiles(long, k, value, {"q25": 0.25, "median": 0.5, "q75": 0.75, "p90": 0.9, "p95": 0.95})
    return base.join(q, k, "left").withColumn("iqr", F.col("q75") - F.col("q25"))


def extreme_groups(stats: DataFrame, by: str, keys: Sequence[str] = (S.STATION,)) -> DataFrame:
    """Group with the largest and smallest statistic per level."""
    has = F.col(by).isNotNull()
    return stats.groupBy(*keys, "level").agg(
        F.max_by("key", F.when(has, F.struct(by, "key"))).alias("highest_key"),
        F.max(by).alias("highest"),
        F.min_by("key", F.when(has, F.struct(by, "key"))).alias("lowest_key"),
        F.min(by).alias("lowest"),
    )


def hour_dow_matrix(df: DataFrame, value: str = S.TARGET) -> DataFrame:
    """7 x 24 matrix of means per station; every weekday is present, empty cells are NULL."""
    spine = df.select(S.STATION).distinct().withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6))))
    cells = (
        df.select(S.STATION, F.weekday(S.TIME).alias("dow"), F.hour(S.TIME).alias("hour"), value)
        .groupBy(S.STATION, "dow")
        .pivot("hour", list(range(24)))
        .agg(F.avg(value))
    )
    named = cells.select(S.STATION, "dow", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])
    return spine.join(named, [S.STATION, "dow"], "left").withColumn("dow", F.col("dow").cast("long"))


def hour_dow_summary(df: DataFrame, value: str = S.TARGET) -> DataFrame:
    """Weekend minus weekday mean and the extreme cells of the matrix."""
    weekend = F.weekday(S.TIME) >= 5
    gap = df.groupBy(S.STATION).agg(
        (F.avg(F.when(weekend, F.col(value))) - F.avg(F.when(~weekend, F.col(value)))).alias("weekend_minus_weekday")
    )
    cells = df.groupBy(S.STATION, F.weekday(S.TIME).alias("dow"), F.hour(S.TIME).alias("hour")).agg(F.avg(value).alias("m"))
    has = F.col("m").isNotNull()
    ext = cells.groupBy(S.STATION).agg(
        F.max("m").alias("peak_mean"),
        F.max_by(F.col("dow") * 24 + F.col("hour"), F.when(has, F.struct("m", "dow", "hour"))).cast("long").alias("peak_cell"),
        F.min("m").alias("trough_mean"),
        F.min_by(F.col("dow") * 24 + F.col("hour"), F.when(has, F.struct("m", "dow", "hour"))).cast("long").alias("trough_cell"),
    )
    return gap.join(ext, S.STATION)


def pair_correlation(df: DataFrame, keys: Sequence[str], target: str, variables: Sequence[str], min_n: int = 3) -> DataFrame:
    """Pearson and Spearman of the target against each variable on pairwise-complete rows."""
    long = df.select(*keys, target, *variables).unpivot([*keys, target], list(variables), "variable", "x")
    k = [*keys, "variable"]
    coverage = long.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(target).isNotNull() & F.col("x").isNotNull()).alias("n_pairs"),
        fn.safe_corr("x", target).alias("pearson"),
    )
    pairs = long.filter(F.col(target).isNotNull() & F.col("x").isNotNull())
    # equal (x, y) pairs are counted once, so both rank joins run on the reduced table
    cells = pairs.groupBy(*k, "x", target).agg(F.count(F.lit(1)).alias("_c"))
    rx = average_ranks(pairs, k, "x").select(*k, "x", F.col("avg_rank").alias("_rx"))
    ry = average_ranks(pairs, k, target).select(*k, target, F.col("avg_rank").alias("_ry"))
    ranked = cells.join(rx, [*k, "x"]).join(ry, [*k, target])
    corr = ranked.groupBy(*k).agg(
        weighted_corr(F.col("_rx"), F.col("_ry"), F.col("_c")).alias("spearman"),
    )
    return (
        coverage.join(corr, k, "left")
        .withColumn("pair_pct", 100.0 * F.col("n_pairs") / F.col("n_rows"))
        .filter(F.col("n_pairs") >= min_n)
    )


def weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Pearson correlation of counted pairs of ranks, whose spread is like their mean; NULL when either side is constant."""
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    sxy, sxx, syy = F.sum(w * x * y), F.sum(w * x * x), F.sum(w * y * y)
    den = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(n * sxy - sx * sy, den))


def correlation_matrix(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = (S.STATION,), row_key: Sequence[str] = (S.STATION, S.TIME)) -> DataFrame:
    """Complete-case Pearson and Spearman matrices per key, one row for each pair of variables; row_key holds the keys."""
    complete = df.select(*row_key, *variables).dropna(subset=list(variables))
    long = unpivoted(complete, row_key, variables)
    ranks = average_ranks(long, [*keys, "variable"], "value").select(*keys, "variable", "value", "avg_rank")
    ranked = (
        long.join(ranks, [*keys, "variable", "value"])
        .groupBy(*row_key)
        .pivot("variable", list(variables))
        .agg(F.first("avg_rank"))
    )
    names = list(combinations(variables, 2))
    out = []
    for frame, label in ((complete, "pearson"), (ranked, "spearman")):
        wide = frame.groupBy(*keys).agg(*[fn.safe_corr(a, b).alias(f"{a}__{b}") for a, b in names])
        rows = {f"{a}|{b}": {"corr": f"{a}__{b}"} for a, b in names}
        out.append(stacked(wide, rows, "pair", keys).withColumn("method", F.lit(label)))
    return out[0].unionByName(out[1])


def quantile_bins(df: DataFrame, keys: Sequence[str], x: str, bins: int) -> DataFrame:
    """Right-closed quantile bin number of x per group; repeated edges are merged."""
    probs = {f"_e{i}": i / bins for i in range(bins + 1)}
    edges = quantiles(df, keys, x, probs).select(
        *keys, F.array_distinct(F.array(*probs)).alias("_edges")
    )
    joined = df.join(edges, list(keys)) if keys else df.withColumn("_edges", edges.select("_edges").scalar())
    below = F.size(F.filter("_edges", lambda e: e < F.col(x)))
    return joined.withColumn("bin", F.when(F.col(x).isNotNull(), F.greatest(below - 1, F.lit(0))).cast("long")).drop("_edges")


def quantile_bin_trend(df: DataFrame, keys: Sequence[str], x: str, y: str, bins: int = 10) -> DataFrame:
    """Per quantile bin of x: n, median x, and quartiles of y."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    binned = quantile_bins(both, keys, x, bins)
    k = [*keys, "bin"]
    n = binned.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    qx = quantiles(binned, k, x, {"median_x": 0.5})
    qy = quantiles(binned, k, y, {"median_y": 0.5, "q25_y": 0.25, "q75_y": 0.75})
    return n.join(qx, k).join(qy, k)


def wind_rose(df: DataFrame, keys: Sequence[str], direction: str = "wind_direction") -> DataFrame:
    """Counts and shares per compass sector; empty sectors are kept."""
    counts = (
        df.select(*keys, fn.sector16(direction).alias("sector")).filter("sector is not null")
        .groupBy(*keys, "sector").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    spine = totals.withColumn("sector", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return spine.join(counts, [*keys, "sector"], "left").select(
        *keys,
        F.col("sector").cast("long").alias("sector"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (100.0 * F.coalesce("n", F.lit(0)) / F.col("_t")).alias("pct"),
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 20) -> DataFrame:
    """Equal-width density histogram per group; the last bin is closed."""
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    binned = df.filter(F.col(value).isNotNull()).join(span, list(keys)).withColumn(
        "bin", F.coalesce(F.least(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(bins - 1)), F.lit(0)).cast("long")
    )
    return binned.groupBy(*keys, "bin", "_lo", "_hi", "_n").agg(F.count(F.lit(1)).alias("n")).select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("left_edge"),
        "n",
        F.try_divide("n", F.col("_n") * width).alias("density"),
    )


def kde_density(df: DataFrame, keys: Sequence[str], value: str, points: int = 32) -> DataFrame:
    """Gaussian density on an even grid with Scott's bandwidth.

    Values are counted first; the grid points are aggregate columns, so the
    work is values x points inside one scan and no row is multiplied.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    span = df.groupBy(*keys).agg(
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
        F.count(value).alias("_n"),
        (F.stddev_samp(value) * F.pow(F.count(value).cast("double"), F.lit(-0.2))).alias("_h"),
    )
    joined = counted.join(span, list(keys))
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    at = lambda i: F.col("_lo") + step * i
    dens = [
        F.sum(F.col("_c") * F.exp(-0.5 * F.pow(F.try_divide(at(i) - F.col(value), F.col("_h")), 2))).alias(f"_d{i}")
        for i in range(points)
    ]
    wide = joined.groupBy(*keys, "_lo", "_hi", "_n", "_h").agg(*dens)
    norm = F.col("_n") * F.col("_h") * F.sqrt(2 * F.pi())
    cells = [
        F.struct(F.lit(i).cast("long").alias("point"), at(i).alias("x"), F.try_divide(f"_d{i}", norm).alias("density"))
        for i in range(points)
    ]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("_r")).select(*keys, "_r.*")


def density_mode(density: DataFrame, keys: Sequence[str]) -> DataFrame:
    return density.groupBy(*keys).agg(F.max_by("x", "density").alias("mode_x"), F.max("density").alias("mode_density"))
