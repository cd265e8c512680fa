"""Block resampling of daily and weekly calendars.

A calendar is one row per (station, pos) with value (NULL = missing) and labels.
Statistics are taken of packed replicates (see `packed`): block starts come from a
seeded hash, values move with their blocks, labels stay. `replicates` writes the
same replicates out as rows, for a look at single ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from . import packed
from .ranks import quantiles
from .sequence import running, runs
from .stats import kruskal_wallis, mann_whitney, signed_rank

KEYS = (S.STATION,)


def compact_calendar(df: DataFrame, value: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    """Observed rows only, renumbered without gaps."""
    seen = df.filter(F.col(value).isNotNull())
    return running(seen.select(*keys, "pos", value), list(keys), "pos", {"_rn": F.lit(1)}, size=None).select(
        *keys, (F.col("_rn") - 1).cast("long").alias("pos"), value
    )


def block_starts(calendar: DataFrame, n_boot: int, blocks: Sequence[int], seed: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, block, b, _n (days), _len (of a whole block), _j (number of the block) and _start of every drawn block."""
    n = calendar.groupBy(*keys).agg((F.max("pos") + 1).alias("_n"))
    sized = n.withColumn("block", F.explode(F.array(*[F.lit(b).cast("long") for b in blocks]))).withColumn(
        "_len", F.least("block", "_n")
    )
    return (
        sized.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
        .withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / F.col("_len")) - 1)))
        .withColumn("_start", fn.draw32(F.lit(seed), *[F.col(k) for k in keys], F.col("b"), F.col("_j")) % F.col("_n"))
    )


def replicates(
    calendar: DataFrame,
    n_boot: int,
    blocks: Sequence[int],
    seed: int,
    value: str = "value",
    labels: Sequence[str] = (),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Circular moving-block replicates as rows: keys, block, b, dest, value and the labels of the destination.

    Values (and their missing marks) move; labels stay where they are.
    """
    keys = list(keys)
    cells = (
        block_starts(calendar, n_boot, blocks, seed, keys)
        .withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_len") - 1)))
        .withColumn("dest", F.col("_j") * F.col("_len") + F.col("_o"))
        .filter(F.col("dest") < F.col("_n"))
        .withColumn("_src", (F.col("_start") + F.col("_o")) % F.col("_n"))
    )
    source = calendar.select(*keys, F.col("pos").alias("_src"), F.col(value).alias("value"))
    out = cells.join(source, [*keys, "_src"])
    if labels:
        out = out.join(calendar.select(*keys, F.col("pos").alias("dest"), *labels), [*keys, "dest"])
    return out.select(*keys, "block", "b", "dest", "value", *labels)


def mean_by_prefix_sums(dense: DataFrame, n_boot: int, blocks: Sequence[int], seed: int, value: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, block, b, stat: means of the replicates of a series without gaps.

    A block's sum is the difference of two prefix sums over the series run twice, so this
    is another way to the same replicates: drawn, looked up and added up by Spark alone.
    The prefix sums travel as one array beside the numbers of the replicates that a task
    draws; there is one row per replicate and block length, none per drawn block.
    """
    keys = list(keys)
    n = dense.groupBy(*keys).agg((F.max("pos") + 1).alias("_n"))
    twice = dense.join(n, keys).withColumn("_lap", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")))
    twice = twice.select(*keys, "_n", (F.col("pos") + F.col("_lap") * F.col("_n") + 1).alias("_at"), F.col(value).alias("_x"))
    sums = F.sum("_x").over(W.partitionBy(*keys).orderBy("_at"))
    ordered = F.sort_array(F.collect_list(F.struct("_at", "_sum")))["_sum"]
    prefix = twice.withColumn("_sum", sums).groupBy(*keys).agg(F.max("_n").alias("_n"), F.concat(F.array(F.lit(0.0)), ordered).alias("_sums"))
    batches = prefix.withColumn("_batch", F.explode(packed.batches_of(n_boot))).select(*keys, "_n", "_sums", "_batch.*")
    each = packed.spread_out(batches, *keys, "first").select(*keys, "_n", "_sums", F.explode(F.sequence("first", "last")).alias("b"))
    sizes = sorted(set(blocks))

    def numbers(size: int) -> Column:
        """0, 1, ... for the blocks of a replicate."""
        return F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / F.least(F.lit(size).cast("long"), "_n")) - 1)

    # all block lengths use the same draws
    starts = F.transform(numbers(sizes[0]), lambda j: fn.draw32(F.lit(seed), *[F.col(k) for k in keys], F.col("b"), j) % F.col("_n"))

    def mean(size: int) -> Column:
        length = F.least(F.lit(size).cast("long"), "_n")

        def add(total: Column, j: Column) -> Column:
            start = F.get("_starts", j)
            return total + F.get("_sums", start + F.least(length, F.col("_n") - j * length)) - F.get("_sums", start)

        return F.aggregate(numbers(size), F.lit(0.0), add) / F.col("_n")

    found = F.array(*[F.struct(F.lit(s).cast("long").alias("block"), mean(s).alias("stat")) for s in sizes])
    return each.withColumn("_starts", starts).select(*keys, "b", F.explode(found).alias("_r")).select(*keys, "_r.block", "b", "_r.stat")


def closed_form_mean(dense: DataFrame, blocks: Sequence[int], value: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, block, expected and sd of the circular block bootstrap mean of a series without gaps, exactly.

    A block's start is uniform on the circle, so the variance of its sum is
    L g(0) + 2 sum_k (L - k) g(k), g the autocovariances of the circle; whole blocks and
    the cut last one are independent.
    """
    keys = list(keys)
    sizes = F.array(*[F.lit(b).cast("long") for b in blocks])
    m = dense.groupBy(*keys).agg((F.max("pos") + 1).alias("_n"), F.avg(value).alias("expected"))
    centred_ = dense.join(m, keys).select(*keys, "pos", "_n", (F.col(value) - F.col("expected")).alias("_x"))
    lags = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(max(blocks)).cast("long"), F.col("_n")) - 1))
    ahead = centred_.withColumn("_k", lags).withColumn("_to", (F.col("pos") + F.col("_k")) % F.col("_n"))
    other = centred_.select(*keys, F.col("pos").alias("_to"), F.col("_x").alias("_y"))
    g = ahead.join(other, [*keys, "_to"]).groupBy(*keys, "_k").agg((F.sum(F.col("_x") * F.col("_y")) / F.max("_n")).alias("_g"))
    laid = m.withColumn("block", F.explode(sizes)).withColumn("_len", F.least("block", "_n")).withColumn("_rest", F.col("_n") % F.col("_len"))

    def weight(size):
        return F.when(F.col("_k") < size, F.when(F.col("_k") == 0, size).otherwise(2 * (size - F.col("_k")))).otherwise(F.lit(0))

    part = F.col("_g") * (F.floor(F.col("_n") / F.col("_len")) * weight(F.col("_len")) + weight(F.col("_rest")))
    var = F.sum(part) / F.max(F.col("_n") * F.col("_n"))
    return laid.join(g, keys).groupBy(*keys, "block").agg(F.max("expected").alias("expected"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))


def compact_mean_report(calendar: DataFrame, n_boot: int, blocks: Sequence[int], seed: int, value: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    """Bootstrap intervals of the mean of observed days, as `inference_recheck` checks them."""
    return calendar_ci(compact_calendar(calendar, value, keys), "mean", n_boot, blocks, seed, value, keys)


def percentile_ci(stats: DataFrame, keys: Sequence[str], stat: str = "stat", level: float = 0.95, extra: Sequence[Column] = ()) -> DataFrame:
    """Percentile interval over replicates; a group holds one number per replicate."""
    tail = (1 - level) / 2
    return stats.filter(F.col(stat).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_replicates"),
        F.percentile(stat, F.lit(tail)).alias("ci_low"),
        F.percentile(stat, F.lit(1 - tail)).alias("ci_high"),
        F.stddev_samp(stat).alias("replicate_sd"),
        *extra,
    )


def point_estimate(df: DataFrame, statistic, value: str, keys: Sequence[str]) -> DataFrame:
    """The statistic of the observed values; a caller's own is taken of the calendar as it is."""
    if statistic == "median":
        return quantiles(df, keys, value, {"point": 0.5}, bounded=True)
    if statistic == "mean":
        return df.groupBy(*keys).agg(F.avg(value).alias("point"))
    own = packed.named(statistic, value)
    return packed.identity_stats(df, own, keys).withColumnRenamed(own.names[0], "point")


def calendar_ci(
    calendar: DataFrame, statistic, n_boot: int, blocks: Sequence[int], seed: int, value: str = "value", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Percentile interval of the median, the mean or a caller's statistic; missing days travel with the blocks.

    A caller's statistic is a `packed.Statistic` of one name, or a function of a matrix
    (replicates x days, NaN where missing).
    """
    keys = list(keys)
    own = packed.named(statistic, value)
    stats = packed.replicate_stats(calendar, n_boot, blocks, seed, [own], keys, value).withColumnRenamed(own.names[0], "stat")
    ci = percentile_ci(stats, [*keys, "block"], extra=[F.avg("n_observed").alias("mean_observed")])
    return ci.join(point_estimate(calendar, statistic, value, keys), keys)


def compact_ci(calendar: DataFrame, statistic, n_boot: int, block: int, seed: int, value: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    """The same interval on the series of observed days, closed up."""
    return calendar_ci(compact_calendar(calendar, value, keys), statistic, n_boot, [block], seed, value, keys)


def null_p(stats: DataFrame, observed: DataFrame, n_boot: int, keys: Sequence[str], alternative: str = "two-sided") -> DataFrame:
    """p = (1 + extremes) / (B + 1); dropped replicates stay in the denominator."""
    keys = list(keys)
    j = stats.filter(F.col("stat").isNotNull()).join(observed, keys)
    agg = j.groupBy(*keys, "block").agg(
        F.max("observed").alias("observed"),
        F.count(F.lit(1)).alias("n_replicates"),
        F.count_if(F.col("stat") >= F.col("observed")).alias("n_ge"),
        F.count_if(F.col("stat") <= F.col("observed")).alias("n_le"),
    )
    ge, le = (1 + F.col("n_ge")) / (n_boot + 1), (1 + F.col("n_le")) / (n_boot + 1)
    p = {"greater": ge, "less": le, "two-sided": F.least(F.lit(1.0), 2 * F.least(ge, le))}[alternative]
    return agg.withColumn("p_value", p)


def observed_h(calendar: DataFrame, label: str, value: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    return kruskal_wallis(calendar, label, value, keys).select(*keys, F.col("h").alias("observed"))


def observed_u(calendar: DataFrame, label: str, a, b, biserial: bool = False, value: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    col = "rank_biserial" if biserial else "u"
    return mann_whitney(calendar, label, a, b, value, keys).select(*keys, F.col(col).alias("observed"))


def null_test(calendar: DataFrame, statistic: packed.Statistic, observed: DataFrame, n_boot: int, blocks: Sequence[int], seed: int, alternative: str = "two-sided", keys: Sequence[str] = KEYS) -> DataFrame:
    """Null test of any statistic: its replicates against `observed` (keys, observed)."""
    stats = packed.replicate_stats(calendar, n_boot, blocks, seed, [statistic], keys, statistic.value)
    return null_p(stats.withColumnRenamed(statistic.names[0], "stat"), observed, n_boot, keys, alternative)


def null_test_h(calendar: DataFrame, label: str, n_labels: int, n_boot: int, blocks: Sequence[int], seed: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Omnibus null test: pooled values resampled against fixed destination labels."""
    return null_test(calendar, packed.kruskal(label, n_labels), observed_h(calendar, label, keys=keys), n_boot, blocks, seed, "greater", keys)


def null_test_u(calendar: DataFrame, label: str, a, b, n_boot: int, blocks: Sequence[int], seed: int, biserial: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    observed = observed_u(calendar, label, a, b, biserial, keys=keys)
    return null_test(calendar, packed.rank_sums(label, [(a, b)], biserial), observed, n_boot, blocks, seed, keys=keys)


def centred(calendar: DataFrame, statistic: str, value: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    centre = point_estimate(calendar, statistic, value, keys)
    return calendar.join(centre, list(keys)).withColumn(value, F.col(value) - F.col("point")).drop("point")


def null_imposed_location(calendar: DataFrame, mu: float, statistic: str, n_boot: int, blocks: Sequence[int], seed: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Location test with the null imposed: values are centred, noise is resampled.

    statistic is t (centred at the mean) or signed_rank (centred at the median);
    the signed-rank statistic is the positive rank sum on both sides.
    """
    keys = list(keys)
    noise = centred(calendar, "mean" if statistic == "t" else "median", keys=keys)
    own = packed.student() if statistic == "t" else packed.signed_ranks()
    return null_test(noise, own, observed_location(calendar, mu, statistic, keys), n_boot, blocks, seed, keys=keys)


def observed_location(calendar: DataFrame, mu: float, statistic: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The t of the mean against mu, or the positive rank sum of the differences from mu."""
    if statistic == "t":
        t = F.try_divide((F.avg("value") - mu) * F.sqrt(F.count("value")), F.stddev_samp("value"))
        return calendar.groupBy(*keys).agg(t.alias("observed"))
    return signed_rank(calendar, mu, keys=keys).select(*keys, F.col("w_plus").alias("observed"))


def percentile_pvalue(calendar: DataFrame, mu: float, statistic: str, n_boot: int, block: int, seed: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of replicates at least as far from the estimate as mu is."""
    keys = list(keys)
    dense = compact_calendar(calendar, keys=keys)
    stats = packed.replicate_stats(dense, n_boot, [block], seed, [packed.named(statistic)], keys)
    point = point_estimate(calendar, statistic, "value", keys)
    far = F.abs(F.col("stat") - F.col("point")) >= F.abs(F.lit(float(mu)) - F.col("point"))
    return stats.join(point, keys).groupBy(*keys, "point").agg(((1 + F.count_if(far)) / (n_boot + 1)).alias("p_value"))


def dense_null_test(calendar: DataFrame, statistic: str, n_boot: int, block: int, seed: int, label: str | None = None, n_labels: int = 0, a=None, b=None, mu: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same tests for a series without gaps; a missing value is refused."""
    if calendar.filter("value is null").take(1):
        raise ValueError("dense_null_test needs a series without gaps")
    if statistic == "h":
        return null_test_h(calendar, label, n_labels, n_boot, [block], seed, keys)
    if statistic == "u":
        return null_test_u(calendar, label, a, b, n_boot, [block], seed, keys=keys)
    return null_imposed_location(calendar, mu, statistic, n_boot, [block], seed, keys)


def group_windows(calendar: DataFrame, label: str, block: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Resampling windows inside each group's contiguous calendar segments, with cumulative probability.

    A window is `block` consecutive days of one segment (the whole segment where
    it is shorter) holding at least one observation. A segment weighs its
    observations divided by the mean observations per window.
    """
    keys = list(keys)
    g = [*keys, label]
    seg = runs(calendar.select(*keys, "pos", "value", label), keys, "pos", F.col(label), size=None)
    ahead = W.partitionBy(*g, "run_first").orderBy("pos").rangeBetween(0, block - 1)
    seen = F.count("value").over(ahead)
    usable = F.col("pos") <= F.col("run_last") - F.least(F.lit(block), F.col("run_len")) + 1
    wins = seg.withColumn("_obs", seen).filter(usable & (F.col("_obs") > 0))
    per_seg = seg.groupBy(*g, "run_first").agg(F.count("value").alias("_segobs"))
    means = wins.groupBy(*g, "run_first").agg(F.avg("_obs").alias("_mean"), F.count(F.lit(1)).alias("_k"))
    w = means.join(per_seg, [*g, "run_first"]).withColumn("_weight", F.col("_segobs") / F.col("_mean"))
    total = w.groupBy(*g).agg(F.sum("_weight").alias("_total"), F.sum("_segobs").alias("n_target"))
    share = w.join(total, g).select(*g, "run_first", "n_target", (F.col("_weight") / F.col("_total") / F.col("_k")).alias("_p"))
    cum = W.partitionBy(*g).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    out = wins.join(share, [*g, "run_first"]).withColumn("_hi", F.sum("_p").over(cum))
    prev = F.lag("_hi", 1, 0.0).over(W.partitionBy(*g).orderBy("pos"))
    last = F.lead("pos").over(W.partitionBy(*g).orderBy("pos")).isNull()
    return out.withColumns({"_lo": prev, "_hi": F.when(last, 1.0).otherwise(F.col("_hi"))}).select(
        *g, F.col("pos").alias("start"), F.least(F.lit(block), F.col("run_len")).alias("len"), "_obs", "n_target", "_lo", "_hi"
    )


def group_replicates(calendar: DataFrame, label: str, block: int, n_boot: int, seed: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Observed values of each group's replicates as rows; every replicate has the group's own observed count."""
    return packed_groups(calendar, label, block, n_boot, seed, keys).select(*keys, label, "b", F.explode("values").alias("value"))


def packed_groups(calendar: DataFrame, label: str, block: int, n_boot: int, seed: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same with one row per replicate and its values as an array."""
    windows = group_windows(calendar, label, block, keys)
    return packed.window_replicates(windows, calendar, n_boot, seed, keys, [*keys, label])


def array_statistic(statistic: str) -> Column:
    """Median or mean of the array `values`."""
    if statistic not in ("median", "mean"):
        raise ValueError(f"statistic must be median or mean, got {statistic!r}")
    n, s = F.size("values"), F.array_sort("values")
    if statistic == "mean":
        return F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / n
    low, high = (F.element_at(s, F.floor((n + k) / 2).cast("int")) for k in (1, 2))
    return low + (high - low) * 0.5


def contrast_ci(calendar: DataFrame, label: str, pairs: Sequence[tuple], statistic: str, block: int, n_boot: int, seed: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Interval of statistic(A) - statistic(B), each group resampled inside its own segments.

    Where the percentile interval misses the point estimate, the symmetric
    interval of absolute deviations is reported instead.
    """
    keys = list(keys)
    reps = packed_groups(calendar, label, block, n_boot, seed, keys)
    stat = reps.select(*keys, label, "b", array_statistic(statistic).alias("stat"))
    points = point_estimate(calendar.filter(F.col(label).isNotNull()), statistic, "value", [*keys, label])
    both = F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("z")) for x, y in pairs])).alias("_p")
    base = calendar.select(*keys).distinct().select(*keys, both).select(*keys, "_p.*")

    def side(df, tag, col):
        return df.select(*keys, F.col(label).alias(tag), *([F.col("b")] if "b" in df.columns else []), F.col(col).alias(f"_{col}_{tag}"))

    diffs = base.join(side(stat, "a", "stat"), [*keys, "a"]).join(side(stat, "z", "stat"), [*keys, "z", "b"])
    pts = base.join(side(points, "a", "point"), [*keys, "a"]).join(side(points, "z", "point"), [*keys, "z"])
    pts = pts.select(*keys, "a", "z", (F.col("_point_a") - F.col("_point_z")).alias("point"))
    k = [*keys, "a", "z"]
    joined = diffs.withColumn("stat", F.col("_stat_a") - F.col("_stat_z")).join(pts, k)
    agg = joined.groupBy(*k).agg(
        F.max("point").alias("point"),
        F.count("stat").alias("n_replicates"),
        F.percentile("stat", F.lit(0.025)).alias("_lo"),
        F.percentile("stat", F.lit(0.975)).alias("_hi"),
        F.percentile(F.abs(F.col("stat") - F.col("point")), F.lit(0.95)).alias("_half"),
        F.stddev_samp("stat").alias("replicate_sd"),
    )
    inside = F.col("point").between(F.col("_lo"), F.col("_hi"))
    return agg.select(
        *keys,
        F.col("a").alias("group_a"),
        F.col("z").alias("group_b"),
        "point",
        F.when(inside, F.col("_lo")).otherwise(F.col("point") - F.col("_half")).alias("ci_low"),
        F.when(inside, F.col("_hi")).otherwise(F.col("point") + F.col("_half")).alias("ci_high"),
        F.when(inside, "percentile").otherwise("symmetric_absolute_deviation").alias("ci_method"),
        "n_replicates",
        "replicate_sd",
    )
