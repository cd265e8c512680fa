"""Dense time axes, gap analysis, masking and short-gap interpolation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from .ranks import cumulative_counts, quantiles
from .sequence import CHUNK, hour_number, runs, windowed


def hourly_grid(
    df: DataFrame,
    attributes: Sequence[str] = (),
    window: tuple[str, str] | None = None,
    max_pad_hours: int | None = None,
) -> DataFrame:
    """Every station on every hour of the common window; rows are added, never dropped.

    The axis is generated in two steps (weeks, then hours), so no task holds a
    whole axis. Attributes are copied onto added rows only. With max_pad_hours a
    station whose padding exceeds the limit raises.
    """
    S.require(df, [S.STATION, S.TIME], "hourly_grid")
    stations = df.groupBy(S.STATION).agg(
        F.min(S.TIME).alias("_first"),
        F.max(S.TIME).alias("_last"),
        *[F.min(a).alias(f"_attr_{a}") for a in attributes],
    )
    if window is None:
        everything = W.partitionBy(F.lit(0))
        spans = stations.withColumn("_lo", F.min("_first").over(everything)).withColumn(
            "_hi", F.max("_last").over(everything)
        )
    else:
        spans = stations.withColumn("_lo", F.lit(window[0]).cast("timestamp")).withColumn(
            "_hi", F.lit(window[1]).cast("timestamp")
        )
    if max_pad_hours is not None:
        pad = F.greatest(
            F.unix_seconds("_first") - F.unix_seconds("_lo"), F.unix_seconds("_hi") - F.unix_seconds("_last")
        ) / 3600
        over = spans.filter(pad > max_pad_hours).select(S.STATION).take(1)
        if over:
            raise ValueError(f"padding beyond {max_pad_hours} h at station {over[0][0]}")
    weeks = spans.withColumn("_week", F.explode(F.expr("sequence(_lo, _hi, interval 168 hours)")))
    hours = weeks.select(
        S.STATION,
        *[f"_attr_{a}" for a in attributes],
        F.explode(
            F.expr("sequence(_week, least(_hi, _week + interval 167 hours), interval 1 hour)")
        ).alias(S.TIME),
    )
    rest = [c for c in df.columns if c not in (S.STATION, S.TIME)]
    joined = hours.join(df.withColumn("_present", F.lit(True)), [S.STATION, S.TIME], "left")
    return joined.select(
        S.STATION,
        S.TIME,
        *[
            F.when(F.col("_present"), F.col(c)).otherwise(F.col(f"_attr_{c}")).alias(c)
            if c in attributes
            else F.col(c)
            for c in rest
        ],
    )


def grid_inserted(df: DataFrame, gridded: DataFrame) -> DataFrame:
    """Rows before, after and inserted per station."""
    before = df.groupBy(S.STATION).agg(F.count(F.lit(1)).alias("n_observed"))
    after = gridded.groupBy(S.STATION).agg(F.count(F.lit(1)).alias("n_grid"))
    return after.join(before, S.STATION, "left").select(
        S.STATION,
        "n_grid",
        F.coalesce("n_observed", F.lit(0)).alias("n_observed"),
        (F.col("n_grid") - F.coalesce("n_observed", F.lit(0))).alias("n_inserted"),
    )


def with_runs(df: DataFrame, state: Column, size: int = CHUNK) -> DataFrame:
    """Hourly runs of equal state per station, with run_first/run_last in hour numbers."""
    return runs(df.withColumn("_hour", hour_number(S.TIME)), [S.STATION], "_hour", state, size).drop("_hour")


def _as_time(hour: str) -> Column:
    return F.timestamp_seconds(F.col(hour) * 3600)


def stuck_sensor(df: DataFrame, value: str = S.TARGET, limit: int = S.STUCK_HOURS, size: int = CHUNK) -> DataFrame:
    """Constant non-null runs longer than the limit become NULL and are flagged."""
    r = with_runs(df, F.col(value), size)
    stuck = F.col(value).isNotNull() & (F.col("run_len") > limit)
    return (
        r.withColumn("is_stuck", stuck.cast("int"))
        .withColumn(value, F.when(~stuck, F.col(value)))
        .drop("run_first", "run_last", "run_len")
    )


def prolonged_missing(df: DataFrame, value: str = S.TARGET, limit: int = S.LONG_GAP_HOURS, size: int = CHUNK) -> DataFrame:
    """Flag rows inside NULL runs longer than the limit."""
    r = with_runs(df, F.col(value).isNull(), size)
    return r.withColumn(
        "is_long_gap", (F.col(value).isNull() & (F.col("run_len") > limit)).cast("int")
    )


def prolonged_missing_stats(df: DataFrame, value: str = S.TARGET, limit: int = S.LONG_GAP_HOURS) -> DataFrame:
    flagged = prolonged_missing(df, value, limit)
    first = F.col("run_first") == hour_number(S.TIME)
    return flagged.groupBy(S.STATION).agg(
        F.sum("is_long_gap").alias("flagged_hours"),
        F.count_if((F.col("is_long_gap") == 1) & first).alias("n_blocks"),
        F.max(F.when(F.col("is_long_gap") == 1, F.col("run_len"))).alias("longest_block"),
    )


def missing_runs(df: DataFrame, value: str = S.TARGET, min_span: int = 1, size: int = CHUNK) -> DataFrame:
    """One row per NULL run, taken from the run's first row, so runs are never regrouped."""
    r = with_runs(df, F.col(value).isNull(), size)
    return r.filter(
        F.col(value).isNull()
        & (F.col("run_first") == hour_number(S.TIME))
        & (F.col("run_len") >= min_span)
    ).select(
        S.STATION,
        _as_time("run_first").alias("run_start"),
        _as_time("run_last").alias("run_end"),
        F.col("run_len").alias("gap_hours"),
        F.year(_as_time("run_first")).alias("year"),
        fn.season(_as_time("run_first")).alias("season"),
    )


def top_outages(df: DataFrame, k: int, cut: str, value: str = S.TARGET) -> DataFrame:
    """Longest k NULL runs with the split they touch."""
    cut_ts = F.lit(cut).cast("timestamp")
    return (
        missing_runs(df, value)
        .withColumn(
            "split_tag",
            F.when(F.col("run_end") < cut_ts, "train")
            .when(F.col("run_start") >= cut_ts, "test")
            .otherwise("train+test"),
        )
        .orderBy(F.desc("gap_hours"), S.STATION, "run_start")
        .limit(k)
    )


def missing_histogram(df: DataFrame, value: str = S.TARGET) -> DataFrame:
    return (
        missing_runs(df, value)
        .groupBy(S.STATION, "gap_hours")
        .agg(F.count(F.lit(1)).alias("n_runs"))
        .withColumn("kind", F.when(F.col("gap_hours") == 1, "isolated").otherwise("outage"))
        .withColumn("hours", F.col("gap_hours") * F.col("n_runs"))
    )


def zero_streaks(df: DataFrame, value: str = S.TARGET, threshold: int = S.STUCK_HOURS, size: int = CHUNK) -> DataFrame:
    """Runs of exact zero at least as long as the threshold."""
    r = with_runs(df, F.coalesce(F.col(value) == 0, F.lit(False)), size)
    return r.filter(
        (F.col(value) == 0) & (F.col("run_first") == hour_number(S.TIME)) & (F.col("run_len") >= threshold)
    ).select(
        S.STATION,
        _as_time("run_first").alias("run_start"),
        _as_time("run_last").alias("run_end"),
        F.col("run_len").alias("streak_hours"),
    )


def with_step(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """Hours since the station's previous row, however long ago that was."""
    hours = F.unix_micros(S.TIME) / 3.6e9
    src = df.withColumn("_hour", hour_number(S.TIME)).withColumn("_exact", hours)
    lagged = windowed(src, [S.STATION], "_hour", {"_near": lambda w: F.lag("_exact").over(w)}, size=size)
    # the row that opens a chunk takes its predecessor from the closing rows of earlier chunks
    chunk = F.floor(F.col("_hour") / size)
    closing = src.groupBy(S.STATION, chunk.alias("_c")).agg(
        F.max_by("_exact", "_hour").alias("_close")
    )
    prior = closing.select(
        S.STATION, "_c", F.lag("_close").over(W.partitionBy(S.STATION).orderBy("_c")).alias("_prior")
    )
    return (
        lagged.withColumn("_c", chunk)
        .join(prior, [S.STATION, "_c"], "left")
        .withColumn("step_hours", F.col("_exact") - F.coalesce("_near", "_prior"))
        .drop("_c", "_near", "_prior", "_exact", "_hour")
    )


def sampling_profile(df: DataFrame) -> DataFrame:
    """Step statistics per station."""
    steps = with_step(df)
    med = quantiles(steps, [S.STATION], "step_hours", {"median_step": 0.5})
    stats = steps.groupBy(S.STATION).agg(
        F.count("step_hours").alias("n_steps"),
        F.avg("step_hours").alias("mean_step"),
        F.min("step_hours").alias("min_step"),
        F.max("step_hours").alias("max_step"),
        F.try_divide(100.0 * F.count_if(F.col("step_hours") == 1), F.count("step_hours")).alias("exact_hour_pct"),
        F.count_if(F.col("step_hours") != 1).alias("n_irregular"),
    )
    return stats.join(med, S.STATION, "left")


def interpolate_short_gaps(
    df: DataFrame,
    value: str = S.TARGET,
    max_gap: int = 2,
    keys: Sequence[str] = (S.STATION, "split"),
    size: int = CHUNK,
) -> DataFrame:
    """Linear fill of interior NULL runs up to max_gap, into a separate derived column.

    Needs a dense hourly axis inside each key; a missing or repeated hour fails the job. A
    fillable gap reaches at most max_gap + 1 hours either way, so the nearest observed
    neighbours come from a short halo and nothing travels further.
    """
    reach = max_gap + 1
    seen_pos = F.when(F.col(value).isNotNull(), F.col("_hour"))

    def near(w, c, forward):
        frame = w.rangeBetween(-reach, -1) if forward else w.rangeBetween(1, reach)
        pick = F.last if forward else F.first
        return pick(c, ignorenulls=True).over(frame)

    src = df.withColumn("_hour", hour_number(S.TIME))
    axis = src.groupBy(*keys).agg((F.max("_hour") - F.min("_hour") + 1 - F.count(F.lit(1))).alias("_off"), F.count_distinct("_hour").alias("_d"), F.count(F.lit(1)).alias("_n"))
    uneven = axis.agg(F.count_if((F.col("_off") != 0) | (F.col("_d") != F.col("_n"))).alias("bad")).scalar()
    out = windowed(
        src,
        list(keys),
        "_hour",
        {
            "_v0": lambda w: near(w, value, True),
            "_p0": lambda w: near(w, seen_pos, True),
            "_v1": lambda w: near(w, value, False),
            "_p1": lambda w: near(w, seen_pos, False),
        },
        back=reach,
        ahead=reach,
        size=size,
    )
    gap = F.col("_p1") - F.col("_p0") - 1
    weight = (F.col("_hour") - F.col("_p0")) / (F.col("_p1") - F.col("_p0"))
    fillable = F.col(value).isNull() & (gap <= max_gap)
    derived = F.when(F.col(value).isNotNull(), F.col(value)).when(
        fillable, F.col("_v0") + (F.col("_v1") - F.col("_v0")) * weight
    )
    derived = F.when(uneven > 0, F.raise_error(F.lit("interpolation needs one row per hour")).cast("double")).otherwise(derived)
    return (
        out.withColumn(f"{value}_derived", derived)
        .withColumn("is_derived", F.col(value).isNull() & F.col(f"{value}_derived").isNotNull())
        .drop("_hour", "_v0", "_p0", "_v1", "_p1")
    )


def mask_random(df: DataFrame, fraction: float, seed: int, value: str = S.TARGET) -> DataFrame:
    """Hold out a share of observed cells, at least one, chosen by a seeded hash.

    The hash threshold is found on the distribution of hashes (value counts),
    so the choice needs no global sort of the rows.
    """
    tagged = df.withColumn(
        "_draw",
        F.when(F.col(value).isNotNull(), fn.draw32(F.lit(seed), F.col(S.STATION), F.unix_seconds(S.TIME)).cast("double")),
    )
    cum = cumulative_counts(tagged, [], "_draw", bucket=F.floor(F.col("_draw") / (1 << 20)).cast("long"))
    held = F.greatest(F.lit(1), F.round(F.col("n") * fraction))
    cut = cum.filter(F.col("below") < held).agg(F.max("_draw").alias("cut"))
    return tagged.withColumn("held_out", F.coalesce(F.col("_draw") <= cut.scalar(), F.lit(False))).drop("_draw")


def mask_contiguous(
    df: DataFrame,
    gap: int,
    per_group: int,
    seed: int,
    value: str = S.TARGET,
    keys: Sequence[str] = (S.STATION, "split"),
    size: int = CHUNK,
) -> DataFrame:
    """Hold out non-overlapping interior gaps with observed neighbours on both sides.

    Every hour that begins a legal gap is considered, in the order of its seeded
    hash; one is taken unless it lies within `gap` hours of one taken before. A
    taken start rules out at most 2 * gap others, so the first per_group * (2 * gap + 1)
    of a group hold all that can be taken. Returns one row per start.
    """
    seen = F.col(value).isNotNull().cast("int")
    src = df.withColumn("_hour", hour_number(S.TIME)).withColumn("_seen", seen)
    framed = windowed(
        src,
        list(keys),
        "_hour",
        {
            "_around": lambda w: F.sum("_seen").over(w.rangeBetween(-1, gap)),
            "_before": lambda w: F.sum("_seen").over(w.rangeBetween(-1, -1)),
        },
        back=1,
        ahead=gap,
        size=size,
    )
    starts = framed.filter(F.col("_around") == gap + 2).withColumn(
        "_draw", fn.draw32(F.lit(seed), F.lit(gap), F.col(S.STATION), F.col("_hour"))
    )
    best = W.partitionBy(*keys).orderBy("_draw", "_hour")
    first = starts.withColumn("_pick", F.row_number().over(best)).filter(F.col("_pick") <= per_group * (2 * gap + 1))
    one = F.struct("_pick", F.col("_hour").cast("long").alias("_hour"), F.col(S.TIME).alias("_time"))
    listed = first.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("_starts"))
    taken = F.aggregate(
        "_starts",
        F.filter("_starts", lambda x: F.lit(False)),
        lambda acc, x: F.when(
            (F.size(acc) < per_group) & ~F.exists(acc, lambda y: F.abs(y["_hour"] - x["_hour"]) <= gap),
            F.concat(acc, F.array(x)),
        ).otherwise(acc),
    )
    return listed.select(*keys, F.explode(taken).alias("_s")).select(
        *keys, F.col("_s._time").alias("gap_start"), F.lit(gap).alias("gap_hours")
    )


def interpolation_scores(
    df: DataFrame,
    gaps: Sequence[int],
    max_gaps: Sequence[int],
    per_group: int,
    seed: int,
    value: str = S.TARGET,
) -> DataFrame:
    """Recovery and error of short-gap interpolation over masked cells.

    A masked gap has observed, unmasked hours on both sides, so its neighbourhood of
    gap + 2 hours is all that interpolation sees. Only these are looked up, by an equi-join
    with the table; every max_gap setting scores them in the same job. Totals over seasons
    come from grouping sets.
    """
    k = [S.STATION, "split"]
    starts = reduce(DataFrame.unionByName, [mask_contiguous(df, g, per_group, seed, value) for g in gaps])
    near = starts.withColumn("_k", F.explode(F.sequence(F.lit(-1), F.col("gap_hours"))))
    near = near.withColumn(S.TIME, F.timestamp_seconds(F.unix_seconds("gap_start") + F.col("_k") * 3600))
    cells = near.join(df.select(*k, S.TIME, F.col(value).alias("truth")), [*k, S.TIME])
    at = lambda c: F.max(F.when(c, F.col("truth")))
    inside = (F.col("_k") >= 0) & (F.col("_k") < F.col("gap_hours"))
    held = cells.groupBy(*k, "gap_hours", "gap_start").agg(
        at(F.col("_k") < 0).alias("_v0"),
        at(F.col("_k") == F.col("gap_hours")).alias("_v1"),
        F.collect_list(F.when(inside, F.struct("_k", S.TIME, "truth"))).alias("_cells"),  # gap_hours of them
    )
    rows = held.select("*", F.explode("_cells").alias("_c")).select(*k, "gap_hours", "_v0", "_v1", "_c.*")
    scored = rows.withColumn("max_gap", F.explode(F.array(*map(F.lit, max_gaps)))).withColumn(
        "seen_derived",
        F.when(F.col("gap_hours") <= F.col("max_gap"), F.col("_v0") + (F.col("_v1") - F.col("_v0")) * ((F.col("_k") + 1) / (F.col("gap_hours") + 1))),
    )
    err = F.col("seen_derived") - F.col("truth")
    return (
        scored.withColumn("season", fn.season(S.TIME))
        .groupingSets(
            [["station_id", "gap_hours", "max_gap", "season"], ["station_id", "gap_hours", "max_gap"]],
            "station_id",
            "gap_hours",
            "max_gap",
            "season",
        )
        .agg(
            F.count("truth").alias("n_masked"),
            F.count("seen_derived").alias("n_recovered"),
            (100.0 * F.count("seen_derived") / F.count("truth")).alias("recovery_pct"),
            F.avg(F.abs(err)).alias("mae"),
            F.sqrt(F.avg(err * err)).alias("rmse"),
            F.avg(err).alias("bias"),
        )
        .withColumn("season", F.coalesce("season", F.lit("ALL")))
    )
