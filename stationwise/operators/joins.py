"""Joins, set comparisons and table reconciliation.

No side is force-broadcast: dimension tables become broadcast joins through
Spark's own size checks, anything larger stays a shuffle join with skew handling.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from .sequence import hour_number


def station_lookup(df: DataFrame, dim: DataFrame, source: str, blocked: DataFrame | None = None) -> DataFrame:
    """Source id to station record; blocked ids are removed, unknown ids keep a verdict."""
    base = df if blocked is None else df.join(blocked, source, "left_anti")
    marked = dim.withColumn("_known", F.lit(True))
    return base.join(marked, source, "left").withColumn(
        "lookup_status", F.when(F.col("_known"), "resolved").otherwise("unknown")
    ).drop("_known")


def stations_in_bounds(df: DataFrame, dim: DataFrame, box) -> DataFrame:
    """One verdict per station of the data: ok, out_of_bounds or unknown_station."""
    per_station = df.groupBy(S.STATION).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = per_station.join(dim.select(S.STATION, "lat", "lon", F.lit(True).alias("_known")), S.STATION, "left")
    return joined.select(
        S.STATION,
        "n_rows",
        F.when(F.col("_known").isNull(), "unknown_station")
        .when(fn.in_box("lat", "lon", box), "ok")
        .otherwise("out_of_bounds")
        .alias("verdict"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unique_rows(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """df with one row per key; a repeated key fails the job that reads it. Null keys never join and are left out."""
    rest = [c for c in df.columns if c not in keys]
    whole = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    name = F.concat_ws(" ", F.lit(f"repeated {what}"), *[F.col(k).cast("string") for k in keys])
    # the check is part of the key, so no column selection prunes it away
    checked = F.when(F.col("_n") > 1, F.raise_error(name).cast(df.schema[keys[-1]].dataType)).otherwise(F.col(keys[-1]))
    return whole.withColumn(keys[-1], checked).select(*[k if k in keys else F.col(f"_r.{k}").alias(k) for k in df.columns])


def lookup_many_to_one(df: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that can't multiply rows: a repeated key of the dimension fails the job."""
    return df.join(unique_rows(dim, keys, "lookup key"), list(keys), "left")


def join_air_weather(
    air: DataFrame, weather: DataFrame, check: bool = False
) -> DataFrame:
    """Left join of weather on (station, time), or on time where weather has no station.

    Column collisions raise at plan time, and a repeated weather key fails the job. With
    check=True duplicate keys on either side raise at once; that costs one aggregate per side.
    """
    keys = [S.STATION, S.TIME] if S.STATION in weather.columns else [S.TIME]
    clash = (set(air.columns) & set(weather.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    if check:
        for side, cols in ((air, [S.STATION, S.TIME]), (weather, keys)):
            if duplicate_keys(side, cols).take(1):
                raise ValueError(f"duplicate keys {cols}")
    weather = unique_rows(weather.withColumn("weather_matched", F.lit(True)), keys, "weather key")
    return air.join(weather, keys, "left").withColumn(
        "weather_matched", F.coalesce("weather_matched", F.lit(False))
    )


def match_coverage(joined: DataFrame, weather_columns: Sequence[str]) -> DataFrame:
    return joined.groupBy(S.STATION).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("weather_matched").alias("n_matched"),
        (100.0 * F.count_if("weather_matched") / F.count(F.lit(1))).alias("match_pct"),
        *[(F.count(c) == 0).alias(f"{c}_all_null") for c in weather_columns],
    )


def humidity_by_lookup(air: DataFrame, weather: DataFrame) -> DataFrame:
    """Attach humidity by hour and flag hours above the limit; no row is dropped, none multiplied: a repeated hour fails the job."""
    repeated = F.raise_error(F.concat(F.lit("repeated weather hour "), F.coalesce(F.col(S.TIME).cast("string"), F.lit("null"))))
    dim = weather.groupBy(S.TIME).agg(F.max("relative_humidity").alias("_rh"), F.count(F.lit(1)).alias("_n"))
    dim = dim.select(S.TIME, F.when((F.col("_n") > 1) & F.col(S.TIME).isNotNull(), repeated.cast("double")).otherwise(F.col("_rh")).alias("_rh"))
    return air.join(dim, S.TIME, "left").withColumn("is_high_humidity", fn.humidity_flag("_rh")).drop("_rh")


def overlap_coverage(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """How much of two series overlaps, with per-column missing shares on the overlap.

    Both sides are first reduced to one row per key, so a repeated key cannot
    multiply; the row-explosion count is derived from the multiplicities.
    """
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_na"))
    b = right.groupBy(key).agg(
        F.count(F.lit(1)).alias("_nb"), *[F.count(c).alias(f"_ok_{c}") for c in columns]
    )
    both = a.join(b, key, "full_outer")
    inner = F.col("_na").isNotNull() & F.col("_nb").isNotNull()
    rows = F.when(inner, F.col("_na") * F.col("_nb")).otherwise(0)
    return both.agg(
        F.sum(F.coalesce("_na", F.lit(0))).alias("n_left"),
        F.sum(F.coalesce("_nb", F.lit(0))).alias("n_right"),
        F.sum(rows).alias("n_overlap"),
        F.try_divide(100.0 * F.count_if(inner), F.count("_na")).alias("overlap_pct"),
        (F.sum(rows) > F.greatest(F.sum(F.coalesce("_na", F.lit(0))), F.sum(F.coalesce("_nb", F.lit(0))))).alias(
            "row_explosion"
        ),
        *[
            (100.0 - F.try_divide(100.0 * F.sum(F.when(inner, F.col(f"_ok_{c}") * F.col("_na"))), F.sum(rows))).alias(
                f"missing_pct_{c}"
            )
            for c in columns
        ],
    )


def value_at_offset(df: DataFrame, hours: int, value: str, name: str, keys: Sequence[str] = (S.STATION,)) -> DataFrame:
    """Value exactly `hours` earlier by timestamp (negative: later); NULL where that hour is absent."""
    moved = df.select(
        *keys,
        F.timestamp_seconds(F.unix_seconds(S.TIME) + hours * 3600).alias(S.TIME),
        F.col(value).alias(name),
    )
    return df.join(moved, [*keys, S.TIME], "left")


def horizon_label(df: DataFrame, label: str, hours: int, cut: str) -> DataFrame:
    """Label at t + h by timestamp; training rows whose label falls in the test span are purged."""
    cut_ts = F.lit(cut).cast("timestamp")
    ahead = value_at_offset(df, -hours, label, "future_label")
    reaches = F.timestamp_seconds(F.unix_seconds(S.TIME) + hours * 3600) >= cut_ts
    return ahead.withColumn("part", F.when(F.col(S.TIME) < cut_ts, "train").otherwise("test")).filter(
        ~((F.col("part") == "train") & reaches)
    )


def cell_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column: fabricated, mutated, lost and unchanged cells between two unique-keyed tables."""
    a = before.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = after.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = a.join(b, list(keys), "full_outer")
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(f"_a_{c}").alias("old"), F.col(f"_b_{c}").alias("new"))
                for c in columns
            ]
        )
    ).alias("_p")
    long = both.select(pairs).select("_p.*")
    close = F.abs(F.col("new") - F.col("old")) <= 1e-8 + 1e-5 * F.abs("old")
    return long.groupBy("column").agg(
        F.count_if(F.col("old").isNull() & F.col("new").isNotNull()).alias("fabricated"),
        F.count_if(F.col("old").isNotNull() & F.col("new").isNull()).alias("lost"),
        F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull() & ~close).alias("mutated"),
        F.count_if(close).alias("unchanged"),
    )


def reconcile(
    reported: DataFrame,
    recomputed: DataFrame,
    keys: Sequence[str],
    exact: Sequence[str] = (),
    close: Sequence[str] = (),
    rtol: float = 1e-9,
    atol: float = 1e-9,
) -> DataFrame:
    """Compare two result tables on keys; one count per column and verdict. NULL equals NULL."""
    a = reported.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in [*exact, *close]], F.lit(1).alias("_in_a"))
    b = recomputed.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in [*exact, *close]], F.lit(1).alias("_in_b"))
    both = a.join(b, list(keys), "full_outer")

    def verdict(c: str, tolerant: bool) -> Column:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        same = x.eqNullSafe(y)
        if tolerant:
            same = same | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False))
        return (
            F.when(F.col("_in_b").isNull(), "only_reported")
            .when(F.col("_in_a").isNull(), "only_recomputed")
            .when(same, "match")
            .otherwise("mismatch")
        )

    cells = [F.struct(F.lit(c).alias("column"), verdict(c, False).alias("verdict")) for c in exact]
    cells += [F.struct(F.lit(c).alias("column"), verdict(c, True).alias("verdict")) for c in close]
    return (
        both.select(F.explode(F.array(*cells)).alias("_r"))
        .select("_r.*")
        .groupBy("column", "verdict")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_periods(df: DataFrame, time: str = S.TIME) -> DataFrame:
    """One row per period a reading belongs to: station, year, month and season; spans are half-open."""
    t = F.col(time)
    year, month = F.year(t), F.month(t)
    winter = month.isin(12, 1, 2)
    season_month = F.when(winter, 12).when(month < 6, 3).when(month < 9, 6).otherwise(9)
    start_year = F.when(winter & (month < 12), year - 1).otherwise(year)

    def span(kind, key, start: Column, months: int):
        return F.struct(
            kind.alias("period_type") if isinstance(kind, Column) else F.lit(kind).alias("period_type"),
            key.alias("period"),
            start.cast("timestamp").alias("period_start"),
            F.add_months(start, months).cast("timestamp").alias("period_end"),
        )

    none = F.lit(None).cast("timestamp")
    periods = F.array(
        F.struct(
            F.lit("station").alias("period_type"),
            F.lit("all").alias("period"),
            none.alias("period_start"),
            none.alias("period_end"),
        ),
        span("year", year.cast("string"), F.make_date(year, F.lit(1), F.lit(1)), 12),
        span("month", F.date_format(t, "yyyy-MM"), F.make_date(year, month, F.lit(1)), 1),
        span(
            F.when(winter, "winter_year").otherwise("season_year"),
            F.concat(fn.season_long(t), F.lit(":"), fn.season_year(t).cast("string")),
            F.make_date(start_year, season_month, F.lit(1)),
            3,
        ),
    )
    return df.withColumn("_p", F.explode(periods)).select(*df.columns, "_p.*")


def pairs_within(stations: DataFrame, group: str) -> DataFrame:
    """(station_a, station_b), a before b, of the stations that share a group: an equi-join on the group."""
    a = stations.select(group, F.col(S.STATION).alias("station_a")).distinct()
    b = a.withColumnRenamed("station_a", "station_b")
    return a.join(b, group).filter("station_a < station_b").select("station_a", "station_b").distinct()


def presence_pages(df: DataFrame) -> DataFrame:
    """Hours with a row as bitmaps, one per station and page of 32,768 hours."""
    hour = hour_number(S.TIME)
    return df.groupBy(S.STATION, F.bitmap_bucket_number(hour).alias("_page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(hour)).alias("_bits")
    )


def station_pair_overlap(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Overlap window, shared hours or gap hours for each given (station_a, station_b).

    Hours are reduced to bitmap pages before pairs are made of them, so a pair costs one
    row per page (nearly four years), not one per hour.
    """
    spans = df.groupBy(S.STATION).agg(F.min(S.TIME).alias("lo"), F.max(S.TIME).alias("hi"))
    a = spans.select(F.col(S.STATION).alias("station_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    b = spans.select(F.col(S.STATION).alias("station_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    base = pairs.join(a, "station_a").join(b, "station_b")
    pages = presence_pages(df)
    sides = F.explode(F.array("station_a", "station_b")).alias(S.STATION)
    both = pairs.select("station_a", "station_b", sides).join(pages, S.STATION).groupBy("station_a", "station_b", "_page").agg(
        F.bitmap_and_agg("_bits").alias("_bits"), F.count(F.lit(1)).alias("_sides")
    )
    shared = both.filter("_sides = 2").groupBy("station_a", "station_b").agg(F.sum(F.bitmap_count("_bits")).alias("_shared"))
    start, end = F.greatest("lo_a", "lo_b"), F.least("hi_a", "hi_b")
    overlaps = start <= end
    return base.join(shared, ["station_a", "station_b"], "left").select(
        "station_a",
        "station_b",
        overlaps.alias("has_overlap"),
        F.when(overlaps, start).alias("overlap_start"),
        F.when(overlaps, end).alias("overlap_end"),
        F.coalesce("_shared", F.lit(0)).alias("shared_hours"),
        F.when(overlaps, 0.0).otherwise((F.unix_seconds(start) - F.unix_seconds(end)) / 3600.0).alias("gap_hours"),
    )


def source_hours_in_grid(raw: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct raw hours that fall on the active grid; repeated readings do not hide gaps."""
    hours = raw.select(*keys).distinct()
    inside = hours.join(grid.select(*keys).distinct(), list(keys), "left_semi")
    return inside.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("source_hours"))


def compare_evidence(a: DataFrame, b: DataFrame, alpha: float = S.ALPHA) -> DataFrame:
    """Classify two stations' result rows per test by direction, interval overlap and decisions.

    Both inputs: test, estimate, ci_low, ci_high, holm_p.
    """
    return _classified(_side(a, "a", ["test"]).join(_side(b, "b", ["test"]), "test", "full_outer"), ["test"], alpha)


def compare_station_pairs(results: DataFrame, pairs: DataFrame, alpha: float = S.ALPHA) -> DataFrame:
    """compare_evidence for each (station_a, station_b) of a pair table, from one table of results by station."""
    k = ["station_a", "station_b", "test"]
    tests = results.select(F.col(S.STATION).alias("_s"), "test", *_EVIDENCE)
    sides = [
        _side(pairs.join(tests, pairs[f"station_{e}"] == F.col("_s")).drop("_s"), e, k) for e in "ab"
    ]
    return _classified(sides[0].join(sides[1], k, "full_outer"), k, alpha)


_EVIDENCE = ("estimate", "ci_low", "ci_high", "holm_p")


def _side(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in _EVIDENCE])


def _classified(j: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    cols = _EVIDENCE
    every = [f"{s}_{c}" for s in "ab" for c in cols]
    bad = F.lit(False)
    for c in every:
        bad = bad | F.col(c).isNull() | F.isnan(c) | fn.is_nonfinite(c)
    seasonal = F.col("test") == "season_effect"
    same = (F.signum("a_estimate") == F.signum("b_estimate")) & (F.col("a_estimate") != 0)
    overlap = F.greatest("a_ci_low", "b_ci_low") <= F.least("a_ci_high", "b_ci_high")
    ra, rb = F.col("a_holm_p") < alpha, F.col("b_holm_p") < alpha
    usable = ~seasonal & ~bad
    # The classification labels.
    return j.select(
        *keys,
        F.when(seasonal, "EXPLORATORY / INCOMPARABLE")
        .when(bad, "UNVERIFIED")
        .when(~same, "INCOMPARABLE (effect direction differs across physical stations)")
        .when(ra & rb & overlap, "CONCORDANT DIRECTION; OVERLAPPING CI")
        .when(ra & rb, "CONCORDANT DIRECTION; DIFFERENT MAGNITUDE")
        .when(ra | rb, "WEAKENED / NOT REPLICATED AT ONE STATION")
        .otherwise("NO EVIDENCE OF EFFECT IN EITHER STATION")
        .alias("classification"),
        F.when(usable, same).alias("same_direction"),
        F.when(usable, overlap).alias("ci_overlap"),
    )
