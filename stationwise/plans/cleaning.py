"""Cleaning chains: one lazy plan per table, with step counts and a proof that nothing was invented."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from ..operators import clean, grid, joins, quality
from ..session import written
from ..sources import tables

KEY = [S.STATION, S.TIME]


def air_observations(raw: DataFrame, order: str) -> DataFrame:
    """First record per (station, hour), text values parsed, physical rules applied.

    raw: station_id, timestamp, pm25 and pm10 as text, and an ingest order column.
    """
    S.require(raw, [*KEY, "pm25", "pm10", order], "air input")
    first = clean.first_wins(raw.select(*KEY, order, "pm25", "pm10"), KEY, [order])
    parsed = first.select(*KEY, *[fn.nonnegative(fn.undisguised(c)).alias(c) for c in ("pm25", "pm10")])
    return clean.enforce_subset(parsed, "pm25", "pm10")


def clean_air(raw: DataFrame, weather: DataFrame, order: str) -> DataFrame:
    """Dedup, markers, physical rules, fine <= coarse, grid, stuck values, long gaps, humidity flag.

    Order matters: a stuck run turns into missing values before long gaps are
    flagged, and the humidity flag comes last because it never removes a row.
    """
    gridded = grid.hourly_grid(air_observations(raw, order))
    unstuck = grid.stuck_sensor(gridded)
    flagged = grid.prolonged_missing(unstuck).drop("run_first", "run_last", "run_len")
    return joins.humidity_by_lookup(flagged, weather)


def air_step_counts(raw: DataFrame, cleaned: DataFrame, order: str) -> DataFrame:
    """What each step removed, per station."""
    key_counts = raw.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_c"))
    dup = key_counts.groupBy(S.STATION).agg(F.sum("_c").alias("n_input"), F.count(F.lit(1)).alias("n_keys"))
    out = cleaned.groupBy(S.STATION).agg(
        F.count(F.lit(1)).alias("n_grid"),
        F.count("pm25").alias("n_observed"),
        F.sum("is_stuck").alias("n_stuck"),
        F.sum("is_long_gap").alias("n_long_gap"),
        F.sum("is_high_humidity").alias("n_high_humidity"),
    )
    return out.join(dup, S.STATION, "left").withColumns(
        {
            "n_duplicates": F.col("n_input") - F.col("n_keys"),
            "n_inserted": F.col("n_grid") - F.col("n_keys"),
        }
    )


def imputation_proof(raw: DataFrame, cleaned: DataFrame, order: str) -> DataFrame:
    """Cell comparison of the cleaned table with the first raw records: fabricated and mutated must be 0."""
    first = clean.first_wins(raw.select(*KEY, order, "pm25", "pm10"), KEY, [order]).select(
        *KEY, *[fn.parsed_number(c).alias(c) for c in ("pm25", "pm10")]
    )
    return joins.cell_diff(first, cleaned.select(*KEY, "pm25", "pm10"), KEY, ["pm25", "pm10"])


def clean_weather(raw: DataFrame, order: str) -> DataFrame:
    """First record per hour, bounds per variable, dense hourly axis; absent hours stay NULL."""
    first = clean.first_wins(raw.select(S.TIME, order, *S.WEATHER_VARIABLES), [S.TIME], [order])
    bounded = first.select(
        F.lit("weather").alias(S.STATION), S.TIME, *[fn.within_weather_bounds(c, c).alias(c) for c in S.WEATHER_VARIABLES]
    )
    return grid.hourly_grid(bounded).drop(S.STATION)


def deterministic_cleaning(air_raw: DataFrame, weather_raw: DataFrame, order: str, path: str) -> DataFrame:
    """Clean both tables, prove and validate, then write once; any failed verdict raises before writing.

    Returns the verdict rows together with the freeze record's row count.
    """
    weather = clean_weather(weather_raw, order)
    cleaned = clean_air(air_raw, weather, order)
    proof = imputation_proof(air_raw, cleaned, order).select(
        F.lit("ALL").alias(S.STATION),
        F.concat(F.lit("no_imputation_"), "column").alias("check"),
        (F.col("fabricated") + F.col("mutated")).alias("violations"),
        ((F.col("fabricated") + F.col("mutated")) == 0).alias("passed"),
    )
    verdict = written(proof.unionByName(quality.clean_validation(cleaned)), "verdict")
    failed = verdict.filter(~F.col("passed")).select("check").distinct().collect()
    if failed:
        raise ValueError(f"cleaning contract failed: {sorted(r[0] for r in failed)}")
    record = tables.freeze_table(cleaned, path)
    frozen = record.select(
        F.lit("ALL").alias(S.STATION),
        F.lit("frozen_rows").alias("check"),
        F.col("row_count").alias("violations"),
        F.lit(True).alias("passed"),
    )
    return verdict.unionByName(frozen)


def quality_audit(df: DataFrame, measures) -> DataFrame:
    """Six dimensions, uniqueness, gaps, zero streaks and joint missingness as (section, station, metric, value)."""
    def rows(part: DataFrame, section: str, metrics) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        key = F.col(S.STATION) if S.STATION in part.columns else F.lit("ALL")
        return part.select(key.alias(S.STATION), F.explode(cells).alias("_r")).select(
            F.lit(section).alias("section"), S.STATION, "_r.*"
        )

    six = quality.six_dimension_audit(df, measures).select(
        F.col("dimension").alias("section"), F.lit("ALL").alias(S.STATION), "metric", "value"
    )
    zero = grid.zero_streaks(df).groupBy(S.STATION).agg(
        F.count(F.lit(1)).alias("n_zero_streaks"), F.max("streak_hours").alias("longest_zero_streak")
    )
    return reduce(
        DataFrame.unionByName,
        [
            six,
            rows(quality.uniqueness_audit(df, KEY), "uniqueness_detail", ["n_duplicate_rows", "duplicate_pct"]),
            rows(quality.gap_overview(df), "gaps", ["n_gaps", "longest_gap", "n_isolated"]),
            rows(zero, "zero_streaks", ["n_zero_streaks", "longest_zero_streak"]),
            rows(
                quality.co_missing(df, "pm25", "pm10"),
                "joint_missing",
                ["both_missing", "only_target_missing", "only_other_missing"],
            ),
        ],
    )


def flag_frame(air_raw: DataFrame, weather_raw: DataFrame, order: str, limit: float = S.HUMIDITY_LIMIT) -> DataFrame:
    """Cleaned air with the hour's humidity, its flag and the season: input of the flag evidence tests."""
    weather = clean_weather(weather_raw, order)
    cleaned = clean_air(air_raw, weather, order).select(*KEY, "pm25")
    joined = joins.join_air_weather(cleaned, weather.select(S.TIME, "relative_humidity"))
    return joined.withColumns(
        {"flag": fn.humidity_flag("relative_humidity", limit), "season": fn.season(S.TIME)}
    ).drop("weather_matched")
