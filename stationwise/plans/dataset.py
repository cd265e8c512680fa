"""Collection, the extended table, reanalysis and revalidation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from ..operators import clean, grid, joins, profile, quality, splits
from ..session import written
from ..sources import archive, columnar_json
from . import inference


def collect_air(spark: SparkSession, root: str, years: Sequence[int], box, parameters: Sequence[str], expected_files: int | None = None) -> DataFrame:
    """Archive to canonical hourly air: year pruning, coordinate box, hourly means per parameter."""
    rows = archive.scan_measurement_archive(spark, root, years, expected_files)
    inside = rows.filter(fn.in_box("lat", "lon", box)).select(
        F.col("location").alias(S.STATION), fn.local_time(F.to_timestamp("datetime")).alias(S.TIME), "parameter", "value"
    )
    return clean.hourly_pivot(inside, parameters)


def collect_weather(spark: SparkSession, path: str, units, names, multi_line: bool = True) -> DataFrame:
    """Columnar documents to canonical hourly weather in local time, bounds applied."""
    rows = columnar_json.scan_columnar_json(spark, path, units, multi_line)
    return rows.select(
        fn.local_time(F.to_timestamp("time", "yyyy-MM-dd'T'HH:mm")).alias(S.TIME),
        *[fn.within_weather_bounds(name, field).alias(name) for field, name in names.items()],
    )


def collection(air: DataFrame, weather: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Overlap report of the two collected tables."""
    return joins.overlap_coverage(air, weather, S.TIME, columns)


def extended_dataset(air: DataFrame, weather: DataFrame, max_gap: int = 2, fraction: float = 0.8) -> DataFrame:
    """Weather join, cyclical terms, per-station split, derived short-gap values, season columns.

    One hash exchange by station feeds the split and the interpolation.
    """
    cyc = fn.cyclical_time(S.TIME)
    joined = joins.join_air_weather(air, weather).drop("weather_matched")
    split = splits.station_split(joined.withColumns(cyc), fraction)
    return grid.interpolate_short_gaps(split, max_gap=max_gap).withColumns(
        {"season": fn.season(S.TIME), "winter_year": fn.winter_year(S.TIME)}
    )


def write_extended(df: DataFrame, path: str) -> str:
    """Partitioned by station; a station is spread over files by time, so a hot station is not one file."""
    spread = df.repartitionByRange(S.STATION, S.TIME)
    spread.write.mode("errorifexists").partitionBy(S.STATION).parquet(path)
    return path


CIRCULAR = ("circular_mean", "circular_sd")


def _long(df: DataFrame, section: str, label: str, metrics: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(S.STATION, F.col(label).cast("string").alias("item"), F.explode(cells).alias("_r")).select(
        F.lit(section).alias("section"), S.STATION, "item", "_r.*"
    )


def reanalysis(hourly: DataFrame, days: DataFrame, variables: Sequence[str], median_limit: float, mean_limit: float, n_boot: int, seed: int, extended: DataFrame | None = None, n_ci: int = 1000) -> DataFrame:
    """Contract, quality, gaps, profiles, correlations, trends, tests, their sensitivity and their agreement between stations as one long table.

    `extended` is the derived table that the input contract is checked on. Evidence is
    compared for the pairs of stations of the daily table; its rows are named a - b.
    """
    hourly = written(hourly, "reanalysis_hourly")
    others = [v for v in variables if v != S.TARGET]
    quality_rows = quality.period_quality_table(hourly).withColumn("item", F.concat_ws("/", "period_type", "period"))
    profile_rows = profile.statistical_profile(hourly, [S.STATION], variables)
    pairs = profile.pair_correlation(hourly, [S.STATION], S.TARGET, others)
    tests = written(inference.inference_suite(days, median_limit, mean_limit, n_boot, seed), "reanalysis_tests")
    trends = [
        profile.quantile_bin_trend(hourly, [S.STATION], x, S.TARGET).withColumn("item", F.concat_ws("/", F.lit(x), F.col("bin").cast("string")))
        for x in others
    ]
    sensitivity = inference.inference_sensitivity(hourly, [12, 18, 24], S.SENSITIVITY_BLOCKS, n_ci, seed)
    sensitivity = sensitivity.withColumn("item", F.concat(F.lit("hours="), F.col("min_hours"), F.lit("/block="), F.col("block")))
    named = joins.pairs_within(tests.select(S.STATION).distinct().withColumn("network", F.lit("daily")), "network")
    agree = joins.compare_station_pairs(tests, named).select(
        F.concat_ws(" - ", "station_a", "station_b").alias(S.STATION),
        F.concat_ws(": ", "test", "classification").alias("item"),
        F.col("same_direction").cast("int").alias("same_direction"),
        F.col("ci_overlap").cast("int").alias("ci_overlap"),
    )
    parts = [
        _long(quality_rows, "quality", "item", ["valid_hours", "coverage_pct_calendar", "gap_count", "longest_gap_hours"]),
        _long(grid.missing_runs(hourly, min_span=2), "gaps", "run_start", ["gap_hours"]),
        _long(profile_rows, "profile", "variable", ["n", "mean", "sd", "median", "p95", "skewness", *CIRCULAR]).filter(
            ~F.col("metric").isin(*CIRCULAR) | (F.col("item") == "wind_direction")
        ),
        _long(pairs, "correlation", "variable", ["pearson", "spearman", "pair_pct"]),
        _long(reduce(DataFrame.unionByName, trends), "trend", "item", ["n", "median_x", "median_y", "q25_y", "q75_y"]),
        _long(tests, "inference", "test", ["statistic", "estimate", "p_value", "holm_p"]),
        _long(sensitivity, "sensitivity", "item", ["point", "ci_low", "ci_high", "replicate_sd", "n_replicates"]),
        _long(agree, "agreement", "item", ["same_direction", "ci_overlap"]),
    ]
    if extended is not None:
        stations = [r[0] for r in extended.select(S.STATION).distinct().collect()]  # the stations of one network
        contract = quality.input_contract(extended, stations).withColumns({S.STATION: F.lit("ALL"), "passed": F.col("passed").cast("int")})
        parts.append(_long(contract, "contract", "check", ["violations", "passed"]))
    return reduce(DataFrame.unionByName, parts)


def revalidate(extended: DataFrame, stations: Sequence[str], quality_table: DataFrame, results: DataFrame, recheck: DataFrame | None = None) -> DataFrame:
    """Contract, published quality rows against a recount, result identities and bootstrap checks, as verdict rows.

    The recount copies hours instead of adding up monthly states, and `recheck` (see
    `inference.inference_recheck`) draws replicates another way, so each can find a fault.
    Each area is written on its own: as one plan, with all its strings and broadcasts at
    once, they take more of the driver than any of them needs.
    """
    keys = [S.STATION, "period_type", "period"]
    again = written(quality.period_recount(extended), "recount")
    close = ["coverage_pct_calendar", "coverage_pct_active"]
    exact = ["valid_hours", "gap_count", "longest_gap_hours"]
    differ = joins.reconcile(quality_table, again, keys, exact, close).groupBy("column").agg(
        F.sum(F.when(F.col("verdict") != "match", F.col("n")).otherwise(0)).alias("violations")
    )
    tag = lambda df, area: written(df.select(F.lit(area).alias("area"), "check", "violations", "passed"), area)
    parts = [
        tag(quality.input_contract(extended, stations), "input"),
        tag(differ.select(F.col("column").alias("check"), "violations", (F.col("violations") == 0).alias("passed")), "reconcile"),
        tag(quality.table_identities(quality_table), "quality_identities"),
        tag(quality.result_identities(results), "result_identities"),
    ]
    if recheck is not None:
        failed = recheck.groupBy("check").agg(F.count_if(~F.col("passed")).alias("violations"))
        parts.append(tag(failed.withColumn("passed", F.col("violations") == 0), "bootstrap"))
    return reduce(DataFrame.unionByName, parts)
