"""Canonical Parquet scans, write-once freezing and small published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn


def scan_canonical(
    spark: SparkSession, path: str, measures: Sequence[str] = (S.TARGET,), zone: str = S.LOCAL_TZ
) -> DataFrame:
    """Key and measure columns only; text timestamps are localised, text numbers coerced."""
    df = S.require(spark.read.parquet(path), [S.TIME, *measures], "canonical table")
    kinds = dict(df.dtypes)
    time = fn.parsed_time(S.TIME, zone) if kinds[S.TIME] == "string" else F.col(S.TIME).cast("timestamp")
    key = [S.STATION] if S.STATION in df.columns else []
    return df.select(
        *key,
        time.alias(S.TIME),
        *[(fn.parsed_number(m) if kinds[m] == "string" else fn.null_normalise(F.col(m).cast("double"))).alias(m) for m in measures],
    )


def freeze_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write once, read back, compare columns in order, types and row count; returns the freeze record.

    The rows written are counted as they are written. Partition columns read back last, with
    the type that their folder names suggest, so only their names are compared.
    """
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.mode("errorifexists").option("compression", "snappy").partitionBy(*partition_by).parquet(path)
    back = df.sparkSession.read.parquet(path)
    if back.columns != [c for c in df.columns if c not in partition_by] + list(partition_by):
        raise ValueError("frozen table reads back with other columns")
    kinds = lambda d: {f.name: f.dataType for f in d.schema.fields if f.name not in partition_by}
    if kinds(back) != kinds(df):
        raise ValueError("frozen table reads back with other types")
    rows = back.count()
    if rows != seen.get["n"]:
        raise ValueError(f"frozen table has {rows} rows of {seen.get['n']} written")
    features = [c for c in df.columns if c not in (S.STATION, S.TIME, "location", S.TARGET)]
    return back.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(S.TIME).alias("timestamp_min"),
        F.max(S.TIME).alias("timestamp_max"),
        (F.count_distinct(S.STATION) if S.STATION in df.columns else F.lit(None).cast("long")).alias("station_count"),
        F.lit(",".join(features)).alias("feature_columns"),
        F.lit(S.TARGET).alias("target_column"),
    )


def write_report_table(df: DataFrame, path: str) -> str:
    """Publish a result table as CSV with a header, one file per task."""
    df.write.option("header", "true").csv(path)
    return path
