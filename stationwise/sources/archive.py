"""Day-partitioned gzip CSV archive of long measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def year_folders(root: str, years: Sequence[int]) -> str:
    """Pattern of the asked years' folders, so that no other year is listed."""
    return f"{root.rstrip('/')}/year={{{','.join(str(y) for y in years)}}}"


def archive_files(spark: SparkSession, root: str, years: Sequence[int]) -> DataFrame:
    """Archive files of the given years, empty ones included; file contents are not read."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv.gz")
        .option("recursiveFileLookup", "true")
        .load(year_folders(root, years))
        .select("path")
    )
    year = F.regexp_extract("path", r"year=(\d{4})", 1).cast("int")
    return listed.withColumn("year", year).filter(F.col("year").isin(list(years)))


def scan_measurement_archive(
    spark: SparkSession, root: str, years: Sequence[int], expected_files: int | None = None
) -> DataFrame:
    """Long measurements of the given years; other year partitions are neither listed nor opened.

    If none of the years has a folder, the read fails. A missing or malformed file fails the job. With expected_files the number of
    files must match before anything is read.
    """
    if expected_files is not None:
        found = archive_files(spark, root, years).count()
        if found != expected_files:
            raise ValueError(f"expected {expected_files} archive files, found {found}")
    return (
        spark.read.schema(S.MEASUREMENT_SCHEMA)
        .option("header", "true")
        .option("mode", "FAILFAST")
        .option("basePath", root)
        .csv(year_folders(root, years))
        .filter(F.col("year").isin(list(years)))
    )


def write_measurement_archive(df: DataFrame, root: str, time: str = "datetime") -> None:
    """Write the same layout: year and day partitions of gzip CSV."""
    ts = F.col(time).cast("timestamp")
    parts = df.withColumns({"year": F.year(ts), "day": F.date_format(ts, "MMdd")})
    (
        parts.repartition("year", "day")
        .write.partitionBy("year", "day")
        .option("header", "true")
        .option("compression", "gzip")
        .csv(root)
    )
