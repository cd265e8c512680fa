"""Agency CSV exports in two header layouts, brought to one schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn

# Time and value headers of the two layouts.
LAYOUTS = {"standard": ("Date (LST)", "Value"), "mirror": ("Date (LT)", "Raw Conc.")}
PARAMETERS = ("pm2.5", "pm2.5 - principal")


def read_layout(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One layout as text columns with trimmed headers, plus the file each row came from.

    A file whose header has other names or another order than the first fails the job.
    """
    raw = spark.read.option("header", "true").option("enforceSchema", "false").csv(paths)
    trimmed = raw.toDF(*[c.strip() for c in raw.columns])
    return trimmed.withColumn("source_file", F.col("_metadata.file_path"))


def _canonical(df: DataFrame, site: str) -> DataFrame:
    layout = next((v for v in LAYOUTS.values() if set(v) <= set(df.columns)), None)
    if layout is None:
        raise ValueError(f"unknown agency layout: {df.columns}")
    time, value = layout
    S.require(df, ["Site", "Parameter"], "agency CSV")
    unit = next((c for c in ("Conc. Unit", "Unit") if c in df.columns), None)
    qc = "QC Name" if "QC Name" in df.columns else None
    duration = "Duration" if "Duration" in df.columns else None
    text = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
    return df.filter(
        (fn.normalised_text("Site") == site.lower()) & fn.normalised_text("Parameter").isin(list(PARAMETERS))
    ).select(
        fn.parsed_agency_time(text(time)).alias("local_time"),
        fn.undisguised(text(value)).alias("raw_value"),
        text(qc).alias("qc_name"),
        text(unit).alias("unit"),
        text(duration).alias("duration"),
        (F.col("`Year`") if "Year" in df.columns else F.lit(None)).try_cast("int").alias("declared_year"),
        fn.qc_status(
            text(value),
            None if qc is None else text(qc),
            None if unit is None else text(unit),
            None if duration is None else text(duration),
        ).alias("status"),
        "source_file",
    )


def scan_agency_csv(spark: SparkSession, site: str, *layout_paths: str | Sequence[str]) -> DataFrame:
    """Rows of one site from files of either layout; the NowCast column is never used.

    Each argument after the site names files that share one layout.
    """
    parts = [_canonical(read_layout(spark, p), site) for p in layout_paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("pm25", F.when(F.col("status") == "valid", fn.nonnegative("raw_value")))


def file_profile(rows: DataFrame) -> DataFrame:
    """Per file: rows, parsed and valid rows, repeated hours, span, years and off-year rows."""
    per_hour = rows.groupBy("source_file", "local_time").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "valid").alias("ok"),
        F.count_if(F.col("declared_year") != F.year("local_time")).alias("off"),
    )
    parsed = F.col("local_time").isNotNull()
    return per_hour.groupBy("source_file").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(parsed, F.col("n")).otherwise(0)).alias("n_retained"),
        F.sum("ok").alias("n_valid"),
        F.sum(F.when(~parsed, F.col("n")).otherwise(0)).alias("n_unparsable_time"),
        F.sum(F.when(parsed, F.col("n") - 1).otherwise(0)).alias("n_duplicate_time"),
        F.min("local_time").alias("first_time"),
        F.max("local_time").alias("last_time"),
        F.array_join(F.array_sort(F.collect_set(F.year("local_time").cast("string"))), ",").alias("years"),
        F.sum("off").alias("n_off_year"),
    )
