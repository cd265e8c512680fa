"""Documents that hold one array per column, turned into rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(fields: Sequence[str]) -> T.StructType:
    arrays = [T.StructField("time", T.ArrayType(T.StringType()))]
    arrays += [T.StructField(f, T.ArrayType(T.DoubleType())) for f in fields]
    units = [T.StructField(f, T.StringType()) for f in fields]
    return T.StructType(
        [
            T.StructField("latitude", T.DoubleType()),
            T.StructField("longitude", T.DoubleType()),
            T.StructField("hourly_units", T.StructType(units)),
            T.StructField("hourly", T.StructType(arrays)),
        ]
    )


def read_payloads(spark: SparkSession, path: str, fields: Sequence[str], multi_line: bool = True) -> DataFrame:
    return spark.read.schema(_schema(fields)).option("multiLine", str(multi_line).lower()).json(path)


def payload_verdicts(payloads: DataFrame, units: Mapping[str, str]) -> DataFrame:
    """Per document: do all arrays match the time axis, and is every declared unit the expected one."""
    n = F.size("hourly.time")
    same = F.lit(True)
    right = F.lit(True)
    for f, unit in units.items():
        same = same & (F.size(f"hourly.{f}") == n)
        right = right & F.col(f"hourly_units.{f}").eqNullSafe(F.lit(unit))
    return payloads.select(
        F.col("hourly.time")[0].alias("first_time"),
        n.alias("n_times"),
        same.alias("lengths_ok"),
        right.alias("units_ok"),
        (F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("has_coordinates"),
    )


def scan_columnar_json(
    spark: SparkSession, path: str, units: Mapping[str, str], multi_line: bool = True, check: bool = True
) -> DataFrame:
    """Rows (time, one column per field); a wrong length or unit raises when check is on."""
    payloads = read_payloads(spark, path, list(units), multi_line)
    if check:
        bad = payload_verdicts(payloads, units).filter("not (lengths_ok and units_ok and has_coordinates)").take(1)
        if bad:
            raise ValueError(f"columnar document refused: {bad[0].asDict()}")
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), *[F.col(f"hourly.{f}").alias(f) for f in units])
    return payloads.select(F.explode(zipped).alias("_r")).select("_r.*")
