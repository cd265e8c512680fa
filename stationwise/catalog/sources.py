"""Scans and sinks (inventory 2.1): events are exported in the needed layout and scanned back."""

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import clean
from ..schema import EXPECTED_UNITS
from ..session import scratch_path
from ..sources import agency_csv, archive, columnar_json, tables
from . import query, views as v


def export_archive(spark, sf) -> str:
    raw = v.obs_raw(spark, sf)
    long = raw.select(
        F.col("seq").cast("string").alias("location_id"),
        F.lit("1").alias("sensors_id"),
        F.col("station_id").alias("location"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"),
        F.lit(21.0).alias("lat"),
        F.lit(105.0).alias("lon"),
        F.explode(
            F.array(
                F.struct(F.lit("pm25").alias("parameter"), F.col("value").alias("value")),
                F.struct(F.lit("rh").alias("parameter"), F.col("rh").alias("value")),
            )
        ).alias("_m"),
    ).select(
        "location_id", "sensors_id", "location", "datetime", "lat", "lon",
        "_m.parameter", F.lit("u").alias("units"), "_m.value",
    )
    root = scratch_path(spark, "archive")
    archive.write_measurement_archive(long, root)
    return root


@query(
    "scan_measurement_archive",
    v.sql(
        "obs_raw",
        """SELECT station_id AS location, parameter, count(*) AS n, round(sum(x), 6) AS total, min(date_trunc('second', ts))::TIMESTAMP AS first_time FROM (
        SELECT *, unnest(['pm25', 'rh']) AS parameter, unnest([value, rh]) AS x FROM obs_raw) WHERE year(ts) = 2024 GROUP BY ALL""",
    ),
)
def _(spark, sf):
    root = export_archive(spark, sf)
    files = archive.archive_files(spark, root, [2024]).count()
    rows = archive.scan_measurement_archive(spark, root, [2024], expected_files=files)
    return rows.groupBy("location", "parameter").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total"),
        F.min(F.to_timestamp("datetime")).alias("first_time"),
    )


@query(
    "hourly_pivot_mean",
    v.sql(
        "obs_raw",
        """SELECT station_id, date_trunc('hour', ts + INTERVAL 7 HOUR)::TIMESTAMP AS timestamp, round(avg(value), 6) AS pm25, round(avg(rh), 6) AS rh, NULL::DOUBLE AS pm10 FROM obs_raw GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    root = export_archive(spark, sf)
    rows = archive.scan_measurement_archive(spark, root, [2024]).select(
        F.col("location").alias("station_id"), fn.local_time(F.to_timestamp("datetime")).alias("timestamp"), "parameter", "value"
    )
    return clean.hourly_pivot(rows, ["pm25", "rh", "pm10"])


_FIELDS = dict(zip(EXPECTED_UNITS, v.WEATHER))


def export_columnar(spark, sf) -> str:
    hourly = v.weather_hourly(spark, sf).withColumn("day", F.col("timestamp").cast("date"))
    packed = hourly.groupBy("day").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm").alias("time"),
                    *[F.col(c).alias(f) for f, c in _FIELDS.items()],
                )
            )
        ).alias("rows")
    )
    doc = packed.select(
        F.to_json(
            F.struct(
                F.lit(21.0).alias("latitude"),
                F.lit(105.75).alias("longitude"),
                F.struct(*[F.lit(u).alias(f) for f, u in EXPECTED_UNITS.items()]).alias("hourly_units"),
                F.struct(
                    *[F.col(f"rows.{f}").alias(f) for f in ["time", *_FIELDS]]
                ).alias("hourly"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("value")
    )
    path = scratch_path(spark, "columnar")
    doc.write.text(path)
    return path


@query(
    "scan_columnar_json",
    v.sql(
        "weather_hourly",
        "SELECT timestamp, " + ", ".join(f"round({c}, 6) AS {c}" for c in v.WEATHER) + " FROM weather_hourly",
    ),
)
def _(spark, sf):
    rows = columnar_json.scan_columnar_json(spark, export_columnar(spark, sf), EXPECTED_UNITS, multi_line=False)
    return rows.select(
        F.to_timestamp("time", "yyyy-MM-dd'T'HH:mm").alias("timestamp"), *[F.col(f).alias(c) for f, c in _FIELDS.items()]
    )


@query(
    "columnar_json_units",
    v.sql(
        "weather_hourly",
        "SELECT strftime(min(timestamp), '%Y-%m-%dT%H:%M') AS first_time, count(*) AS n_times, true AS lengths_ok, true AS units_ok, true AS has_coordinates FROM weather_hourly GROUP BY CAST(timestamp AS DATE)",
    ),
)
def _(spark, sf):
    payloads = columnar_json.read_payloads(spark, export_columnar(spark, sf), list(EXPECTED_UNITS), multi_line=False)
    return columnar_json.payload_verdicts(payloads, EXPECTED_UNITS)


def export_agency(spark, sf) -> tuple[str, str]:
    """Odd readings in the newer layout, even ones in the older; sites and QC vary by id."""
    seq = F.col("seq")
    base = v.obs_fault(spark, sf).withColumns(
        {
            "Site": F.when(seq % 7 == 0, "Hue").when(seq % 7 == 1, " HANOI").otherwise("Hanoi"),
            "Parameter": F.when(seq % 11 == 0, "OZONE").otherwise("PM2.5 - Principal"),
            "when": F.when(seq % 29 == 0, "??").otherwise(F.date_format("ts", "yyyy-MM-dd hh:mm a")),
            "Year": F.when(seq % 31 == 0, "2023").otherwise("2024"),
            "QC Name": F.when(seq % 13 == 0, "Invalid").otherwise("Valid"),
            "Duration": F.lit("1 Hr"),
        }
    )
    first, second = scratch_path(spark, "agency"), scratch_path(spark, "agency")
    base.filter(seq % 2 == 0).select(
        "Site", "Parameter", F.col("when").alias("Date (LST)"), "Year", F.col("raw_value").alias("Value"),
        F.lit("UG/M3").alias("Unit"), "Duration", "QC Name",
    ).write.option("header", "true").csv(first)
    base.filter(seq % 2 == 1).select(
        F.col("Site"), "Parameter", F.col("when").alias("Date (LT)"), "Year", F.lit("999").alias("NowCast Conc."),
        F.col("raw_value").alias("Raw Conc."), F.lit("ug/m3").alias("Conc. Unit"), "Duration", "QC Name",
    ).write.option("header", "true").csv(second)
    return first, second


_AGENCY = """ag AS (SELECT seq, raw_value, CASE WHEN seq % 29 <> 0 THEN date_trunc('minute', ts)::TIMESTAMP END AS t, CASE WHEN seq % 31 = 0 THEN 2023 ELSE 2024 END AS y,
  CASE WHEN seq % 13 = 0 THEN 'qc_invalid' WHEN TRY_CAST(raw_value AS DOUBLE) >= 0 THEN 'valid' ELSE 'sentinel_or_invalid_value' END AS status FROM obs_fault WHERE seq % 7 <> 0 AND seq % 11 <> 0)"""


@query(
    "scan_agency_csv",
    v.sql(
        "obs_fault",
        "SELECT status, count(*) AS n, count(t) AS n_timed, round(sum(CASE WHEN status = 'valid' THEN TRY_CAST(raw_value AS DOUBLE) END), 6) AS pm25_sum, min(t) AS first_time FROM ag GROUP BY ALL",
        _AGENCY,
    ),
)
def _(spark, sf):
    rows = agency_csv.scan_agency_csv(spark, "Hanoi", *export_agency(spark, sf))
    return rows.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("local_time").alias("n_timed"),
        F.sum("pm25").alias("pm25_sum"),
        F.min("local_time").alias("first_time"),
    )


@query(
    "file_profile",
    v.sql(
        "obs_fault",
        """SELECT seq % 2 AS layout, count(*) AS n_rows, count(t) AS n_retained, count(*) FILTER (status = 'valid') AS n_valid, count(*) - count(t) AS n_unparsable_time, count(t) - count(DISTINCT t) AS n_duplicate_time, min(t) AS first_time, max(t) AS last_time, count(*) FILTER (y <> year(t)) AS n_off_year FROM ag GROUP BY 1""",
        _AGENCY,
    ),
)
def _(spark, sf):
    """Every export is treated as one file: part files share their folder's profile."""
    rows = agency_csv.scan_agency_csv(spark, "Hanoi", *export_agency(spark, sf))
    nowcast = F.when(F.col("unit") == "UG/M3", "0").otherwise("1")
    prof = agency_csv.file_profile(rows.withColumn("source_file", nowcast))
    return prof.drop("years").withColumn("layout", F.col("source_file").cast("long")).drop("source_file")


@query(
    "scan_canonical",
    v.sql(
        "obs_fault",
        """SELECT station_id, (date_trunc('second', ts) - INTERVAL 7 HOUR)::TIMESTAMP AS timestamp, round(CASE WHEN TRY_CAST(raw_value AS DOUBLE) IS NOT NULL THEN TRY_CAST(raw_value AS DOUBLE) END, 6) AS pm25 FROM obs_fault""",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "canonical")
    v.obs_fault(spark, sf).select(
        "station_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("raw_value").alias("pm25"), "rh"
    ).write.parquet(path)
    return tables.scan_canonical(spark, path)


@query(
    "freeze_table",
    v.sql(
        "obs_grid",
        "SELECT count(*) AS row_count, min(timestamp) AS timestamp_min, max(timestamp) AS timestamp_max, count(DISTINCT station_id) AS station_count, 'pm10,relative_humidity' AS feature_columns, 'pm25' AS target_column FROM obs_grid",
    ),
)
def _(spark, sf):
    return tables.freeze_table(v.obs_grid(spark, sf), scratch_path(spark, "frozen"))


@query(
    "write_report_table",
    v.sql("obs_hourly", "SELECT station_id, count(*) AS n, round(max(pm25), 6) AS peak FROM obs_hourly GROUP BY ALL"),
)
def _(spark, sf):
    report = v.obs_hourly(spark, sf).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.max("pm25").alias("peak"))
    path = tables.write_report_table(report, scratch_path(spark, "report"))
    return spark.read.schema(report.schema).option("header", "true").csv(path)
