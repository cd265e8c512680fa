import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationwise import schema as S
from stationwise.catalog.sources import export_agency
from stationwise.operators import grid, joins, quality, resample, splits
from stationwise.session import scratch_path
from stationwise.sources import agency_csv, archive, columnar_json, tables
from tests.helpers import calendar, hourly


def test_features_named_after_the_future_are_refused(spark):
    df = hourly(spark, {"s": [1.0]}).withColumns({"lead_1": F.lit(1.0), "wind": F.lit(1.0), "pm25_derived": F.lit(1.0)})
    assert splits.guard_features(df, "pm25") == ["wind"]
    for bad in ("pm25", "lead_1", "pm25_derived", "station_id", "absent"):
        with pytest.raises(ValueError):
            splits.guard_features(df, "pm25", ["wind", bad])


def test_schema_guards(spark):
    df = hourly(spark, {"s": [1.0]})
    with pytest.raises(ValueError, match="missing"):
        S.require(df, ["pm10"])
    with pytest.raises(ValueError):
        S.require_named_zone("+07:00")
    assert S.observation_key(df) == ["station_id", "timestamp"]
    assert S.observation_key(df.drop("station_id")) == ["timestamp"]


def test_weather_join_refuses_collisions_and_repeated_keys(spark):
    air = hourly(spark, {"s": [1.0, 2.0]})
    weather = hourly(spark, {"s": [5.0, 6.0]}, name="temperature").drop("station_id")
    assert joins.join_air_weather(air, weather, check=True).count() == 2
    with pytest.raises(ValueError, match="both sides"):
        joins.join_air_weather(air, weather.withColumn("pm25", F.lit(1.0)))
    with pytest.raises(ValueError, match="duplicate"):
        joins.join_air_weather(air, weather.union(weather), check=True)


def test_humidity_refuses_repeated_hours(spark):
    air = hourly(spark, {"s": [1.0, 2.0]})
    weather = hourly(spark, {"s": [95.0, 6.0]}, name="relative_humidity").drop("station_id")
    assert [r.is_high_humidity for r in joins.humidity_by_lookup(air, weather).orderBy("timestamp").collect()] == [1, 0]
    with pytest.raises(Exception, match="repeated weather hour"):
        joins.humidity_by_lookup(air, weather.union(weather)).collect()


def test_dense_test_refuses_gaps(spark):
    with pytest.raises(ValueError, match="gaps"):
        resample.dense_null_test(calendar(spark, {"s": [1.0, None, 2.0]}), "t", 5, 2, 1)


def test_frozen_table_is_written_once(spark):
    df = hourly(spark, {"s": [1.0, None]})
    path = scratch_path(spark, "frozen")
    assert tables.freeze_table(df, path).first().row_count == 2
    with pytest.raises(Exception, match="exists"):
        tables.freeze_table(df, path)


def test_columnar_documents_with_wrong_units_or_lengths_fail(spark):
    def doc(unit, n):
        path = scratch_path(spark, "doc")
        text = '{"latitude": 1, "longitude": 2, "hourly_units": {"t": "%s"}, "hourly": {"time": ["a", "b"], "t": %s}}' % (unit, [1.0] * n)
        spark.createDataFrame([(text,)], "value string").write.text(path)
        return path

    assert columnar_json.scan_columnar_json(spark, doc("C", 2), {"t": "C"}).count() == 2
    for bad in (doc("F", 2), doc("C", 1)):
        with pytest.raises(ValueError, match="refused"):
            columnar_json.scan_columnar_json(spark, bad, {"t": "C"})


def test_archive_counts_files_before_reading(spark):
    path = scratch_path(spark, "arch")
    rows = [("1", "1", "s", f"{y}-03-0{d}T00:00:00Z", 1.0, 2.0, "pm25", "u", 5.0) for y in (2023, 2024) for d in (1, 2)]
    archive.write_measurement_archive(spark.createDataFrame(rows, S.MEASUREMENT_SCHEMA), path)
    assert archive.scan_measurement_archive(spark, path, [2024], expected_files=2).count() == 2
    with pytest.raises(ValueError, match="expected 3"):
        archive.scan_measurement_archive(spark, path, [2024], expected_files=3)


def test_unknown_agency_layout_is_refused(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("Hanoi", "PM2.5", "x")], "Site string, Parameter string, When string").write.option("header", "true").csv(path)
    with pytest.raises(ValueError, match="layout"):
        agency_csv.scan_agency_csv(spark, "Hanoi", path)


def test_conflicting_records_are_never_chosen(spark):
    rows = [("s", 1, 5.0, "valid", "a"), ("s", 1, 6.0, "valid", "b"), ("s", 2, 5.0, "valid", "a"), ("s", 2, 5.0, "valid", "b"), ("s", 3, None, "qc", "a"), ("s", 3, 5.0, "valid", "b")]
    df = spark.createDataFrame(rows, "station_id string, h long, value double, status string, source string").withColumn("timestamp", F.timestamp_seconds(F.col("h") * 3600)).drop("h")
    got = {r.timestamp.hour: (r.kind, r.value) for r in quality.resolve_duplicates(df).collect()}
    assert got == {1: ("conflict", None), 2: ("identical", 5.0), 3: ("conflict", None)}
    assert quality.conflict_ledger(df).count() == 4


def test_result_identities_catch_a_changed_decision(spark):
    rows = [("f", "a", 1.0, 0.5, 1.5, 0.01, 0.02, True), ("f", "b", 1.0, 0.5, 1.5, 0.2, 0.2, True)]
    df = spark.createDataFrame(rows, "family string, test string, estimate double, ci_low double, ci_high double, p double, holm_p double, rejected boolean")
    got = {r.check: r.violations for r in quality.result_identities(df).collect()}
    assert got["decision"] == 1 and got["holm_recomputed"] == 0 and got["estimate_inside_interval"] == 0


def test_frozen_table_keeps_rows_and_columns(spark, tmp_path):
    from stationwise.sources import tables

    df = hourly(spark, {"a": [1.0, 2.0, None], "b": [4.0]})
    assert tables.freeze_table(df, str(tmp_path / "t")).first()["row_count"] == 4
    with pytest.raises(Exception, match="(?i)exist"):
        tables.freeze_table(df, str(tmp_path / "t"))


def test_unsettled_lasso_is_an_error():
    from stationwise.operators.linear import lasso_gram

    a, b = np.array([[4.0, 3.9], [3.9, 4.0]]), np.array([1.0, -1.0])
    with pytest.raises(ArithmeticError, match="not converged"):
        lasso_gram(a, b, 10, 1e-6, rounds=2)


def test_kept_directions_are_not_lost(spark):
    from stationwise.functions import scalar as fn

    rows = spark.createDataFrame([("399",), ("-5",), ("-999",), ("x",), (None,)], "d string")
    got = [r[0] for r in rows.select(fn.weather_loss_cause("wind_direction", "d")).collect()]
    assert got == [None, "out_of_bounds", "sentinel", "unparsable", None]


def test_agency_files_with_columns_in_another_order_are_refused(spark):
    path = scratch_path(spark, "swapped")
    cols = ["Site", "Parameter", "Date (LT)", "Raw Conc."]
    rows = spark.createDataFrame([("Hanoi", "PM2.5", "2024-01-01 01:00 AM", "5")], cols)
    rows.write.option("header", "true").csv(path)
    swapped = spark.createDataFrame([("Hanoi", "PM2.5", "5", "2024-01-01 01:00 AM")], [*cols[:2], *reversed(cols[2:])])
    swapped.write.mode("append").option("header", "true").csv(path)
    with pytest.raises(Exception, match="(?i)header"):
        agency_csv.scan_agency_csv(spark, "Hanoi", path).collect()


def test_archive_of_other_years_is_not_listed(spark):
    path = scratch_path(spark, "years")
    rows = spark.createDataFrame([(y,) for y in (2023, 2024, 2025)], "year int").withColumns({"day": F.lit("0101"), "x": F.lit(1)})
    rows.write.partitionBy("year", "day").option("header", "true").option("compression", "gzip").csv(path)
    assert {r.year for r in archive.archive_files(spark, path, [2023, 2025]).collect()} == {2023, 2025}


def test_weather_join_fails_on_a_repeated_key_by_itself(spark):
    air = hourly(spark, {"s": [1.0, 2.0]})
    weather = hourly(spark, {"s": [5.0, 6.0]}, name="temperature").drop("station_id")
    with pytest.raises(Exception, match="repeated weather key"):
        joins.join_air_weather(air, weather.union(weather)).collect()
    null_hour = weather.unionByName(weather.withColumn("timestamp", F.lit(None).cast("timestamp"))).unionByName(weather.withColumn("timestamp", F.lit(None).cast("timestamp")))
    assert joins.join_air_weather(air, null_hour).filter("weather_matched").count() == 2
    with pytest.raises(Exception, match="repeated weather key"):
        joins.join_air_weather(air, weather.union(weather)).select("pm25").collect()


def test_lookup_refuses_a_repeated_key(spark):
    df, dim = hourly(spark, {"s": [1.0, 2.0, 3.0]}), hourly(spark, {"s": [5.0, 6.0]}, name="rh").drop("station_id")
    assert [r.rh for r in joins.lookup_many_to_one(df, dim, ["timestamp"]).orderBy("timestamp").collect()] == [5.0, 6.0, None]
    with pytest.raises(Exception, match="repeated lookup key"):
        joins.lookup_many_to_one(df, dim.union(dim.limit(1)), ["timestamp"]).collect()


def test_interpolation_refuses_an_uneven_axis(spark):
    even = hourly(spark, {"a": [1.0, None, 3.0], "b": [2.0, 2.0]}).withColumn("split", F.lit("train"))
    assert grid.interpolate_short_gaps(even).filter("is_derived").first().pm25_derived == 2.0
    hole = hourly(spark, {"a": [1.0, "gap", 3.0]}).withColumn("split", F.lit("train"))
    for bad in (hole, even.unionByName(even.limit(1)), even.unionByName(even.limit(1).withColumn("timestamp", F.expr("timestamp + interval 4000 hours")))):
        with pytest.raises(Exception, match="one row per hour"):
            grid.interpolate_short_gaps(bad).collect()


def test_pairs_follow_the_stations(spark):
    """Bitmap pages: hours over more than one page, and stations that no list names."""
    df = hourly(spark, {"new": [1.0] * 40, "old": ["gap"] * 30 + [1.0] * 40})
    df = df.unionByName(df.withColumn("timestamp", F.expr("timestamp + interval 40000 hours"))).unionByName(df.limit(3))
    df = df.unionByName(hourly(spark, {"far": [1.0] * 5, "zz": [1.0] * 200}))
    regions = spark.createDataFrame([("new", "x"), ("old", "x"), ("far", "y"), ("zz", "x"), (None, "x"), ("new", "x")], "station_id string, region string")
    pairs = joins.pairs_within(regions, "region")
    got = {(r.station_a, r.station_b): r.shared_hours for r in joins.station_pair_overlap(df, pairs).collect()}
    assert got == {("new", "old"): 20, ("new", "zz"): 40, ("old", "zz"): 40}


def test_every_real_file_has_its_own_profile(spark):
    """Several part files per layout: the profile counts the lines of the site and parameter in each."""
    paths = export_agency(spark, "/root/testdata/sf0.001")
    more = spark.read.text(paths[0])
    header, lines = more.first().value, [r.value for r in more.collect()]
    folder = scratch_path(spark, "agency-files").removeprefix("file:")
    os.makedirs(folder)
    body = [x for x in lines if x != header]
    for name, part in (("one.csv", body[:40]), ("two.csv", body[40:55])):
        with open(f"{folder}/{name}", "w") as f:
            f.write("\n".join([header, *part]) + "\n")
    ours = lambda part: sum("hanoi" in x.lower() and "OZONE" not in x for x in part)
    rows = agency_csv.scan_agency_csv(spark, "Hanoi", folder, paths[1])
    got = {r.source_file.rsplit("/", 1)[-1]: r.n_rows for r in agency_csv.file_profile(rows).collect()}
    assert (got.pop("one.csv"), got.pop("two.csv")) == (ours(body[:40]), ours(body[40:55])) and got and all(n.startswith("part-") for n in got)
