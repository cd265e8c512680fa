"""Registered resampling queries draw the reference's replicate counts."""

import pytest

from stationwise import catalog
from stationwise.catalog import composites, resampling, views as v
from stationwise.catalog.inference import days
from stationwise.plans import dataset, inference
from tests.helpers import calendar

QUERIES, _ = catalog.load()
SF = "/root/testdata/sf0.001"


def test_counts_are_the_references():
    assert (resampling.N_CI, resampling.N_NULL) == (1000, 5000)


def test_intervals_draw_a_thousand(spark):
    rows = QUERIES["block_bootstrap_ci"](spark, SF).collect()
    assert rows and all(r["n_replicates"] == 1000 for r in rows)


def test_null_p_values_are_in_steps_of_one_in_5001(spark):
    rows = QUERIES["dense_block_null_test"](spark, SF).collect()
    assert rows
    for r in rows:
        assert 4900 < r["n_replicates"] <= 5000
        assert r["p_value"] == pytest.approx((1 + r["n_ge"]) / 5001, abs=1e-6)


def test_a_strong_weekend_can_reach_a_small_p(spark):
    daily = inference.labelled(calendar(spark, {"a": [100.0 + i % 5 if i % 7 > 4 else float(i % 5) for i in range(84)]}))
    row = inference.weekday_effect(daily, resampling.N_NULL, resampling.SEED).collect()[0]
    assert row["p_supporting"] < 2 / 41


def test_sensitivity_covers_the_references_settings(spark):
    """The smallest table has no day of 12 hours."""
    rows = QUERIES["inference_sensitivity"](spark, "/root/testdata/sf0.01").collect()
    assert {r["block"] for r in rows} == {7, 14, 21, 28, 42}
    assert {12, 18} <= {r["min_hours"] for r in rows} <= {12, 18, 24}


def test_reanalysis_profiles_and_correlates_every_measure(spark):
    """Eight measures of merged(), the angle also by circular statistics; few replicates, as they aren't looked at."""
    rows = dataset.reanalysis(v.merged(spark, SF), days(spark, SF), composites.MERGED, 255.0, 250.0, 2, 42).filter("section in ('profile', 'correlation')").collect()
    measures = {"pm25", "pm10", "temperature", "relative_humidity", "wind_speed", "wind_direction", "precipitation", "surface_pressure"}
    assert {r["item"] for r in rows if r["section"] == "profile"} == measures
    assert {r["item"] for r in rows if r["section"] == "correlation"} == measures - {"pm25"}
    assert {r["item"] for r in rows if r["metric"] == "circular_mean"} == {"wind_direction"}
