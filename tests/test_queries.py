"""Registered queries against the reference SQL; STATIONWISE_ORACLE=all runs every one."""

import os

import pytest

from stationwise import catalog
from tests.oracle import DATA, compare, duck

SPREAD = (
    "scan_agency_csv weather_bounds_rule row_qc_verdict station_lookup cell_diff period_membership hourly_grid run_ids "
    "stuck_sensor short_gap_interpolate column_profile resolve_duplicates source_coverage statistical_profile "
    "pair_correlation daily_compliance weekly_calendar coverage_by_stratum alert_label past_only_features "
    "causal_rolling_instant kruskal_wallis hac_covariance hac_location calendar_null_test contrast_ci pooled_split "
    "classification_frame influence regression_metrics classifier_metrics threshold_tuning clean_air extended_dataset"
).split()
QUERIES, SQL = catalog.load()
NAMES = sorted(SQL) if os.environ.get("STATIONWISE_ORACLE") == "all" else SPREAD
SF = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, message, rows, _ = compare(spark, con, SF, QUERIES[name], SQL[name])
    assert ok, message
    assert rows > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
