import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationwise.operators import grid, sequence, windows
from tests.helpers import T0, as_dict, hourly

RNG = np.random.default_rng(7)


def messy(n=400):
    """Long constant runs, gaps and missing values, spanning many small chunks."""
    out = []
    while len(out) < n:
        kind = RNG.integers(0, 4)
        k = int(RNG.integers(1, 60))
        out += [None] * k if kind == 0 else ["gap"] * min(k, 5) if kind == 1 else [float(RNG.integers(0, 3))] * k
    return out[:n]


SERIES = {"a": messy(), "b": messy(), "hot": messy(900)}


def brute_runs(values):
    rows, start = [], None
    prev = object()
    for i, x in enumerate([*values, "gap"]):
        if x == "gap" or (start is not None and x != prev):
            if start is not None:
                rows.append((start, i - 1))
            start = None
        if x != "gap" and start is None:
            start = i
        prev = x
    return rows


@pytest.mark.parametrize("size", [8, 64, 4096, None])
def test_runs_do_not_depend_on_chunks(spark, size):
    df = hourly(spark, SERIES).withColumn("h", sequence.hour_number("timestamp") - int(T0.replace(tzinfo=dt.timezone.utc).timestamp() // 3600))
    out = sequence.runs(df, ["station_id"], "h", F.col("pm25"), size)
    for station, values in SERIES.items():
        got = sorted(
            {(r.run_first, r.run_last) for r in out.filter(F.col("station_id") == station).collect()}
        )
        assert got == brute_runs(values), station


@pytest.mark.parametrize("size", [8, 100])
def test_running_and_filled_equal_plain_windows(spark, size):
    df = hourly(spark, SERIES).withColumn("h", sequence.hour_number("timestamp"))
    keys = ["station_id"]
    for build in (
        lambda s: sequence.running(df, keys, "h", {"rn": F.lit(1), "total": F.coalesce("pm25", F.lit(0.0))}, s),
        lambda s: sequence.filled(df, keys, "h", {"f": F.col("pm25")}, {"b": F.col("pm25")}, s),
    ):
        a, b = as_dict(build(size), "station_id", "h"), as_dict(build(None), "station_id", "h")
        assert a == b and len(a) == df.count()


@pytest.mark.parametrize("size", [24, 48, 2048])
def test_trailing_windows_equal_pandas(spark, size):
    df = hourly(spark, SERIES)
    got = as_dict(windows.rolling_means(df, windows={24: 5}, size=size), "station_id", "timestamp")
    pdf = df.toPandas()
    for _, g in pdf.groupby("station_id"):
        s = g.sort_values("timestamp").set_index("timestamp")["pm25"].astype(float)
        want = s.rolling("24h", min_periods=5).mean()
        for t, x in want.items():
            have = got[(g.station_id.iloc[0], t.to_pydatetime())]["rolling_24h"]
            assert (have is None and np.isnan(x)) or abs(have - x) < 1e-9


def test_instant_window_is_left_open(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("s", t, 1.0), ("s", t + dt.timedelta(hours=24), 3.0), ("s", t + dt.timedelta(hours=24, microseconds=-1), 5.0), ("s", t + dt.timedelta(hours=90), None)]
    df = spark.createDataFrame(rows, "station_id string, timestamp timestamp, pm25 double")
    got = as_dict(windows.rolling_means_exact(df, 24, 1, size_hours=30), "timestamp")
    assert got[(t,)]["rolling_24h"] == 1.0
    assert got[(rows[2][1],)]["rolling_24h"] == 3.0  # the first reading is still inside
    assert got[(rows[1][1],)]["rolling_24h"] == 4.0  # exactly 24 h old: outside
    assert got[(rows[3][1],)]["rolling_24h"] is None


@pytest.mark.parametrize("size", [24, 4096])
def test_a_missing_hour_empties_exactly_24_windows(spark, size):
    values = [10.0] * 100
    values[40] = None
    out = windows.alert_label(hourly(spark, {"s": values}), threshold=5.0, size=size)
    labelled = [r.timestamp for r in out.filter("alert is not null").collect()]
    hours = sorted(int((t - T0).total_seconds() // 3600) for t in labelled)
    assert hours == [*range(23, 40), *range(64, 100)]


def test_features_never_see_the_current_hour(spark):
    values = [1.0] * 30
    values[29] = 1000.0
    row = windows.past_features(hourly(spark, {"s": values})).orderBy(F.desc("timestamp")).first()
    assert row.past_mean == 1.0 and row.past_sd == 0.0 and row.lag_24h == 1.0


@pytest.mark.parametrize("size", [8, 4096])
def test_interpolation_fills_only_short_interior_gaps(spark, size):
    values = [None, 1.0, None, 3.0, None, None, 6.0, None, None, None, 10.0, None]
    df = hourly(spark, {"s": values}).withColumn("split", F.lit("train"))
    out = grid.interpolate_short_gaps(df, max_gap=2, size=size).orderBy("timestamp").collect()
    assert [r.pm25_derived for r in out] == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None, None, None, 10.0, None]
    assert [r.is_derived for r in out].count(True) == 3


def test_stuck_needs_more_than_six_and_zero_streak_at_least_six(spark):
    values = [5.0] * 6 + [6.0] * 7 + [0.0] * 6 + [1.0]
    df = hourly(spark, {"s": values})
    stuck = grid.stuck_sensor(df).filter("is_stuck = 1").count()
    assert stuck == 7
    streaks = grid.zero_streaks(df).collect()
    assert len(streaks) == 1 and streaks[0].streak_hours == 6


def test_grid_adds_rows_and_never_drops(spark):
    df = hourly(spark, {"a": [1, "gap", "gap", 2], "b": ["gap", 3]}).withColumn("location", F.col("station_id"))
    out = grid.hourly_grid(df, ["location"])
    assert out.count() == 8
    assert out.filter("location is null").count() == 0
    assert out.filter("pm25 is not null").count() == 3
    with pytest.raises(ValueError, match="padding"):
        grid.hourly_grid(df, max_pad_hours=1)


def test_steps_cross_chunks(spark):
    df = hourly(spark, {"s": [1] + ["gap"] * 100 + [2, 3]})
    steps = [r.step_hours for r in grid.with_step(df, size=8).orderBy("timestamp").collect()]
    assert steps == [None, 101.0, 1.0]


def test_masked_gaps_keep_their_neighbours(spark):
    values = [float(i) for i in range(200)]
    values[50] = None
    df = hourly(spark, {"s": values}).withColumn("split", F.lit("train"))
    starts = sorted(int((r.gap_start - T0).total_seconds() // 3600) for r in grid.mask_contiguous(df, 3, 10, 1).collect())
    assert len(starts) == 10
    for s in starts:
        assert all(values[j] is not None for j in range(s - 1, s + 4))
    assert all(b - a >= 4 for a, b in zip(starts, starts[1:]))


def test_masked_gaps_use_every_start(spark):
    values = [1.0, 1.0, None, 1.0, 1.0, 1.0, None, None, 1.0, 1.0, 1.0, None]  # legal starts of two hours need four observed ones in a row
    df = hourly(spark, {"s": values + [1.0] * 4 + [None]}).withColumn("split", F.lit("train"))
    starts = [int((r.gap_start - T0).total_seconds() // 3600) for r in grid.mask_contiguous(df, 2, 10, 1).collect()]
    assert starts == [13]
    one = [int((r.gap_start - T0).total_seconds() // 3600) for r in grid.mask_contiguous(df, 1, 10, 1).collect()]
    assert {4, 9} < set(one) and set(one) & {13, 14} and len(one) == 3


def test_random_mask_holds_out_the_share(spark):
    df = hourly(spark, {"s": [float(i) for i in range(90)] + [None] * 10})
    out = grid.mask_random(df, 0.2, 3)
    assert out.filter("held_out").count() == 18
    assert out.filter("held_out and pm25 is null").count() == 0


def test_pandas_reference_for_missing_runs(spark):
    out = grid.missing_runs(hourly(spark, {"hot": SERIES["hot"]}), size=8)
    pdf = pd.DataFrame(brute_runs(SERIES["hot"]), columns=["a", "b"])
    want = [(b - a + 1) for a, b in pdf.itertuples(index=False) if SERIES["hot"][a] is None]
    assert sorted(r.gap_hours for r in out.collect()) == sorted(want)
