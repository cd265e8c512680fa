import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationwise.operators import profile, ranks
from tests.helpers import as_dict

RNG = np.random.default_rng(3)
VALUES = {
    "hot": list(np.round(RNG.normal(0, 50, 3000), 1)),
    "tiny": [-1.5, 0.0, 0.0, 2.0],
    "one": [7.0],
    "wide": [1e9, -1e9, 1e-9, 0.0, 5.0, 5.0],
}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, float(v)) for k, vs in VALUES.items() for v in vs] + [("tiny", None)]
    return spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("bounded", [False, True])
def test_quantiles_equal_numpy(frame, bounded):
    got = as_dict(ranks.quantiles(frame, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.99}, bounded=bounded), "g")
    for g, vs in VALUES.items():
        for name, p in (("a", 0.1), ("m", 0.5), ("z", 0.99)):
            assert got[(g,)][name] == pytest.approx(np.quantile(vs, p), abs=1e-6)


@pytest.mark.parametrize("bounded", [False, True])
def test_average_ranks_equal_pandas(frame, bounded):
    got = as_dict(ranks.average_ranks(frame, ["g"], "v", bounded=bounded), "g", "v")
    for g, vs in VALUES.items():
        s = pd.Series(vs)
        for v, r in zip(s, s.rank(method="average")):
            assert got[(g, v)]["avg_rank"] == r


def test_spearman_equals_pandas(spark):
    x, y = RNG.normal(size=200).round(1), RNG.normal(size=200).round(1)
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y)], "station_id string, x double, y double")
    row = profile.pair_correlation(df, ["station_id"], "y", ["x"]).first()
    pdf = pd.DataFrame({"x": x, "y": y})
    assert row.pearson == pytest.approx(pdf.corr().iloc[0, 1])
    assert row.spearman == pytest.approx(pdf.rank().corr().iloc[0, 1])


def test_mode_is_null_unless_unique(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0)], "station_id string, v double"
    )
    got = as_dict(profile.statistical_profile(df, ["station_id"], ["v"]), "station_id")
    assert got[("a",)]["mode"] == 1.0 and got[("b",)]["mode"] is None


def test_a_narrow_range_is_cut_into_many_buckets(spark):
    df = spark.range(0, 1001).select((F.lit(950.0) + F.col("id") / 10).alias("v"), (F.col("id") / 1e7 + 1e-4).alias("p"))
    assert df.select(ranks.magnitude_bucket("v")).distinct().count() > 300
    assert df.select(ranks.magnitude_bucket("p")).distinct().count() > 300
    for c in ("v", "p"):
        got = [r[0] for r in df.orderBy(c).select(ranks.magnitude_bucket(c)).collect()]
        assert got == sorted(got)
