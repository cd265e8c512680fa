import numpy as np
import pytest
from pyspark.sql import functions as F

from stationwise.functions import dist
from stationwise.operators import linear, linear_core, resample, stats
from tests.helpers import as_dict, calendar, hourly

RNG = np.random.default_rng(11)


def test_distribution_functions_match_commons_math(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for x in (-3.2, -0.4, 0.0, 0.7, 2.5, 8.0):
        assert float(dist.norm_sf_np(x)) == pytest.approx(1 - d.NormalDistribution(0.0, 1.0).cumulativeProbability(x), abs=1e-12)
        for k in (1.0, 3.0, 27.0, 800.0):
            assert float(dist.t_sf_np(x, k)) == pytest.approx(1 - d.TDistribution(k).cumulativeProbability(x), abs=1e-10)
            if x > 0:
                assert float(dist.gamma_sf(k / 2, x / 2)) == pytest.approx(1 - d.ChiSquaredDistribution(k).cumulativeProbability(x), abs=1e-10)
                f = float(dist.beta_inc(k / 2, 1.5, k / (k + 3 * x)))
                assert f == pytest.approx(1 - d.FDistribution(3.0, k).cumulativeProbability(x), abs=1e-10)
    for p in (0.01, 0.3, 0.975):
        assert float(dist.norm_ppf_np(np.array([p]))[0]) == pytest.approx(d.NormalDistribution(0.0, 1.0).inverseCumulativeProbability(p), abs=1e-8)
        assert float(dist.t_ppf_np(np.array([p]), np.array([9.0]))[0]) == pytest.approx(d.TDistribution(9.0).inverseCumulativeProbability(p), abs=1e-7)


def newey_west(x, u, lag, small=True):
    """Direct double sum over pairs of rows."""
    n, k = x.shape
    meat = np.zeros((k, k))
    for i in range(n):
        for j in range(n):
            if abs(i - j) <= lag:
                meat += (1 - abs(i - j) / (lag + 1)) * u[i] * u[j] * np.outer(x[i], x[j])
    inv = np.linalg.inv(x.T @ x)
    return inv @ meat @ inv * (n / (n - k) if small else 1)


@pytest.mark.parametrize("size", [None, 16])
def test_hac_equals_the_direct_sum(spark, size):
    n = 60
    x = np.column_stack([np.ones(n), RNG.normal(size=n), RNG.normal(size=n)])
    y = x @ [1.0, 2.0, -1.0] + RNG.normal(size=n)
    rows = [("s", 3 * i, float(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "station_id string, pos long, y double, a double, b double, c double")
    xs = ["a", "b", "c"]
    fit = linear_core.hac_fit(df, ["station_id"], "y", xs, "pos", [0, 5, 12], size=size)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    for r in fit.collect():
        assert np.allclose(r.beta, beta)
        assert np.allclose(np.array(r["cov"]).reshape(3, 3), newey_west(x, y - x @ beta, r.lag))
    w = linear_core.joint_wald(fit.filter("lag = 5"), xs, ["b", "c"]).first()
    v = newey_west(x, y - x @ beta, 5)[1:, 1:]
    assert w.f == pytest.approx(beta[1:] @ np.linalg.inv(v) @ beta[1:] / 2)


def test_interaction_f_equals_two_regressions(spark):
    n = 200
    season, flag = RNG.integers(0, 4, n), RNG.integers(0, 2, n)
    y = season + flag * (season == 2) * 3 + RNG.normal(size=n)
    df = spark.createDataFrame([("s", int(s), int(f), float(v)) for s, f, v in zip(season, flag, y)], "station_id string, season long, flag long, value double")
    row = stats.interaction_f_test(df, "flag", "season", "value").first()
    dummies = np.eye(4)[season]
    sse = lambda m: float(np.sum((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2))
    full = sse(np.column_stack([dummies, dummies * flag[:, None]]))
    add = sse(np.column_stack([dummies, flag]))
    assert row.f == pytest.approx(((add - full) / 3) / (full / (n - 8)))
    assert (row.df1, row.df2) == (3, n - 8)


def test_small_cells_stay_as_rows_without_a_test(spark):
    df = spark.createDataFrame([("s", k % 2, k % 2 if k < 5 else 0, float(k)) for k in range(9)], "station_id string, season long, flag long, value double")
    row = stats.interaction_f_test(df, "flag", "season", "value").first()
    assert (row.status, row.f, row.additive_effect) == ("insufficient_data", None, None)


def test_holm_leaves_out_rows_without_p(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", None), ("f", "c", 0.5)], "fam string, test string, p double")
    assert {r.test: r.holm_p for r in stats.holm(df, ["fam"], "p", "test").collect()} == {"a": 0.02, "b": None, "c": 0.5}


def test_holm_is_monotone_and_capped(spark):
    df = spark.createDataFrame([("f", t, p) for t, p in (("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9))], "fam string, test string, p double")
    got = {r.test: r.holm_p for r in stats.holm(df, ["fam"], "p", "test").collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9})


def test_constant_series_is_almost_perfectly_dependent(spark):
    row = stats.effective_n(calendar(spark, {"s": [2.0] * 40})).first()
    assert row.rho_lag1 == 0.999999 and row.n_effective < 1


def test_replicates_move_values_and_keep_labels(spark):
    values = [None if i % 9 == 0 else float(i) for i in range(100)]
    cal = calendar(spark, {"s": values}, label=lambda i: i % 4)
    reps = resample.replicates(cal, 5, [7], 1, labels=["label"]).collect()
    assert len(reps) == 500
    by = {}
    for r in reps:
        assert r.label == r.dest % 4
        by.setdefault(r.b, {})[r.dest] = r.value
    for vals in by.values():
        assert sorted(vals) == list(range(100))
        for start in range(0, 98, 7):
            seen = [(d, vals[d]) for d in range(start, min(start + 7, 100)) if vals[d] is not None]
            shift = {(v - d) % 100 for d, v in seen}
            assert len(shift) == 1  # a block keeps consecutive calendar days


def test_group_replicates_keep_the_observed_count(spark):
    values = [None if i % 5 == 0 else float(i) for i in range(120)]
    cal = calendar(spark, {"s": values}, label=lambda i: (i // 15) % 2)
    reps = resample.group_replicates(cal, "label", 10, 20, 4)
    counts = {(r.label, r.b): r["count"] for r in reps.groupBy("label", "b").count().collect()}
    for g in (0, 1):
        want = sum(1 for i, x in enumerate(values) if x is not None and (i // 15) % 2 == g)
        assert all(counts[(g, b)] == want for b in range(1, 21))


def test_influence_equals_leave_one_out(spark):
    n = 30
    x = np.column_stack([np.ones(n), RNG.normal(size=n)])
    y = x @ [1.0, 2.0] + RNG.normal(size=n)
    df = hourly(spark, {"s": list(y)}, name="y")
    from pyspark.sql import Row

    xs = spark.createDataFrame([Row(timestamp=r.timestamp, one=1.0, x=float(x[i, 1])) for i, r in enumerate(df.orderBy("timestamp").collect())])
    rows = linear.influence_rows(df.join(xs, "timestamp"), "y", ["one", "x"]).orderBy("timestamp").collect()
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    s2 = np.sum((y - x @ beta) ** 2) / (n - 2)
    for i in (0, 7, 29):
        keep = np.arange(n) != i
        b = np.linalg.lstsq(x[keep], y[keep], rcond=None)[0]
        d = (beta - b) @ (x.T @ x) @ (beta - b) / (2 * s2)
        assert rows[i].cooks_d == pytest.approx(d)
        assert rows[i].leverage == pytest.approx(x[i] @ inv @ x[i])


def test_vif_equals_auxiliary_regressions(spark):
    n = 100
    a, b = RNG.normal(size=n), RNG.normal(size=n)
    c = a + 0.5 * b + 0.3 * RNG.normal(size=n)
    m = np.column_stack([a, b, c])
    df = spark.createDataFrame([("s", *map(float, r)) for r in m], "station_id string, a double, b double, c double")
    got = as_dict(linear.vif(df, ["a", "b", "c"]), "feature")
    for j, f in enumerate("abc"):
        others = np.column_stack([np.ones(n), np.delete(m, j, 1)])
        e = m[:, j] - others @ np.linalg.lstsq(others, m[:, j], rcond=None)[0]
        assert got[(f,)]["vif"] == pytest.approx(m[:, j].var() * n / np.sum(e**2))


def test_reset_and_breusch_pagan(spark):
    n = 80
    x1 = RNG.normal(size=n)
    y = 1 + x1 + x1**2 + RNG.normal(size=n)
    df = hourly(spark, {"s": list(y)}, name="y").withColumn("one", F.lit(1.0))
    rows = [(r.timestamp, float(x1[i])) for i, r in enumerate(df.orderBy("timestamp").collect())]
    df = df.join(spark.createDataFrame(rows, "timestamp timestamp, x double"), "timestamp")
    row = linear.line_diagnostics(df, "y", ["one", "x"]).first()
    X = np.column_stack([np.ones(n), x1])
    fit = X @ np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - fit
    sse = lambda m, t: float(np.sum((t - m @ np.linalg.lstsq(m, t, rcond=None)[0]) ** 2))
    for p, q in ((2, 1), (3, 2)):
        aux = np.column_stack([X, *[fit**k for k in range(2, p + 1)]])
        f = ((e @ e - sse(aux, y)) / q) / (sse(aux, y) / (n - 2 - q))
        assert row[f"reset{p}_f"] == pytest.approx(f, rel=1e-6)
    assert row.breusch_pagan == pytest.approx(n * (1 - sse(X, e**2) / np.sum((e**2 - np.mean(e**2)) ** 2)))
    assert row.durbin_watson == pytest.approx(np.sum(np.diff(e) ** 2) / np.sum(e**2))


def test_tuned_penalties_equal_a_direct_search(spark):
    n, alphas = 90, [0.001, 0.1, 1.0, 10.0]
    x = RNG.normal(size=(n, 3))
    x[5, 1] = np.nan
    y = x[:, 0] * 2 + np.nan_to_num(x[:, 1]) + RNG.normal(size=n)
    df = hourly(spark, {"s": list(y)}, name="y")
    rows = [(r.timestamp, *[None if np.isnan(v) else float(v) for v in x[i]]) for i, r in enumerate(df.orderBy("timestamp").collect())]
    df = df.join(spark.createDataFrame(rows, "timestamp timestamp, a double, b double, c double"), "timestamp")
    path = as_dict(linear.regularization_path(df, "y", ["a", "b", "c"], alphas, 5), "fold", "alpha")
    test = n // 6
    for fold in range(1, 6):
        cut = n - (6 - fold) * test
        tr, va = np.arange(cut), np.arange(cut, cut + test)
        med, q = np.nanmedian(x[tr], 0), np.nanquantile(x[tr], [0.25, 0.75], axis=0)
        z = (np.where(np.isnan(x), med, x) - med) / (q[1] - q[0])
        mx, my = z[tr].mean(0), y[tr].mean()
        zc, yc = z[tr] - mx, y[tr] - my
        for al in alphas:
            w = np.linalg.solve(zc.T @ zc + al * np.eye(3), zc.T @ yc)
            rmse = np.sqrt(np.mean((y[va] - my - (z[va] - mx) @ w) ** 2))
            assert path[(fold, al)]["ridge_rmse"] == pytest.approx(rmse)
            w = np.zeros(3)
            for _ in range(3000):  # proximal gradient, an independent solver
                step = 1 / np.linalg.norm(zc.T @ zc / len(tr), 2)
                g = w - step * (zc.T @ (zc @ w - yc) / len(tr))
                w = np.sign(g) * np.maximum(np.abs(g) - step * al, 0)
            rmse = np.sqrt(np.mean((y[va] - my - (z[va] - mx) @ w) ** 2))
            assert path[(fold, al)]["lasso_rmse"] == pytest.approx(rmse, abs=1e-6)
