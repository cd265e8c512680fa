import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationwise.operators import alerts, keyed_logistic, splits
from tests.helpers import hourly

RNG = np.random.default_rng(5)


def scored(spark, y, s):
    return spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, s)], "model string, y int, score double")


def test_ranking_metrics_equal_direct_counts(spark):
    y, s = RNG.integers(0, 2, 300), RNG.integers(0, 40, 300) / 40
    row = alerts.ranking_metrics(scored(spark, y, s), ["model"]).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap = sum((y[s == t].sum() / y.sum()) * (y[s >= t].mean()) for t in np.unique(s))
    assert row.roc_auc == pytest.approx(auc) and row.pr_auc == pytest.approx(ap)


def test_single_class_is_unestimable(spark):
    row = alerts.classifier_metrics(scored(spark, [0, 0, 0], [0.2, 0.9, 0.4]), ["model"]).first()
    assert row.status == "UNESTIMABLE" and row.recall is None and row.pr_auc is None and row.fp == 1


def test_tuning_equals_a_grid_search_and_falls_back(spark):
    y, s = RNG.integers(0, 2, 200), np.round(RNG.random(200), 3)
    df = scored(spark, y, s)

    def f2(t):
        tp, fp, fn = np.sum((s >= t) & (y == 1)), np.sum((s >= t) & (y == 0)), np.sum((s < t) & (y == 1))
        return 5 * tp / (5 * tp + 4 * fn + fp)

    best = max(alerts.THRESHOLDS, key=lambda t: (f2(t), -t))
    row = alerts.tune_threshold(df, ["model"]).first()
    assert row.tau_f2 == best
    strict = alerts.tune_threshold(df, ["model"], min_precision=1.01).first()
    assert strict.note == "fallback_f2" and strict.tau_recall == best


def test_permutation_keeps_every_value(spark):
    df = hourly(spark, {"a": RNG.random(50), "b": RNG.random(20)}, name="x").withColumn("z", F.col("x") * 2)
    out = alerts.permuted_rows(df, ["x"], 2, 9)
    for station in "ab":
        before = sorted(r.x for r in df.filter(F.col("station_id") == station).collect())
        for rep in (1, 2):
            rows = out.filter((F.col("station_id") == station) & (F.col("repeat") == rep)).collect()
            assert sorted(r.x for r in rows) == before
            assert any(r.z != 2 * r.x for r in rows)


def test_purge_drops_train_rows_that_reach_into_test(spark):
    df = hourly(spark, {"s": [60.0 if (i // 30) % 2 else 10.0 for i in range(200)]})
    feats = splits.alert_features(df, min_periods=4)
    frame = splits.classification_frame(feats, "2024-01-06 00:00:00", 6)
    purged = frame.filter("row_state = 'purged'")
    assert purged.count() == 6 and purged.filter("timestamp < timestamp'2024-01-05 18:00:00'").count() == 0


def test_horizon_zero_label_is_the_current_alert(spark):
    df = hourly(spark, {"s": [60.0] * 30})
    frame = splits.classification_frame(splits.alert_features(df), "2024-01-02 00:00:00", 0)
    assert frame.filter("label is distinct from alert").count() == 0


def test_pooled_folds_never_learn_from_later_hours(spark):
    early = hourly(spark, {"a": RNG.random(60)}, name="x")
    late = hourly(spark, {"b": RNG.random(60)}, start=dt.datetime(2024, 2, 1), name="x")
    frame = early.union(late).withColumns(
        {"label": (F.hour("timestamp") % 2).cast("int"), "row_state": F.lit("used"), "split": F.lit("train")}
    )
    out = alerts.out_of_fold_scores(frame, ["x"], 2)
    spans = {r.fold: (r.first, r.last, r.n) for r in out.groupBy("fold").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count("*").alias("n")).collect()}
    # 120 distinct hours: block 0 is most of station a, the last block is the end of station b
    assert [spans[f][2] for f in (1, 2)] == [40, 40] and spans[1][1] < spans[2][0]


def test_shuffled_places_are_bijections():
    for n in (1, 2, 3, 17, 64, 65, 1000):
        for key in (0, 7, 2**63 + 5):
            got = alerts.shuffled_places(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got.tolist()) == list(range(n))
    a, b = (alerts.shuffled_places(np.arange(1000), np.full(1000, 1000), np.full(1000, k, np.uint64)) for k in (1, 2))
    assert (a == b).mean() < 0.02 and abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.1


def model_frame(spark, n=400, stations="ab"):
    """Two features, one with gaps, that decide the label by chance; the last fifth is test."""
    rng = np.random.default_rng(2)
    rows = []
    for s in stations:
        for i in range(n):
            x, z = rng.normal(), rng.normal(3, 2)
            y = int(rng.random() < 1 / (1 + np.exp(-(1.5 * x - 0.5 * (z - 3) - 0.7))))
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), None if i % 13 == 0 else float(x), float(z), float(rng.normal()), y, "used", "train" if i < 0.8 * n else "test"))
    return spark.createDataFrame(rows, "station_id string, timestamp timestamp, x double, z double, noise double, label int, row_state string, split string")


def newton(x, y, c=1.0):
    """The same objective with plain NumPy."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    lam = np.append(np.full(x.shape[1] - 1, 1 / c), 0)
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(lam), x.T @ (w * (p - y)) + lam * b)
    return b


def test_keyed_fits_equal_newton_per_key(spark):
    """Keys of different sizes, one of a single class and one too small, in one call."""
    rng = np.random.default_rng(3)
    rows, data = [], {}
    for key, n in (("big", 500), ("small", 40), ("apart", 30)):
        x = rng.normal(size=(n, 2)) * [1, 20]
        y = (x[:, 0] > 0).astype(int) if key == "apart" else (rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
        data[key] = (x, y)
        rows += [(key, *map(float, r), int(t)) for r, t in zip(x, y)]
    rows += [("one", 1.0, 2.0, 1)] * 5 + [("tiny", 1.0, 2.0, 1)]
    fits = {r.k: r for r in keyed_logistic.fit(spark.createDataFrame(rows, "k string, a double, b double, label int"), ["k"], ["a", "b"]).collect()}
    for key, (x, y) in data.items():
        assert fits[key].status == "FITTED" and fits[key].gradient <= 1e-10
        assert np.allclose(fits[key].beta, newton(x, y), atol=1e-6)
    assert (fits["one"].status, fits["tiny"].status) == ("SINGLE_CLASS", "INSUFFICIENT_DATA") and fits["one"].beta is None


def test_importance_finds_the_features_that_matter(spark):
    got = {r.feature: r for r in alerts.permutation_importance(model_frame(spark), ["x", "z", "noise"], repeats=6).collect()}
    assert got["x"].mean_drop > 0.05 and abs(got["noise"].mean_drop) < 0.03
    assert all(r.ci_low <= r.mean_drop <= r.ci_high for r in got.values())


def test_backtest_tunes_inside_each_fold(spark):
    frame = model_frame(spark)
    rows = {r.fold: r for r in alerts.temporal_backtest(frame, ["x", "z"], 3).collect()}
    assert set(rows) == {1, 2, 3} and all(r.status == "OK" for r in rows.values())
    # fold 2 by hand: hours 0-159 train, 160-239 validate, inner folds over the train hours
    all_ = frame.filter("split = 'train'").orderBy("timestamp", "station_id").toPandas()
    hour = ((all_.timestamp - all_.timestamp.min()).dt.total_seconds() // 3600).to_numpy().astype(int)

    def scores(train, test):
        med = all_[train][["x", "z"]].median()
        iqr = all_[train][["x", "z"]].quantile(0.75) - all_[train][["x", "z"]].quantile(0.25)
        x = (all_[["x", "z"]].fillna(med) - med) / iqr
        b = newton(x[train].to_numpy(), all_[train].label.to_numpy())
        return 1 / (1 + np.exp(-(x[test].to_numpy() @ b[:2] + b[2])))

    inner = [(hour < 40 * i, (hour >= 40 * i) & (hour < 40 * (i + 1))) for i in (1, 2, 3)]
    y = np.concatenate([all_[v].label for _, v in inner])
    s = np.concatenate([scores(t, v) for t, v in inner])

    def f2(t):
        tp, fp, fn = np.sum((s >= t) & (y == 1)), np.sum((s >= t) & (y == 0)), np.sum((s < t) & (y == 1))
        return 5 * tp / (5 * tp + 4 * fn + fp)

    tau = max(alerts.THRESHOLDS, key=lambda t: (f2(t), -t))
    assert rows[2].tau_f2 == tau and rows[2].n_train == 320
    last, label = scores(hour < 160, (hour >= 160) & (hour < 240)), all_[(hour >= 160) & (hour < 240)].label
    assert rows[2].tp == ((last >= tau) & (label == 1)).sum() and rows[2].fp == ((last >= tau) & (label == 0)).sum()


def test_folds_of_one_class_are_rows_without_metrics(spark):
    frame = model_frame(spark).withColumn("label", F.when(F.col("timestamp") < "2024-01-06", 0).otherwise(F.col("label")))
    rows = {r.fold: r for r in alerts.temporal_backtest(frame, ["x", "z"], 3).collect()}
    assert rows[1].status == "SINGLE_CLASS_FOLD" and rows[1].recall is None and rows[1].tau_f2 is None and rows[1].n_train == 160
    assert rows[3].status == "OK"


def test_specs_are_fitted_together(spark):
    frame = model_frame(spark)
    few = frame.withColumn("row_state", F.when(F.col("timestamp") < "2024-01-16", "purged").otherwise("used"))
    out = {(r.spec, r.horizon): r for r in alerts.ablation_and_horizons({0: frame, 6: few, 12: frame.withColumn("label", F.lit(0))}, {"x": ["x"], "noise": ["noise"], "all": ["x", "z", "noise"]}, "all").collect()}
    assert {k: r.status for k, r in out.items()} == {("x", 0): "EVALUATED", ("noise", 0): "EVALUATED", ("all", 0): "EVALUATED", ("all", 6): "INSUFFICIENT_DATA", ("all", 12): "SINGLE_CLASS"}
    assert out["all", 0].pr_auc > out["x", 0].pr_auc > out["noise", 0].pr_auc
    assert out["all", 12].recall is None and out["x", 0].prior_pr_auc == pytest.approx(out["x", 0].n_test_pos / out["x", 0].n_test)


def test_drift_uses_one_locked_threshold(spark):
    rows = alerts.locked_drift(model_frame(spark), ["x", "z"]).collect()
    assert {r.kind for r in rows} == {"year", "month"} and len({r.tau_f2 for r in rows}) == 1
    assert sum(r.tp + r.fp + r.fn + r.tn for r in rows if r.kind == "month") == 160
