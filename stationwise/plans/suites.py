"""Model suites over named scopes (sets of stations)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import alerts, labels, linear
from ..session import written


def _rows(part: DataFrame, fixed: Sequence, section: str, item, metrics: Sequence[str]) -> DataFrame:
    """Long rows (fixed columns, section, item, metric, value)."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return part.select(*fixed, F.lit(section).alias("section"), item.cast("string").alias("item"), F.explode(cells).alias("_r")).select(
        *[c if isinstance(c, str) else F.col("model") for c in fixed], "section", "item", "_r.*"
    )


def regression_suite(df: DataFrame, target: str, features: Sequence[str], sets: Mapping[str, Sequence[str]] | None = None, derived: str | None = None, strata: Sequence[str] = ()) -> DataFrame:
    """Tuning, test metrics, VIF, diagnostics, influence, HAC lags, ablation, strata, derived input and backtest of every station in one long table.

    Stations are the scopes: every fit is keyed by station, so there is no loop over them.
    `sets` are the predictor sets of the ablation, `strata` the predictors of the fits per
    year and season, `derived` the column of interpolated targets; sections without their
    input are left out.
    """
    train = df.filter("split = 'train'")
    full = linear.with_constant(train)
    xs = ["one", *features]
    tuned = written(linear.ridge_lasso_tune(train, target, features), "tuned")
    metrics = linear.regression_metrics(linear.model_scores(df, target, features, tuned), [S.STATION, "model"])
    back = linear.rolling_origin(train, target, features)
    k = [S.STATION]
    parts = [
        _rows(tuned, k, "tuning", F.lit("best"), ["ridge_alpha", "ridge_rmse", "lasso_alpha", "lasso_rmse"]),
        _rows(metrics, k, "test", F.col("model"), ["n", "mae", "rmse", "r2", "bias"]),
        _rows(back, k, "backtest", F.col("fold"), ["n", "rmse", "mean_rmse", "r2"]),
        _rows(linear.vif(train, features), k, "vif", F.col("feature"), ["vif"]),
        _rows(linear.line_diagnostics(full, target, xs), k, "diagnostics", F.lit("ols"), ["durbin_watson", "jarque_bera", "breusch_pagan", "reset2_f"]),
        _rows(linear.influence(full, target, xs), k, "influence", F.lit("ols"), ["n_obs", "n_cooks_4n", "cooks_max", "n_high_leverage", "leverage_max", "n_outliers"]),
        _rows(linear.hac_lag_table(full, target, xs, p_values=True), k, "hac_lags", F.concat_ws("/", "term", "lag"), ["coef", "se", "p_value"]),
    ]
    if sets:
        ablation = linear.regression_ablation(df, target, dict(sets))
        parts.append(_rows(ablation, k, "ablation", F.col("spec"), ["n", "n_train", "train_r2", "mae", "rmse", "r2"]))
    if strata:
        stable = linear.stratified_stability(train, target, list(strata))
        parts.append(_rows(stable, k, "strata", F.concat_ws("/", "stratum", "term"), ["n", "coef", "se", "p_value", "rho1", "n_effective"]))
    if derived:
        gap = linear.derived_input_sensitivity(df, target, derived, features)
        parts.append(_rows(gap, k, "derived_input", F.lit("ols"), ["n_observed", "n_derived", "max_abs_beta_diff", "rmse_observed", "rmse_derived"]))
    return reduce(DataFrame.unionByName, parts)


def alert_suite(frame: DataFrame, features: Sequence[str], scopes: Mapping[str, Sequence[str]], trees: int = 100, repeats: int = 20) -> DataFrame:
    """All models of each named scope as (scope, model, section, item, metric, value).

    Sections: status, threshold (tuned on folds inside train), test, calibration, drift (per
    test year and month at the locked threshold), odds, importance, backtest. A scope is a
    handful of station lists given by the caller and a key of one plan: the logistic
    models of all scopes and folds, the baselines and all metrics are one job. The forest is
    fitted once per scope by pyspark.ml and judged at 0.5. Scopes whose train rows hold a
    single class keep their baselines and their status.
    """
    names = F.array_compact(F.array(*[F.when(F.col(S.STATION).isin(list(st)), F.lit(name)) for name, st in scopes.items()]))
    scoped = written(frame.withColumn("scope", F.explode(names)), "scoped")
    key = ["scope"]
    rows = alerts.used_rows(scoped, features, key)
    fits, tau, test = alerts.tuned_models(rows, key, features)
    fits, tau = written(fits, "suite_fits"), written(tau, "suite_thresholds")
    scored = test.select(*key, S.STATION, S.TIME, F.col("label").alias("y"), "score", F.lit("logistic").alias("model"))
    scored = scored.join(fits.filter("status = 'FITTED'").select("scope"), "scope", "left_semi").join(tau.select("scope", "tau_f2"), "scope", "left")
    base = alerts.baseline_scores(scoped, key).withColumn("tau_f2", F.lit(0.5))
    scored = scored.withColumn("tau_f2", F.coalesce("tau_f2", F.lit(0.5))).unionByName(base.select(*scored.columns))
    importances = []
    for name in [r[0] for r in fits.filter("status = 'FITTED'").select("scope").collect()]:  # as many as the caller named
        own = scoped.filter(F.col("scope") == name)
        ready = written(alerts.prepared(own, features), "ready")
        model = alerts.fit_model(ready.filter("split = 'train'"), features, alerts.forest(trees))
        forest = alerts.score_model(model, ready.filter("split = 'test'"), features, "forest")
        scored = scored.unionByName(forest.withColumns({"scope": F.lit(name), "tau_f2": F.lit(0.5)}).select(*scored.columns))
        importances += [(name, f, float(x)) for f, x in zip(features, model.featureImportances.toArray())]
    scored = written(scored, "suite_scores")
    by = ["scope", "model"]
    spark = frame.sparkSession
    fixed = ["scope", F.lit("logistic").alias("model")]
    counts = ["tp", "fp", "fn", "tn", "precision", "recall", "f2", "false_alarm_rate", "pr_auc", "roc_auc", "brier"]
    metrics = alerts.classifier_metrics(scored, [*by, "tau_f2"], F.col("tau_f2"))
    calibration = alerts.calibration_summary(alerts.calibration_table(scored, by), by)
    models = scored.filter("model in ('logistic', 'forest')")
    drift = alerts.drift_table(models, [*by, "tau_f2"], F.col("tau_f2"))
    shuffled = alerts.permutation_importance(scoped, features, repeats, keys=key)
    impurity = spark.createDataFrame(importances, "scope string, feature string, importance double")
    back = alerts.temporal_backtest(scoped, features, keys=key)
    known = F.when(F.col("status") == "FITTED", 1.0).otherwise(0.0).alias("fitted")
    return reduce(
        DataFrame.unionByName,
        [
            _rows(fits.select("scope", "status", "n", "n_pos", known), fixed, "status", F.col("status"), ["n", "n_pos", "fitted"]),
            _rows(tau, fixed, "threshold", F.col("note"), ["tau_f2", "best_f2", "tau_f1", "best_f1", "tau_recall", "best_recall"]),
            _rows(metrics, by, "test", F.col("status"), ["tau_f2", *counts]),
            _rows(calibration, by, "calibration", F.col("status"), ["ece", "n_sufficient_bins"]),
            _rows(drift, by, "drift", F.concat_ws("/", "kind", "period"), ["tau_f2", *counts]),
            _rows(alerts.odds_of(fits, key, features), fixed, "odds", F.col("feature"), ["coef", "odds_ratio"]),
            _rows(shuffled, fixed, "importance", F.col("feature"), ["mean_drop", "sd_drop", "ci_low", "ci_high"]),
            _rows(impurity, ["scope", F.lit("forest").alias("model")], "importance", F.col("feature"), ["importance"]),
            _rows(back, fixed, "backtest", F.concat_ws("/", F.col("fold").cast("string"), "status"), ["n_train", "n", "n_pos", "tau_f2", "recall", "pr_auc", "false_alarm_rate", "brier"]),
        ],
    )


def population_report(labelled: DataFrame) -> DataFrame:
    """Strata and funnel of a labelled grid, for the head of an alert report."""
    strata = labels.coverage_by_stratum(labelled).select(
        S.STATION, F.concat_ws("/", "kind", "stratum").alias("item"), "split", F.col("evaluable").alias("n"),
        F.col("positives_evaluable").alias("positives"),
    )
    funnel = labels.population_funnel(labelled).select(S.STATION, F.col("stage").alias("item"), "split", "n", "positives")
    return strata.unionByName(funnel)
