"""Regression on hourly tables: diagnostics, robust errors, regularisation, backtests.

Every fit is a Gram aggregate per key (see linear_core), so stations, folds and
strata are fitted together; rows are revisited only to score them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import dist
from ..functions import scalar as fn
from .joins import value_at_offset
from .linear_core import VECTOR, gram, hac_fit, hac_rows, ols, predicted, solve
from .profile import quantile_bins
from .sequence import CHUNK, hour_number, running, windowed
from .splits import apply_scaler, expanding_folds, fit_scaler

KEYS = (S.STATION,)


def with_constant(df: DataFrame) -> DataFrame:
    return df.withColumn("one", F.lit(1.0))


@F.pandas_udf(VECTOR)
def _vif(xx: pd.Series) -> pd.Series:
    out = []
    for a in xx:
        k = int(round(len(a) ** 0.5))
        m = np.asarray(a, dtype=float).reshape(k, k)
        n, s = m[0, 0], m[0, 1:]
        cov = m[1:, 1:] - np.outer(s, s) / n
        sd = np.sqrt(np.clip(np.diag(cov), 1e-300, None))
        out.append(np.diag(np.linalg.pinv(cov / np.outer(sd, sd))))
    return pd.Series(out)


def vif(df: DataFrame, features: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Variance inflation per predictor: diagonal of the inverse correlation matrix."""
    g = gram(with_constant(df).withColumn("_y", F.lit(0.0)), keys, "_y", ["one", *features])
    cells = [F.struct(F.lit(f).alias("feature"), F.col("_v")[i].alias("vif")) for i, f in enumerate(features)]
    return g.withColumn("_v", _vif("xx")).select(*keys, "n", F.explode(F.array(*cells)).alias("_r")).select(*keys, "n", "_r.*")


def residual_rows(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], time: str = S.TIME, fit: DataFrame | None = None, size: int | None = CHUNK) -> DataFrame:
    """Fitted values and residuals with a dense row number per key."""
    complete = df.dropna(subset=[y, *xs])
    fit = ols(complete, keys, y, xs) if fit is None else fit
    fit = fit.select(*keys, "beta", "inv", "n", "k", "sse")
    scored = complete.join(fit, list(keys)).withColumn("fitted", predicted(xs)).withColumn("resid", F.col(y) - F.col("fitted"))
    return running(scored.withColumn("_hour", hour_number(time)), list(keys), "_hour", {"rn": F.lit(1).cast("long")}, size).drop("_hour")


def line_diagnostics(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = KEYS, lags: Sequence[int] = (1, 24), p_values: bool = False) -> DataFrame:
    """Residual checks: mean, correlation with the fit, Durbin-Watson, ACF, moments, Breusch-Pagan, RESET, plug-in lag."""
    keys = list(keys)
    rows = residual_rows(df, y, xs, keys)
    e = F.col("resid")
    moved = windowed(
        rows.select(*keys, "rn", "resid", "fitted"),
        keys,
        "rn",
        {f"_l{l}": lambda w, l=l: F.max("resid").over(w.rangeBetween(-l, -l)) for l in lags},
        back=max(lags),
    )
    base = moved.groupBy(*keys).agg(
        F.count(e).alias("n"),
        F.avg(e).alias("resid_mean"),
        fn.safe_corr("resid", "fitted").alias("resid_fitted_corr"),
        F.try_divide(F.sum(F.pow(e - F.col("_l1"), 2)), F.sum(e * e)).alias("durbin_watson"),
        *[F.try_divide(F.sum(e * F.col(f"_l{l}")), F.sum(e * e)).alias(f"acf_{l}") for l in lags],
        F.skewness(e).alias("skewness"),
        F.kurtosis(e).alias("kurtosis"),
    )
    n = F.col("n").cast("double")
    base = base.withColumns(
        {
            "jarque_bera": n / 6 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4),
            "plugin_lag": F.greatest(F.lit(1), F.floor(4 * F.pow(n / 100, F.lit(2 / 9)))).cast("long"),
        }
    )
    squared = rows.withColumn("_e2", e * e)
    bp = ols(squared, keys, "_e2", xs).select(*keys, (F.col("n") * F.col("r2")).alias("breusch_pagan"))
    spread = rows.groupBy(*keys).agg(F.avg("fitted").alias("_fm"), F.stddev_samp("fitted").alias("_fs"))
    powers = rows.join(spread, keys).withColumn("_z", F.try_divide(F.col("fitted") - F.col("_fm"), F.col("_fs")))
    powers = powers.withColumns({"_z2": F.col("_z") ** 2, "_z3": F.col("_z") ** 3}).select(*keys, y, *xs, "_z2", "_z3", "sse")
    out = base.join(bp, keys)
    sse0 = powers.groupBy(*keys).agg(F.max("sse").alias("_sse0"))
    for p, extra in ((2, ["_z2"]), (3, ["_z2", "_z3"])):
        q, k = len(extra), len(xs) + len(extra)
        aux = ols(powers, keys, y, [*xs, *extra]).join(sse0, keys)
        f = F.try_divide((F.col("_sse0") - F.col("sse")) / q, F.try_divide(F.col("sse"), F.col("n") - k))
        aux = aux.select(*keys, f.alias(f"reset{p}_f"), (F.col("n") - k).alias("_dof"))
        if p_values:
            aux = aux.withColumn(f"reset{p}_p", dist.f_sf(F.col(f"reset{p}_f"), q, F.col("_dof")))
        out = out.join(aux.drop("_dof"), keys)
    if p_values:
        out = out.withColumns(
            {
                "jarque_bera_p": dist.chi2_sf(F.col("jarque_bera"), 2),
                "breusch_pagan_p": dist.chi2_sf(F.col("breusch_pagan"), len(xs) - 1),
            }
        )
    return out


def binned_residuals(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = KEYS, bins: int = 10) -> DataFrame:
    """Mean residual per quantile bin of the fitted value."""
    rows = residual_rows(df, y, xs, list(keys)).select(*keys, "fitted", "resid")
    return quantile_bins(rows, list(keys), "fitted", bins).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("fitted").alias("mean_fitted"),
        F.avg("resid").alias("mean_resid"),
        F.stddev_samp("resid").alias("sd_resid"),
    )


def influence_rows(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Leverage, externally studentised residual and Cook's distance per row."""
    k = len(xs)
    complete = df.dropna(subset=[y, *xs])
    fit = ols(complete, keys, y, xs).select(*keys, "beta", "inv", "n", "sse")
    rows = complete.join(fit, list(keys)).withColumn("fitted", predicted(xs))
    h = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            h = h + F.col("inv")[i * k + j] * F.col(xs[i]).cast("double") * F.col(xs[j]).cast("double")
    rows = rows.withColumns({"resid": F.col(y) - F.col("fitted"), "leverage": h})
    e, hh, dof = F.col("resid"), F.col("leverage"), F.col("n") - k
    s2 = F.try_divide(F.col("sse"), dof)
    s2_out = F.try_divide(F.col("sse") - F.try_divide(e * e, 1 - hh), dof - 1)
    return rows.withColumns(
        {
            "studentized": F.try_divide(e, F.sqrt(F.greatest(s2_out * (1 - hh), F.lit(0.0)))),
            "cooks_d": F.try_divide(e * e * hh, k * s2 * (1 - hh) * (1 - hh)),
        }
    ).drop("beta", "inv", "sse")


def influence(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts over the usual influence thresholds."""
    k = len(xs)
    rows = influence_rows(df, y, xs, keys)
    far, high = F.abs("studentized") > 3, F.col("leverage") > 2.0 * k / F.col("n")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count_if(F.col("cooks_d") > 4.0 / F.col("n")).alias("n_cooks_4n"),
        F.count_if(F.col("cooks_d") > 0.5).alias("n_cooks_05"),
        F.count_if(F.col("cooks_d") > 1.0).alias("n_cooks_10"),
        F.max("cooks_d").alias("cooks_max"),
        F.count_if(high).alias("n_high_leverage"),
        F.max("leverage").alias("leverage_max"),
        F.count_if(far).alias("n_outliers"),
        F.count_if(far & high).alias("n_outlier_and_leverage"),
    )


def top_influential(df: DataFrame, y: str, xs: Sequence[str], k: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    return (
        influence_rows(df, y, xs, keys)
        .select(*keys, S.TIME, y, "fitted", "resid", "studentized", "leverage", "cooks_d")
        .orderBy(F.desc("cooks_d"), *keys, S.TIME)
        .limit(k)
    )


def plugin_lags(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str]) -> list[int]:
    """Distinct plug-in lags of the groups; below 60 for any group of fewer than a billion rows."""
    n = df.dropna(subset=[y, *xs]).groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"))
    lag = F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9)))).cast("int")
    return sorted(r[0] for r in n.select(lag).distinct().collect())


def hac_lag_table(df: DataFrame, y: str, xs: Sequence[str], lags: Sequence[int] = (12, 24, 48, 72, 168), keys: Sequence[str] = KEYS, order: str = "_hour", p_values: bool = False) -> DataFrame:
    """Coefficients with robust errors per lag; lag 0 is HC1, the plug-in lag of each group is included.

    Larger lags use the plain sandwich and normal p-values.
    """
    keys = list(keys)
    keyed = df.withColumn("_hour", hour_number(S.TIME)) if order == "_hour" else df
    every = sorted({0, *plugin_lags(df, y, xs, keys), *lags})
    rows = hac_rows(hac_fit(keyed, keys, y, xs, order, every, small_sample=False), keys, xs)
    plug = F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2 / 9))))
    keep = F.col("lag").isin([0, *lags]) | (F.col("lag") == plug)
    hc1 = F.sqrt(F.col("n") / (F.col("n") - F.col("k")))
    se = F.when(F.col("lag") == 0, F.col("se") * hc1).otherwise(F.col("se"))
    out = rows.filter(keep).withColumn("se", se).withColumn("z", F.try_divide("coef", "se")).select(
        *keys, "lag", "n", "term", "coef", "se", "z"
    )
    return out.withColumn("p_value", dist.norm_two_sided(F.col("z"))) if p_values else out


def regression_metrics(scored: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred", p: str = "n_predictors") -> DataFrame:
    """MAE, RMSE, R2, adjusted R2 and bias of scored rows."""
    err = F.col(pred) - F.col(y)
    n, pp = F.col("n").cast("double"), F.col("_p")
    agg = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(p).alias("_p"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.try_divide(F.sum(err * err), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
        F.avg(err).alias("bias"),
    )
    return agg.withColumn(
        "adjusted_r2", F.when(n > pp + 1, 1 - (1 - F.col("r2")) * (n - 1) / (n - pp - 1))
    ).withColumnRenamed("_p", "n_predictors")


# --- folds, regularisation and backtests -----------------------------------


def fold_rows(df: DataFrame, n_folds: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every fold's train and validation rows as one long table (fold, role)."""
    blocks = expanding_folds(df, n_folds, keys)
    folds = F.sequence(F.greatest(F.col("block"), F.lit(1)), F.lit(n_folds))
    return blocks.withColumn("fold", F.explode(folds)).withColumn(
        "role", F.when(F.col("block") == F.col("fold"), "validation").otherwise("train")
    )


_PATH = T.ArrayType(
    T.StructType(
        [
            T.StructField("alpha", T.DoubleType()),
            T.StructField("ridge_rmse", T.DoubleType()),
            T.StructField("lasso_rmse", T.DoubleType()),
        ]
    )
)


def _centred(xx, xy, yy, n):
    m = np.asarray(xx, dtype=float)
    k = int(round(len(m) ** 0.5))
    m = m.reshape(k, k)
    q = np.asarray(xy, dtype=float)
    mean_x, mean_y = m[0, 1:] / n, q[0] / n
    return m[1:, 1:] - n * np.outer(mean_x, mean_x), q[1:] - n * mean_x * mean_y, mean_x, mean_y


def lasso_gram(a, b, n, alpha, start=None, rounds=5000, tol=1e-10):
    """Coordinate descent on centred cross-products for (1/2n)||y - Xw||^2 + alpha |w|; an error if it doesn't settle."""
    w = np.zeros(len(b)) if start is None else start.copy()
    for _ in range(rounds):
        shift = 0.0
        for j in range(len(b)):
            if a[j, j] <= 0:
                continue
            r = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - n * alpha, 0.0) / a[j, j]
            shift = max(shift, abs(new - w[j]) * np.sqrt(a[j, j] / n))
            w[j] = new
        if shift < tol:
            return w
    raise ArithmeticError(f"lasso has not converged in {rounds} rounds at alpha {alpha}: last step {shift:.3g}")


def _path_udf(alphas: Sequence[float]):
    @F.pandas_udf(_PATH)
    def path(xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series, vxx: pd.Series, vxy: pd.Series, vyy: pd.Series, vn: pd.Series) -> pd.Series:
        out = []
        for row in zip(xx, xy, yy, n, vxx, vxy, vyy, vn):
            a, b, mx, my = _centred(*row[:4])
            k = len(b) + 1
            vm, vq = np.asarray(row[4], dtype=float).reshape(k, k), np.asarray(row[5], dtype=float)

            def rmse(w, mx=mx, my=my, vm=vm, vq=vq, row=row):
                full = np.concatenate([[my - mx @ w], w])
                return float(np.sqrt(max(row[6] - 2 * full @ vq + full @ vm @ full, 0.0) / row[7]))

            warm, lasso = None, {}
            for alpha in sorted(alphas, reverse=True):
                warm = lasso_gram(a, b, row[3], alpha, warm)
                lasso[alpha] = rmse(warm)
            ridge = {al: rmse(np.linalg.solve(a + al * np.eye(k - 1), b)) for al in alphas}
            out.append([{"alpha": float(al), "ridge_rmse": ridge[al], "lasso_rmse": lasso[al]} for al in alphas])
        return pd.Series(out)

    return path


def regularization_path(train: DataFrame, y: str, features: Sequence[str], alphas: Sequence[float], n_folds: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Validation RMSE of ridge and lasso per (fold, alpha), from one Gram per fold and role.

    Fill values and scales are refitted on each fold's own train rows.
    """
    keys = list(keys)
    folds = fold_rows(train.dropna(subset=[y]).select(*keys, S.TIME, y, *features), n_folds, keys)
    k = [*keys, "fold"]
    params = fit_scaler(folds, features, F.col("role") == "train", k)
    scaled = with_constant(apply_scaler(folds, params, features, k))
    g = gram(scaled, [*k, "role"], y, ["one", *features])
    tr = g.filter("role = 'train'").drop("role")
    va = g.filter("role = 'validation'").select(
        *k, F.col("xx").alias("vxx"), F.col("xy").alias("vxy"), F.col("yy").alias("vyy"), F.col("n").alias("vn")
    )
    path = _path_udf([float(a) for a in alphas])("xx", "xy", "yy", F.col("n").cast("double"), "vxx", "vxy", "vyy", F.col("vn").cast("double"))
    return tr.join(va, k).select(*k, F.explode(path).alias("_r")).select(*k, "_r.*")


def ridge_lasso_tune(train: DataFrame, y: str, features: Sequence[str], alphas: Sequence[float] | None = None, n_folds: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Best ridge and lasso penalty per key: smallest mean validation RMSE, the smaller penalty on ties."""
    alphas = [float(a) for a in (np.logspace(-3, 3, 50) if alphas is None else alphas)]
    path = regularization_path(train, y, features, alphas, n_folds, keys)
    mean = path.groupBy(*keys, "alpha").agg(F.avg("ridge_rmse").alias("r"), F.avg("lasso_rmse").alias("l"))
    return mean.groupBy(*keys).agg(
        F.min_by("alpha", F.struct("r", "alpha")).alias("ridge_alpha"),
        F.min("r").alias("ridge_rmse"),
        F.min_by("alpha", F.struct("l", "alpha")).alias("lasso_alpha"),
        F.min("l").alias("lasso_rmse"),
    )


@F.pandas_udf(VECTOR)
def _penalised(xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series, ridge: pd.Series, lasso: pd.Series) -> pd.Series:
    """Intercept and weights of ridge, then of lasso."""
    out = []
    for row in zip(xx, xy, yy, n, ridge, lasso):
        a, b, mx, my = _centred(*row[:4])
        wr = np.linalg.solve(a + row[4] * np.eye(len(b)), b)
        wl = lasso_gram(a, b, row[3], row[5])
        out.append(np.concatenate([[my - mx @ wr], wr, [my - mx @ wl], wl]))
    return pd.Series(out)


def model_scores(df: DataFrame, y: str, features: Sequence[str], tuned: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Test rows scored by the train mean, OLS, ridge and lasso, as long rows (model, y, pred, n_predictors)."""
    keys = list(keys)
    rows = df.dropna(subset=[y])
    params = fit_scaler(rows, features, F.col("split") == "train", keys)
    scaled = with_constant(apply_scaler(rows, params, features, keys))
    xs = ["one", *features]
    k = len(xs)
    g = solve(gram(scaled.filter("split = 'train'"), keys, y, xs)).join(tuned.select(*keys, "ridge_alpha", "lasso_alpha"), keys)
    fit = g.select(
        *keys,
        "beta",
        (F.col("sy") / F.col("n")).alias("_mean"),
        _penalised("xx", "xy", "yy", F.col("n").cast("double"), "ridge_alpha", "lasso_alpha").alias("_w"),
    )
    active = F.aggregate(
        F.slice("_w", k + 2, k - 1), F.lit(0), lambda s, v: s + (F.abs(v) > 1e-12).cast("int")
    )
    test = scaled.filter("split = 'test'").join(fit, keys)
    cells = F.array(
        F.struct(F.lit("mean").alias("model"), F.col("_mean").alias("pred"), F.lit(0).alias("n_predictors")),
        F.struct(F.lit("ols").alias("model"), predicted(xs).alias("pred"), F.lit(k - 1).alias("n_predictors")),
        F.struct(F.lit("ridge").alias("model"), predicted(xs, F.slice("_w", 1, k)).alias("pred"), F.lit(k - 1).alias("n_predictors")),
        F.struct(F.lit("lasso").alias("model"), predicted(xs, F.slice("_w", k + 1, k)).alias("pred"), active.alias("n_predictors")),
    )
    return test.select(*keys, S.TIME, F.col(y).alias("y"), F.explode(cells).alias("_m")).select(*keys, S.TIME, "y", "_m.*")


def _fit_and_score(df: DataFrame, y: str, features: Sequence[str], keys: Sequence[str], role: str = "split", score: str = "test") -> DataFrame:
    """OLS with train-median fill; rows of the scored role with y, pred and the train mean."""
    keys = list(keys)
    xs = ["one", *features]
    if features:
        params = fit_scaler(df, features, F.col(role) == "train", keys)
        df = apply_scaler(df, params, features, keys, scale=False)
    full = with_constant(df)
    fit = ols(full.filter(F.col(role) == "train"), keys, y, xs)
    fit = fit.select(*keys, "beta", F.col("r2").alias("train_r2"), F.col("n").alias("n_train"), (F.col("sy") / F.col("n")).alias("train_mean"))
    return full.filter(F.col(role) == score).join(fit, keys).select(
        *keys, S.TIME, F.col(y).alias("y"), predicted(xs).alias("pred"), "train_mean", "train_r2", "n_train",
        F.lit(len(features)).alias("n_predictors"),
    )


def regression_ablation(df: DataFrame, y: str, sets: dict[str, Sequence[str]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Train and test metrics per predictor set; a set naming lag_24h uses only rows that have it."""
    keys = list(keys)
    lagged = value_at_offset(df, 24, y, "lag_24h")
    parts = []
    for name, features in sets.items():
        rows = lagged.dropna(subset=[y, "lag_24h"] if "lag_24h" in features else [y])
        scored = _fit_and_score(rows.select(*keys, S.TIME, "split", y, *features), y, features, keys)
        m = regression_metrics(scored, keys).join(
            scored.groupBy(*keys).agg(F.max("train_r2").alias("train_r2"), F.max("n_train").alias("n_train")), keys
        )
        parts.append(m.withColumn("spec", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def rolling_origin(df: DataFrame, y: str, features: Sequence[str], n_folds: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Expanding-window backtest: OLS against the train mean on each validation block."""
    folds = fold_rows(df.dropna(subset=[y]).select(*keys, S.TIME, y, *features), n_folds, keys)
    k = [*keys, "fold"]
    scored = _fit_and_score(folds, y, features, k, "role", "validation")
    span = scored.groupBy(*k).agg(
        F.max("n_train").alias("n_train"),
        F.min(S.TIME).alias("first_hour"),
        F.max(S.TIME).alias("last_hour"),
        F.sqrt(F.avg(F.pow(F.col("y") - F.col("train_mean"), 2))).alias("mean_rmse"),
    )
    return regression_metrics(scored, k).select(*k, "n", "mae", "rmse", "r2").join(span, k).withColumn(
        "fold", F.col("fold").cast("long")
    )


def stratified_stability(df: DataFrame, y: str, features: Sequence[str], lag: int = 24, min_rows: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """Coefficients with robust p-values, residual dependence and coverage status per year and season."""
    strata = F.array(
        F.concat(F.lit("Year "), F.year(S.TIME).cast("string")), F.concat(F.lit("Season "), fn.season_long(S.TIME))
    )
    k = [*keys, "stratum"]
    long = with_constant(df.dropna(subset=[y, *features])).withColumn("stratum", F.explode(strata))
    long = long.select(*k, S.TIME, y, "one", *features).withColumn("_hour", hour_number(S.TIME))
    xs = ["one", *features]
    rows = hac_rows(hac_fit(long, k, y, xs, "_hour", [lag], small_sample=False), k, xs)
    coefs = rows.withColumn("p_value", dist.norm_two_sided(F.col("t"))).filter("term <> 'one'")
    resid = residual_rows(long, y, xs, k).select(*k, "rn", "resid")
    moved = windowed(resid, k, "rn", {"_prev": lambda w: F.max("resid").over(w.rangeBetween(-1, -1))}, back=1)
    dep = moved.groupBy(*k).agg(fn.safe_corr("resid", "_prev").alias("rho1"))
    eff = F.greatest(F.lit(1.0), F.col("n") * (1 - F.col("rho1")) / F.greatest(F.lit(1e-6), 1 + F.col("rho1")))
    out = coefs.join(dep, k).withColumn("n_effective", eff)
    status = (
        F.when(F.col("n") < min_rows, "TOO_FEW_ROWS").when(F.round("n_effective") < 30, "LOW_NEFF").otherwise("SUFFICIENT")
    )
    return out.select(*k, "term", "n", "r2", "coef", "se", "p_value", "rho1", "n_effective", status.alias("coverage_status"))


def derived_input_sensitivity(df: DataFrame, y: str, derived: str, features: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Fit on observed against fit on interpolated train targets; the test side stays observed."""
    keys = list(keys)
    xs = ["one", *features]
    train = F.col("split") == "train"
    seen = with_constant(df.filter(train)).dropna(subset=xs)
    obs = ols(seen, keys, y, xs).select(*keys, F.col("beta").alias("_bo"), F.col("n").alias("n_observed"))
    der = ols(seen, keys, derived, xs).select(*keys, F.col("beta").alias("_bd"), F.col("n").alias("n_derived"))
    both = obs.join(der, keys)
    gap = F.array_max(F.zip_with("_bo", "_bd", lambda p, q: F.abs(p - q)))
    test = with_constant(df.filter(~train)).dropna(subset=[y, *xs]).join(both, keys)
    eo, ed = predicted(xs, "_bo") - F.col(y), predicted(xs, "_bd") - F.col(y)
    scored = test.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg(F.abs(eo)).alias("mae_observed"),
        F.avg(F.abs(ed)).alias("mae_derived"),
        F.sqrt(F.avg(eo * eo)).alias("rmse_observed"),
        F.sqrt(F.avg(ed * ed)).alias("rmse_derived"),
        F.avg(eo).alias("bias_observed"),
        F.avg(ed).alias("bias_derived"),
    )
    return both.select(*keys, "n_observed", "n_derived", gap.alias("max_abs_beta_diff")).join(scored, keys)
