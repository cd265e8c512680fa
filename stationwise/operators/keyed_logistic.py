"""Logistic models of many keys at once: folds, inner folds, scopes, feature sets and horizons are keys.

A Newton round is one aggregate over all rows: per key the gradient, the weighted
cross-products and the loss. Any number of fits takes the rounds of the slowest one, no
row is written per fit, and only k x k arrays reach NumPy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..session import written
from .sequence import CHUNK
from .splits import expanding_folds, fit_scaler, scaler_wide

#: Rounds that a fit may take, and the largest gradient component per row at which it has settled.
ROUNDS, SETTLED = 60, 1e-10

_ARRAY = T.ArrayType(T.DoubleType())
_STEP = T.StructType(
    [
        T.StructField("beta", _ARRAY),
        T.StructField("last", _ARRAY),
        T.StructField("last_loss", T.DoubleType()),
        T.StructField("gradient", T.DoubleType()),
    ]
)


def newton_step(g, h, loss, beta, last, last_loss, lam, n):
    """Next coefficients; a step that raised the loss is halved, and a settled fit stays.

    The penalty lam / 2 |beta|^2 leaves the intercept (the last coefficient) out.
    """
    k = len(beta)
    ridge = np.append(np.full(k - 1, lam), 0.0)
    total = loss + 0.5 * float(ridge @ (beta * beta))
    grad = g + ridge * beta
    size = float(np.abs(grad).max()) / n
    if last is not None and total > last_loss * (1 + 1e-12) + 1e-12:
        return (beta + last) / 2, last, last_loss, size
    if size <= SETTLED:
        return beta, beta, total, size
    hess = h.reshape(k, k) + np.diag(ridge + 1e-12 * n)
    return beta - np.linalg.lstsq(hess, grad, rcond=1e-14)[0], beta, total, size


@F.pandas_udf(_STEP)
def _next(g: pd.Series, h: pd.Series, loss: pd.Series, beta: pd.Series, last: pd.Series, last_loss: pd.Series, lam: pd.Series, n: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b, c, d, e, f, lam_, m in zip(g, h, loss, beta, last, last_loss, lam, n):
        e = None if e is None else np.asarray(e, float)
        rows.append(newton_step(np.asarray(a, float), np.asarray(b, float), c, np.asarray(d, float), e, f, lam_, m))
    return pd.DataFrame(rows, columns=["beta", "last", "last_loss", "gradient"])


def linear(features: Sequence[str], beta: str = "beta") -> Column:
    """Intercept plus the sum of coefficients times features."""
    z = F.col(beta)[len(features)]
    for i, f in enumerate(features):
        z = z + F.col(beta)[i] * F.col(f)
    return z


def probability(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def fit(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "label", c: float = 1.0, min_rows: int = 2) -> DataFrame:
    """keys, n, n_pos, beta (intercept last), gradient, status: class-balanced L2 logistic fits of all keys.

    `rows` has complete, scaled features. Both classes weigh n / 2, and the penalty is
    1 / (2 c) |beta|^2. status is FITTED, NOT_SETTLED (after ROUNDS rounds), SINGLE_CLASS or
    INSUFFICIENT_DATA; the last two have no coefficients.
    """
    keys, k = list(keys), len(features) + 1
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("n_pos"))
    state_of = F.when(F.col("n") < min_rows, "INSUFFICIENT_DATA").when((F.col("n_pos") == 0) | (F.col("n_pos") == F.col("n")), "SINGLE_CLASS")
    counts = written(counts.withColumn("status", state_of), "fit_counts")
    zeros = F.array(*[F.lit(0.0)] * k)
    none = F.lit(None)
    state = counts.filter("status is null").drop("status").withColumns(
        {"beta": zeros, "last": none.cast(_ARRAY), "last_loss": none.cast("double"), "gradient": none.cast("double")}
    )
    x = [*[F.col(f).cast("double") for f in features], F.lit(1.0)]
    y = F.col(label).cast("double")
    w = F.when(y == 1, F.col("n") / (2.0 * F.col("n_pos"))).otherwise(F.col("n") / (2.0 * (F.col("n") - F.col("n_pos"))))
    for _ in range(ROUNDS):
        z = linear(features)
        at = rows.join(state.select(*keys, "n", "n_pos", "beta"), keys).withColumns({"_z": z}).withColumns({"_p": probability(F.col("_z")), "_w": w})
        pull, curve = F.col("_w") * (F.col("_p") - y), F.col("_w") * F.col("_p") * (1 - F.col("_p"))
        cost = F.col("_w") * (F.greatest("_z", F.lit(0.0)) - F.col("_z") * y + F.log1p(F.exp(-F.abs("_z"))))
        sums = at.groupBy(*keys).agg(
            *[F.sum(pull * v).alias(f"_g{i}") for i, v in enumerate(x)],
            *[F.sum(curve * x[i] * x[j]).alias(f"_h{i}_{j}") for i in range(k) for j in range(i, k)],
            F.sum(cost).alias("_loss"),
        )
        g = F.array(*[F.col(f"_g{i}") for i in range(k)])
        h = F.array(*[F.col(f"_h{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
        step = _next(g, h, "_loss", "beta", "last", "last_loss", F.lit(1.0 / c), F.col("n").cast("double"))
        state = written(sums.join(state.drop("gradient"), keys).withColumn("_s", step).select(*keys, "n", "n_pos", "_s.*"), "newton")
        worst = state.agg(F.max("gradient")).first()[0]
        if worst is None or worst <= SETTLED:
            break
    done = state.select(*keys, "beta", "gradient")
    settled = F.when(F.col("gradient") <= SETTLED, "FITTED").otherwise("NOT_SETTLED")
    return counts.join(done, keys, "left").withColumn("status", F.coalesce("status", settled))


def scored(rows: DataFrame, keys: Sequence[str], fits: DataFrame, features: Sequence[str]) -> DataFrame:
    """rows with `score`; where a key's train rows hold one class (or too few) it is their share of positives."""
    j = rows.join(fits.select(*keys, "beta", (F.col("n_pos") / F.col("n")).alias("_share")), list(keys))
    return j.withColumn("score", F.when(F.col("beta").isNull(), F.col("_share")).otherwise(probability(linear(features)))).drop("beta", "_share")


def scaled(rows: DataFrame, keys: Sequence[str], features: Sequence[str], role: str = "role") -> DataFrame:
    """Features filled with the train median and scaled by the train IQR of each key."""
    keys = list(keys)
    params = fit_scaler(rows, features, F.col(role) == "train", keys)
    wide = written(scaler_wide(params, features, keys), "scaler")
    cols = {}
    for f in features:
        med = F.col(f"_med_{f}")
        cols[f] = (F.coalesce(F.col(f).cast("double"), med) - med) / F.col(f"_iqr_{f}")
    return rows.join(wide, keys).withColumns(cols).drop(*[f"_med_{f}" for f in features], *[f"_iqr_{f}" for f in features])


def fit_and_score(rows: DataFrame, keys: Sequence[str], features: Sequence[str], c: float = 1.0, min_rows: int = 2) -> tuple[DataFrame, DataFrame]:
    """Fits of the rows in role train, and the rows in other roles with their score."""
    ready = scaled(rows, keys, features)
    fits = fit(ready.filter("role = 'train'"), keys, features, c=c, min_rows=min_rows)
    return fits, scored(ready.filter("role != 'train'"), keys, fits, features)


def members(hours: DataFrame, n_folds: int, keys: Sequence[str] = (), name: str = "fold", size: int = CHUNK) -> DataFrame:
    """keys, timestamp, `name` (1 to n_folds) and role of each distinct hour in the expanding folds of each key.

    Folds cut the hours of all stations, because one model learns from all of them.
    """
    scoped = hours.withColumn("_all", F.lit("all"))
    blocks = expanding_folds(scoped, n_folds, [*keys, "_all"], size=size)
    folds = F.sequence(F.greatest(F.col("block"), F.lit(1)), F.lit(n_folds))
    role = F.when(F.col("block") == F.col(name), "validation").otherwise("train")
    return blocks.withColumn(name, F.explode(folds)).select(*keys, S.TIME, name, role.alias("role"))
