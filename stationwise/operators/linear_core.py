"""Least squares from distributed cross-products; only k x k solves run outside Spark expressions.

A fit is one aggregate per group: all products x_i * x_j, x_i * y and y * y.
Groups of any size combine on the map side, and the solver sees one small array
per group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequence import CHUNK, running, windowed

VECTOR = T.ArrayType(T.DoubleType())


def gram(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Row-major X'X, X'y, y'y, sum of y and n per group, over complete rows."""
    cols = [F.col(x).cast("double") for x in xs]
    target = F.col(y).cast("double")
    w = F.lit(1.0) if weight is None else weight
    complete = df.dropna(subset=[y, *xs])
    k = len(xs)
    prods = {(i, j): F.sum(w * cols[i] * cols[j]).alias(f"_p{i}_{j}") for i in range(k) for j in range(i, k)}
    agg = complete.groupBy(*keys).agg(
        *prods.values(),
        *[F.sum(w * c * target).alias(f"_q{i}") for i, c in enumerate(cols)],
        F.sum(w * target * target).alias("yy"),
        F.sum(w * target).alias("sy"),
        F.count(F.lit(1)).alias("n"),
    )
    return agg.select(
        *keys,
        F.array(*[F.col(f"_p{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)]).alias("xx"),
        F.array(*[F.col(f"_q{i}") for i in range(k)]).alias("xy"),
        "yy",
        "sy",
        "n",
    )


_FIT = T.StructType([T.StructField("beta", VECTOR), T.StructField("inv", VECTOR)])


@F.pandas_udf(_FIT)
def _solve(xx: pd.Series, xy: pd.Series, ridge: pd.Series) -> pd.DataFrame:
    beta, inv = [], []
    for a, b, lam in zip(xx, xy, ridge):
        k = len(b)
        m = np.asarray(a, dtype=float).reshape(k, k) + lam * np.eye(k)
        scale = np.sqrt(np.clip(np.diag(m), 1e-300, None))
        scaled = np.linalg.pinv(m / np.outer(scale, scale), rcond=1e-12)
        p = scaled / np.outer(scale, scale)
        beta.append(p @ np.asarray(b, dtype=float))
        inv.append(p.ravel())
    return pd.DataFrame({"beta": beta, "inv": inv})


def solve(grams: DataFrame, ridge: float | Column = 0.0) -> DataFrame:
    """Coefficients, inverse of X'X, residual and total sums of squares, and R2."""
    lam = ridge if isinstance(ridge, Column) else F.lit(float(ridge))
    fitted = grams.withColumn("_fit", _solve("xx", "xy", lam.cast("double"))).withColumns(
        {"beta": F.col("_fit.beta"), "inv": F.col("_fit.inv"), "k": F.size("xy").cast("long")}
    ).drop("_fit")
    k = F.size("xy")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    quad = F.aggregate(
        F.transform(
            "beta",
            lambda bi, i: bi * dot(F.slice(F.col("xx"), (i * k + 1).cast("int"), k), F.col("beta")),
        ),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    sse = F.col("yy") - 2 * dot(F.col("beta"), F.col("xy")) + quad
    return fitted.withColumn("sse", F.greatest(sse, F.lit(0.0))).withColumn(
        "sst", F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    ).withColumn("r2", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")))


def ols(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    return solve(gram(df, keys, y, xs))


def predicted(xs: Sequence[str], beta: Column | str = "beta") -> Column:
    b = F.col(beta) if isinstance(beta, str) else beta
    out = F.lit(0.0)
    for i, x in enumerate(xs):
        out = out + b[i] * F.col(x).cast("double")
    return out


def coefficient_rows(fit: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """One row per coefficient with the classic standard error."""
    k = len(xs)
    s2 = F.try_divide(F.col("sse"), F.col("n") - k)
    cells = [
        F.struct(
            F.lit(x).alias("term"),
            F.col("beta")[i].alias("coef"),
            F.sqrt(F.greatest(s2 * F.col("inv")[i * k + i], F.lit(0.0))).alias("se"),
        )
        for i, x in enumerate(xs)
    ]
    return fit.select(*keys, "n", "r2", F.explode(F.array(*cells)).alias("_r")).select(*keys, "n", "r2", "_r.*")


def hac_meat(
    scored: DataFrame,
    keys: Sequence[str],
    order: str,
    scores: Sequence[str],
    lags: Sequence[int],
    n: str = "n",
    size: int | None = CHUNK,
) -> DataFrame:
    """Bartlett-weighted sum of score cross-products for every lag, in one pass.

    The weighted sum over lags equals the sum of outer products of moving sums
    of L + 1 consecutive scores divided by L + 1, with zeros padded after the
    last row. That costs one window per lag instead of one join per distance.
    Distance is counted in observed rows, not in calendar days. Column n holds
    the group's row count, so the last row can pad itself.
    """
    top = max(lags)
    rows = running(scored.select(*keys, order, n, *scores), keys, order, {"_rn": F.lit(1).cast("long")}, size)
    if top:
        copies = F.when(F.col("_rn") == F.col(n), F.sequence(F.lit(0), F.lit(top))).otherwise(F.array(F.lit(0)))
        rows = rows.withColumn("_k", F.explode(copies)).select(
            *keys,
            (F.col("_rn") + F.col("_k")).alias("_rn"),
            *[F.when(F.col("_k") == 0, F.col(s)).otherwise(0.0).alias(s) for s in scores],
        )
    cols = {}
    for lag in lags:
        for s in scores:
            cols[f"_b{lag}_{s}"] = lambda w, c=s, l=lag: F.sum(c).over(w.rangeBetween(-l, 0))
    moved = windowed(rows, keys, "_rn", cols, back=top, size=size if size is None else max(size, top))
    k = len(scores)
    aggs = [
        F.sum(F.col(f"_b{lag}_{scores[i]}") * F.col(f"_b{lag}_{scores[j]}")).alias(f"_m{lag}_{i}_{j}")
        for lag in lags
        for i in range(k)
        for j in range(i, k)
    ]
    wide = moved.groupBy(*keys).agg(*aggs)
    cells = [
        F.struct(
            F.lit(lag).cast("long").alias("lag"),
            F.array(
                *[F.col(f"_m{lag}_{min(i, j)}_{max(i, j)}") / (lag + 1) for i in range(k) for j in range(k)]
            ).alias("meat"),
        )
        for lag in lags
    ]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("_r")).select(*keys, "_r.*")


@F.pandas_udf(VECTOR)
def _sandwich(inv: pd.Series, meat: pd.Series, scale: pd.Series) -> pd.Series:
    out = []
    for a, m, s in zip(inv, meat, scale):
        k = int(round(len(a) ** 0.5))
        p = np.asarray(a, dtype=float).reshape(k, k)
        out.append((p @ np.asarray(m, dtype=float).reshape(k, k) @ p * s).ravel())
    return pd.Series(out)


def hac_fit(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    xs: Sequence[str],
    order: str,
    lags: Sequence[int],
    small_sample: bool = True,
    size: int | None = CHUNK,
) -> DataFrame:
    """OLS with Newey-West covariance per (keys, lag).

    small_sample scales by n / (n - k); switch it off for the plain sandwich.
    """
    complete = df.dropna(subset=[y, *xs])
    fit = ols(complete, keys, y, xs)
    narrow = complete.select(*keys, order, y, *xs).join(fit.select(*keys, "beta", "n"), list(keys))
    u = F.col(y).cast("double") - predicted(xs)
    scores = {f"_s{i}": F.col(x).cast("double") * u for i, x in enumerate(xs)}
    scored = narrow.select(*keys, order, "n", *[c.alias(s) for s, c in scores.items()])
    meat = hac_meat(scored, keys, order, list(scores), lags, size=size)
    scale = F.coalesce(F.try_divide("n", F.col("n") - F.col("k")), F.lit(1.0)) if small_sample else F.lit(1.0)
    return meat.join(fit, list(keys)).withColumn("cov", _sandwich("inv", "meat", scale.cast("double"))).drop("meat")


def hac_rows(fit: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """One row per (keys, lag, term): coefficient, robust se and t."""
    k = len(xs)
    cells = [
        F.struct(
            F.lit(x).alias("term"),
            F.col("beta")[i].alias("coef"),
            F.sqrt(F.greatest(F.col("cov")[i * k + i], F.lit(0.0))).alias("se"),
        )
        for i, x in enumerate(xs)
    ]
    out = fit.select(*keys, "lag", "n", "k", "r2", F.explode(F.array(*cells)).alias("_r")).select(
        *keys, "lag", "n", "k", "r2", "_r.*"
    )
    return out.withColumn("t", F.try_divide("coef", "se"))


_WALD = T.StructType([T.StructField("f", T.DoubleType()), T.StructField("q", T.LongType())])


def joint_wald(fit: DataFrame, xs: Sequence[str], subset: Sequence[str]) -> DataFrame:
    """F statistic for a subset of coefficients being zero, on top of hac_fit rows."""
    at = [list(xs).index(s) for s in subset]

    @F.pandas_udf(_WALD)
    def wald(beta: pd.Series, cov: pd.Series) -> pd.DataFrame:
        f = []
        for b, c in zip(beta, cov):
            b = np.asarray(b, dtype=float)
            v = np.asarray(c, dtype=float).reshape(len(b), len(b))
            r = b[at]
            f.append(float(r @ np.linalg.pinv(v[np.ix_(at, at)]) @ r) / len(at))
        return pd.DataFrame({"f": f, "q": [len(at)] * len(f)})

    return fit.withColumn("_w", wald("beta", "cov")).withColumns(
        {"f": F.col("_w.f"), "df1": F.col("_w.q"), "df2": F.col("n") - F.col("k")}
    ).drop("_w")
