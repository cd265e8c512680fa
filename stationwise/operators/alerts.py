"""Alert models and their evaluation.

Evaluation operators read a scored table (keys, y, score) and do not care where
the score came from. Curves are built on counted distinct scores with prefix sums
over score buckets, so a model that scored billions of rows stays distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import scalar as fn
from ..session import written
from . import keyed_logistic as keyed
from .sequence import hour_number, running
from .splits import apply_scaler, fit_scaler

THRESHOLDS = [float(t) for t in np.linspace(0.10, 0.90, 81)]


# --- evaluation of given scores ---------------------------------------------


def score_curve(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score", buckets: int = 1024) -> DataFrame:
    """Per distinct score: rows and positives at it and at or above it, with the totals."""
    keys = list(keys)
    counted = (
        df.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, score)
        .agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.col(y).cast("long")).alias("pos"))
        .withColumn("_b", F.floor(F.col(score) * buckets).cast("long"))
    )
    whole = W.partitionBy(*keys)
    above = whole.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    totals = (
        counted.groupBy(*keys, "_b")
        .agg(F.sum("cnt").alias("_c"), F.sum("pos").alias("_p"))
        .select(
            *keys,
            "_b",
            F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("_ca"),
            F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_pa"),
            F.sum("_c").over(whole).alias("n"),
            F.sum("_p").over(whole).alias("n_pos"),
        )
    )
    inside = W.partitionBy(*keys, "_b").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    return counted.join(totals, [*keys, "_b"]).select(
        *keys,
        score,
        "cnt",
        "pos",
        (F.col("_ca") + F.sum("cnt").over(inside)).alias("n_ge"),
        (F.col("_pa") + F.sum("pos").over(inside)).alias("tp_ge"),
        "n",
        "n_pos",
    )


def pr_curve_points(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """Precision and recall at each distinct score."""
    c = score_curve(df, keys, y, score)
    return c.select(
        *keys,
        score,
        (F.col("tp_ge") / F.col("n_ge")).alias("precision"),
        F.try_divide("tp_ge", "n_pos").alias("recall"),
        "n_ge",
        "tp_ge",
    )


def ranking_metrics(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """ROC-AUC and step-wise average precision; NULL without both classes."""
    c = score_curve(df, keys, y, score)
    neg_at = F.col("cnt") - F.col("pos")
    neg_below = (F.col("n") - F.col("n_pos")) - (F.col("n_ge") - F.col("tp_ge"))
    agg = c.groupBy(*keys).agg(
        F.sum(F.col("pos") * (neg_below + 0.5 * neg_at)).alias("_auc"),
        F.sum(F.col("pos") * F.col("tp_ge") / F.col("n_ge")).alias("_ap"),
        F.max("n_pos").cast("double").alias("_p"),
        F.max("n").cast("double").alias("_n"),
    )
    both = (F.col("_p") > 0) & (F.col("_p") < F.col("_n"))
    return agg.select(
        *keys,
        F.when(both, F.col("_auc") / (F.col("_p") * (F.col("_n") - F.col("_p")))).alias("roc_auc"),
        F.when(both, F.col("_ap") / F.col("_p")).alias("pr_auc"),
    )


def classifier_metrics(df: DataFrame, keys: Sequence[str], threshold: float | Column = 0.5, y: str = "y", score: str = "score") -> DataFrame:
    """Confusion counts, rates, Brier score and ranking metrics; UNESTIMABLE without positives."""
    keys = list(keys)
    tau = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, pos = F.col(score) >= tau, F.col(y) == 1
    base = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("brier"),
    )
    tp, fp, fn_, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    both = (tp + fn_ > 0) & (fp + tn > 0)

    def when_both(c: Column) -> Column:
        return F.when(both, c)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    out = base.withColumns(
        {
            "accuracy": (tp + tn) / (tp + fp + fn_ + tn),
            "precision": F.when(both, ratio(tp, tp + fp)).when(tp + fp > 0, 0.0),
            "recall": when_both(ratio(tp, tp + fn_)),
            "f1": when_both(ratio(2 * tp, 2 * tp + fp + fn_)),
            "f2": when_both(ratio(5 * tp, 5 * tp + fp + 4 * fn_)),
            "false_alarm_rate": F.try_divide(fp, fp + tn),
            "status": F.when(both, "OK").otherwise("UNESTIMABLE"),
        }
    )
    return out.join(ranking_metrics(df, keys, y, score), keys)


def threshold_table(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """Confusion counts at every threshold of the grid, from one count per (threshold step, class)."""
    keys = list(keys)
    grid = F.array(*[F.lit(t) for t in THRESHOLDS])
    # number of thresholds at or below the score
    step = F.size(F.filter(grid, lambda t: t <= F.col(score)))
    counted = df.select(*keys, step.alias("_s"), F.col(y).cast("long").alias("_y")).groupBy(*keys, "_s").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("_y").alias("_p")
    )
    # a count at step s is at or above the first s thresholds
    spread = counted.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(THRESHOLDS))))).select(
        *keys, "_i", F.when(F.col("_i") <= F.col("_s"), F.col("_c")).otherwise(0).alias("_c"),
        F.when(F.col("_i") <= F.col("_s"), F.col("_p")).otherwise(0).alias("_p"),
    )
    sums = spread.groupBy(*keys, "_i").agg(F.sum("_c").alias("n_hit"), F.sum("_p").alias("tp"))
    total = sums.filter("_i = 0").select(*keys, F.col("tp").alias("n_pos"))
    return (
        sums.filter("_i > 0")
        .join(total, keys)
        .withColumn("threshold", F.element_at(grid, F.col("_i")))
        .withColumns(
            {
                "precision": F.coalesce(F.try_divide("tp", "n_hit"), F.lit(0.0)),
                "recall": F.coalesce(F.try_divide("tp", "n_pos"), F.lit(0.0)),
                "f1": F.coalesce(F.try_divide(2 * F.col("tp"), F.col("n_hit") + F.col("n_pos")), F.lit(0.0)),
                "f2": F.coalesce(F.try_divide(5 * F.col("tp"), F.col("n_hit") + 4 * F.col("n_pos")), F.lit(0.0)),
            }
        )
        .drop("_i")
    )


def tune_threshold(df: DataFrame, keys: Sequence[str], min_precision: float = 0.60, y: str = "y", score: str = "score") -> DataFrame:
    """Best threshold by F2, by F1, and by recall under a precision floor (F2 as fallback); the lowest wins ties."""
    t = threshold_table(df, keys, y, score)
    best = lambda c, ok=None: F.max_by(
        "threshold", F.struct(c, -F.col("threshold")) if ok is None else F.when(ok, F.struct(c, -F.col("threshold")))
    )
    ok = F.col("precision") >= min_precision
    out = t.groupBy(*keys).agg(
        best("f2").alias("tau_f2"),
        F.max("f2").alias("best_f2"),
        best("f1").alias("tau_f1"),
        F.max("f1").alias("best_f1"),
        best("recall", ok).alias("_tau_r"),
        F.max(F.when(ok, F.col("recall"))).alias("best_recall"),
    )
    edge = lambda c: (F.col(c) <= 0.10 + 1e-9) | (F.col(c) >= 0.90 - 1e-9)
    return out.withColumn("tau_recall", F.coalesce("_tau_r", "tau_f2")).withColumn(
        "note", F.when(F.col("_tau_r").isNull(), "fallback_f2").when(edge("tau_recall"), "grid_edge").otherwise("ok")
    ).drop("_tau_r")


def calibration_table(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score", min_bin: int = 10) -> DataFrame:
    """Ten equal bins: mean score, event rate, gap."""
    b = F.least(F.floor(F.col(score) * 10), F.lit(9)).cast("long")
    return df.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_score"),
        F.avg(F.col(y).cast("double")).alias("event_rate"),
        (F.count(F.lit(1)) >= min_bin).alias("sufficient"),
    )


def calibration_summary(table: DataFrame, keys: Sequence[str], min_bins: int = 2) -> DataFrame:
    """Expected calibration error and how many bins carry it."""
    gap = F.abs(F.col("mean_score") - F.col("event_rate"))
    return table.groupBy(*keys).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"),
        F.count_if("sufficient").alias("n_sufficient_bins"),
        F.when(F.count_if("sufficient") >= min_bins, "OK").otherwise("TOO_FEW_BINS").alias("status"),
    )


def drift_table(df: DataFrame, keys: Sequence[str], threshold: float | Column, y: str = "y", score: str = "score") -> DataFrame:
    """Metrics per year and per month at a locked threshold."""
    tags = F.array(
        F.struct(F.lit("year").alias("kind"), F.year(S.TIME).cast("string").alias("period")),
        F.struct(F.lit("month").alias("kind"), F.date_format(S.TIME, "yyyy-MM").alias("period")),
    )
    long = df.withColumn("_t", F.explode(tags)).select(*df.columns, "_t.*")
    return classifier_metrics(long, [*keys, "kind", "period"], threshold, y, score)


# --- models -------------------------------------------------------------------


def balanced_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (2 * n_class) per row, from one small aggregate joined back on the class."""
    per = train.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    per = per.withColumn("weight", F.sum("_c").over(W.partitionBy(F.lit(0))) / (2.0 * F.col("_c"))).drop("_c")
    return train.join(per, label)


def prepared(frame: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Used rows with train-only fill and robust scale, pooled over the scope unless keys say otherwise."""
    used = frame.filter("row_state = 'used'").withColumn("_scope", F.lit("all"))
    k = [*keys, "_scope"]
    params = fit_scaler(used, features, F.col("split") == "train", k)
    return apply_scaler(used, params, features, k).drop("_scope")


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep").transform(df)


def logistic(c: float = 1.0, n_train: int = 1, max_iter: int = 100) -> LogisticRegression:
    """L2 logistic regression whose penalty equals an inverse strength of c on summed weights."""
    return LogisticRegression(
        featuresCol="_x",
        labelCol="label",
        weightCol="weight",
        regParam=1.0 / (c * n_train),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-6,
    )


def forest(trees: int = 100, depth: int = 8, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="_x", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed
    )


def fit_model(train: DataFrame, features: Sequence[str], estimator):
    """Fit any pyspark.ml classifier with probability output on balanced rows of one scope."""
    return estimator.fit(_assembled(balanced_weights(train), features))


def score_model(model, rows: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    out = model.transform(_assembled(rows, features))
    return out.select(
        S.STATION,
        S.TIME,
        F.col("label").alias("y"),
        vector_to_array("probability")[1].alias("score"),
        F.lit(name).alias("model"),
    )


def baseline_scores(frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Prior (train share of positives) and persistence (past mean) scores of the test rows, per key."""
    k = [*keys, "_scope"]
    used = frame.filter("row_state = 'used'").withColumn("_scope", F.lit("all"))
    train = used.filter("split = 'train'").groupBy(*k).agg(F.avg("label").alias("_prior"), F.avg("past_mean").alias("_fill"))
    test = used.filter("split = 'test'").join(train, k, "left")
    cells = F.array(
        F.struct(F.lit("prior").alias("model"), F.col("_prior").alias("score")),
        F.struct(F.lit("persistence").alias("model"), fn.persistence_probability("past_mean", F.col("_fill")).alias("score")),
    )
    return test.select(*keys, S.STATION, S.TIME, F.col("label").alias("y"), F.explode(cells).alias("_m")).select(
        *keys, S.STATION, S.TIME, "y", "_m.score", "_m.model"
    )


def class_counts(train: DataFrame) -> tuple[int, int]:
    """Rows and positives of a train set: one aggregate row."""
    r = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    return int(r[0]), int(r[1])


def model_scores(frame: DataFrame, features: Sequence[str], trees: int = 100, depth: int = 8, c: float = 1.0) -> DataFrame:
    """Test scores of the four models for one scope, as a long table.

    Train rows of a single class leave only the two baselines.
    """
    ready = written(prepared(frame, features), "ready")
    train, test = ready.filter("split = 'train'"), ready.filter("split = 'test'")
    n, pos = class_counts(train)
    parts = [baseline_scores(frame)]
    if pos in (0, n):
        return parts[0]
    parts += [
        score_model(fit_model(train, features, logistic(c, n)), test, features, "logistic"),
        score_model(fit_model(train, features, forest(trees, depth)), test, features, "forest"),
    ]
    return reduce(DataFrame.unionByName, parts)


def used_rows(frame: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """What fits need of the used rows of a frame."""
    return frame.filter("row_state = 'used'").select(*keys, S.STATION, S.TIME, "split", "label", *features)


def out_of_fold_scores(frame: DataFrame, features: Sequence[str], n_folds: int = 5, c: float = 1.0) -> DataFrame:
    """Expanding-window logistic scores of the train rows; a single-class fold scores its own prevalence.

    Folds cut the distinct hours of all stations, because one model learns from all of them: no
    station's train hours are later than another's validation hours. All folds are fitted at once.
    """
    train = used_rows(frame, features).filter("split = 'train'")
    folds = written(train.join(keyed.members(train.select(S.TIME).distinct(), n_folds), S.TIME), "folds")
    _, scored = keyed.fit_and_score(folds, ["fold"], features, c)
    return scored.select(S.STATION, S.TIME, F.col("label").alias("y"), "score", F.lit("logistic").alias("model"), F.col("fold").cast("long").alias("fold"))


def tuned_models(rows: DataFrame, keys: Sequence[str], features: Sequence[str], n_folds: int = 5, c: float = 1.0, min_rows: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fits, thresholds, scored test rows) of the logistic model of every key.

    `rows` are used rows with keys, split, label and features. The model of all train rows
    and those of the expanding folds inside them are keys of one fit; thresholds are tuned
    on the folds' own validation scores, so no test row is looked at.
    """
    keys = list(keys)
    train = rows.filter("split = 'train'")
    folds = written(keyed.members(train.select(*keys, S.TIME).distinct(), n_folds, keys), "folds")
    whole = rows.withColumns({"fold": F.lit(0), "role": F.col("split")})
    every = whole.unionByName(train.join(folds, [*keys, S.TIME]).select(*whole.columns))
    fits, scored = keyed.fit_and_score(every, [*keys, "fold"], features, c, min_rows)
    scored = written(scored, "tuned_scores")
    tau = tune_threshold(scored.filter("fold > 0"), keys, y="label")
    return fits.filter("fold = 0").drop("fold"), tau, scored.filter("fold = 0").drop("fold", "role")


def odds_of(fits: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """keys, feature, coef and odds_ratio of fitted models."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("beta")[i].alias("coef")) for i, f in enumerate(features)])
    rows = fits.filter("beta is not null").select(*keys, F.explode(cells).alias("_r")).select(*keys, "_r.*")
    return rows.withColumn("odds_ratio", F.exp(F.least(F.greatest("coef", F.lit(-20.0)), F.lit(20.0))))


def odds_ratios(frame: DataFrame, features: Sequence[str], c: float = 1.0) -> DataFrame:
    """Coefficients and odds ratios of the logistic model of all stations."""
    rows = used_rows(frame, features).withColumns({"_scope": F.lit("all"), "role": F.col("split")})
    ready = written(keyed.scaled(rows, ["_scope"], features).filter("role = 'train'"), "ready")
    return odds_of(keyed.fit(ready, ["_scope"], features, c=c), ["_scope"], features).drop("_scope")


def shuffled_places(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of 0..n-1 applied to places: four Feistel rounds over a square of at most 4 n cells, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = place.astype(np.uint64), np.ones(len(place), bool)
    while todo.any():
        high, low = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            x = (low + key[todo] + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            high, low = low, high ^ ((x ^ (x >> np.uint64(32))) & mask[todo])
        out[todo] = (high << half[todo]) | low
        todo = out >= n.astype(np.uint64)
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def _donor(place: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(shuffled_places(place.to_numpy(np.int64), n.to_numpy(np.int64), key.to_numpy(np.int64).view(np.uint64)))


def shuffled_rows(rows: DataFrame, features: Sequence[str], repeats: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """rows once per repeat, with `_new`: the features of a donor row of the same station (and keys).

    The donor's place is a keyed bijection of the row's own, so a shuffle needs no sort:
    rows meet their donors by one equi-join on the place.
    """
    k = [*keys, S.STATION]
    numbered = running(rows.withColumn("_hour", hour_number(S.TIME)), k, "_hour", {"_rn": F.lit(1)}).drop("_hour")
    numbered = written(numbered.withColumn("_rn", F.col("_rn") - 1), "numbered")
    n = numbered.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    copies = numbered.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).join(n, k)
    key = fn.draw32(F.lit(seed), F.col("repeat"), *map(F.col, k))
    donors = numbered.select(*k, F.col("_rn").alias("_from"), F.struct(*features).alias("_new"))
    return copies.withColumn("_from", _donor("_rn", "_n", key)).join(donors, [*k, "_from"]).drop("_rn", "_n", "_from")


def permuted_rows(rows: DataFrame, features: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """Copies of the rows in which one feature is shuffled within its station, keyed by (feature, repeat)."""
    copies = shuffled_rows(rows, features, repeats, seed).withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    return copies.withColumns({f: F.when(F.col("feature") == f, F.col(f"_new.{f}")).otherwise(F.col(f)) for f in features}).drop("_new")


def permutation_importance(frame: DataFrame, features: Sequence[str], repeats: int = 20, seed: int = 42, c: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Drop in average precision when one feature is shuffled within stations: mean, sd and interval over repeats, per key.

    A shuffled feature moves the logit by its coefficient times the difference of the
    values, so each row is scored once and shifted per feature.
    """
    k = [*keys, "_scope"]
    rows = used_rows(frame, features, keys).withColumns({"_scope": F.lit("all"), "role": F.col("split")})
    ready = written(keyed.scaled(rows, k, features), "ready")
    fits = keyed.fit(ready.filter("role = 'train'"), k, features, c=c)
    test = ready.filter("role = 'test'").join(fits.filter("beta is not null").select(*k, "beta"), k).withColumn("_z", keyed.linear(features))
    base = ranking_metrics(test.withColumn("score", keyed.probability(F.col("_z"))), k, "label").select(*k, F.col("pr_auc").alias("_base"))
    copies = shuffled_rows(test.select(*k, S.STATION, S.TIME, "label", "beta", "_z", *features), features, repeats, seed, k)
    shift = [F.struct(F.lit(f).alias("feature"), (F.col("beta")[i] * (F.col(f"_new.{f}") - F.col(f))).alias("by")) for i, f in enumerate(features)]
    moved = copies.select(*k, "repeat", "label", "_z", F.explode(F.array(*shift)).alias("_s"))
    scored = moved.select(*k, "_s.feature", "repeat", "label", keyed.probability(F.col("_z") + F.col("_s.by")).alias("score"))
    drop = ranking_metrics(scored, [*k, "feature", "repeat"], "label").join(base, k).select(*k, "feature", (F.col("_base") - F.col("pr_auc")).alias("drop"))
    se = F.stddev_pop("drop") / F.sqrt(F.count("drop"))
    return drop.groupBy(*k, "feature").agg(
        F.avg("drop").alias("mean_drop"),
        F.stddev_pop("drop").alias("sd_drop"),
        (F.avg("drop") - 1.96 * se).alias("ci_low"),
        (F.avg("drop") + 1.96 * se).alias("ci_high"),
    ).drop("_scope")


def impurity_importance(frame: DataFrame, features: Sequence[str], trees: int = 100, depth: int = 8) -> DataFrame:
    train = written(prepared(frame, features).filter("split = 'train'"), "ready")
    model = fit_model(train, features, forest(trees, depth))
    rows = [(f, float(b)) for f, b in zip(features, model.featureImportances.toArray())]
    return frame.sparkSession.createDataFrame(rows, "feature string, importance double")


def ablation_and_horizons(frames: dict[int, DataFrame], sets: dict[str, Sequence[str]], full: str, n_folds: int = 5, min_rows: int = 30) -> DataFrame:
    """Feature sets at horizon 0 and the full set at later horizons, each at its own tuned threshold, beside the prior.

    A spec is a key: features outside its set are masked (their coefficient is then 0), so all
    specs and their folds are fitted together. status is EVALUATED, INSUFFICIENT_DATA or
    SINGLE_CLASS; the latter two have no metrics. The prior's average precision is the test
    share of positives.
    """
    features = list(dict.fromkeys(f for fs in sets.values() for f in fs))
    specs = [(0, name) for name in sets] + [(h, full) for h in frames if h > 0]
    keys = ["spec", "horizon"]
    parts = []
    for horizon, frame in frames.items():
        names = [name for h, name in specs if h == horizon]
        base = used_rows(frame, features).withColumn("spec", F.explode(F.array(*map(F.lit, names)))).withColumn("horizon", F.lit(horizon).cast("long"))
        parts.append(base.withColumns({f: F.when(F.col("spec").isin([n for n in names if f in sets[n]]), F.col(f)) for f in features}))
    rows = written(reduce(DataFrame.unionByName, parts), "specs")
    fits, tau, test = tuned_models(rows, keys, features, n_folds, min_rows=min_rows)
    metrics = classifier_metrics(test.join(tau.select(*keys, "tau_f2"), keys), [*keys, "tau_f2"], F.col("tau_f2"), y="label").drop("status")
    prior = test.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"), F.sum("label").alias("n_test_pos"), F.avg("label").alias("prior_pr_auc"))
    named = frames[0].sparkSession.createDataFrame([(n, h) for h, n in specs], "spec string, horizon long")
    out = named.join(fits.select(*keys, F.col("n").alias("n_train"), "status"), keys, "left").join(prior, keys, "left").join(metrics, keys, "left")
    fitted = F.col("status") == "FITTED"
    values = [c for c in metrics.columns if c not in keys]
    status = F.when(fitted & F.col("n_test").isNotNull(), "EVALUATED").when(F.coalesce("status", F.lit("")) == "SINGLE_CLASS", "SINGLE_CLASS").when(F.col("status") == "NOT_SETTLED", "NOT_SETTLED").otherwise("INSUFFICIENT_DATA")
    return out.withColumn("status", status).withColumns({c: F.when(F.col("status") == "EVALUATED", F.col(c)) for c in values}).withColumn("model", F.lit("logistic"))


def temporal_backtest(frame: DataFrame, features: Sequence[str], n_folds: int = 5, inner_folds: int = 3, keys: Sequence[str] = (), min_rows: int = 80, min_positives: int = 15) -> DataFrame:
    """Per fold: threshold tuned on folds inside its own train hours, metrics on the hours after them.

    Folds and inner folds are keys of one fit. A fold whose train rows are too few, or
    have too few positives, takes 0.5. status is OK, UNESTIMABLE or SINGLE_CLASS_FOLD
    (train or validation rows of one class: a row without metrics).
    """
    keys = list(keys)
    train = written(used_rows(frame, features, keys).filter("split = 'train'").drop("split"), "backtest")
    outer = written(keyed.members(train.select(*keys, S.TIME).distinct(), n_folds, keys), "outer")
    k = [*keys, "fold"]
    inner = keyed.members(outer.filter("role = 'train'").select(*k, S.TIME), inner_folds, k, "inner")
    every = outer.withColumn("inner", F.lit(0)).unionByName(inner.select(*outer.columns, F.col("inner").cast("int").alias("inner")))
    rows = train.join(written(every, "members"), [*keys, S.TIME])
    fits, scored = keyed.fit_and_score(rows, [*k, "inner"], features)
    scored = written(scored, "backtest_scores")
    tau = tune_threshold(scored.filter("inner > 0"), k, y="label").select(*k, "tau_f2")
    head = fits.filter("inner = 0").select(*k, F.col("n").alias("n_train"), F.col("n_pos").alias("_pos"), F.col("status").alias("_fit")).join(tau, k, "left")
    enough = (F.col("n_train") >= min_rows) & (F.col("_pos") >= min_positives)
    head = written(head.withColumn("tau_f2", F.when(enough, F.coalesce("tau_f2", F.lit(0.5))).otherwise(0.5)), "fold_thresholds")
    last = scored.filter("inner = 0").join(head.select(*k, "tau_f2"), k)
    metrics = classifier_metrics(last, k, F.col("tau_f2"), y="label")
    sizes = last.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("n_pos"))
    out = head.join(sizes, k, "left").join(metrics, k, "left")
    one_class = (F.col("_fit") == "SINGLE_CLASS") | (F.col("n_pos") == 0) | (F.col("n_pos") == F.col("n"))
    status = F.when(one_class, "SINGLE_CLASS_FOLD").when(F.col("_fit") == "NOT_SETTLED", "NOT_SETTLED").otherwise(F.col("status"))
    values = [c for c in metrics.columns if c not in (*k, "status")] + ["tau_f2"]
    return out.withColumn("status", status).withColumns({c: F.when(F.col("status") != "SINGLE_CLASS_FOLD", F.col(c)) for c in values}).drop("_pos", "_fit")


def locked_drift(frame: DataFrame, features: Sequence[str], n_folds: int = 5) -> DataFrame:
    """Test metrics per year and month of the model of all train rows, at the threshold locked on train."""
    rows = written(used_rows(frame, features).withColumn("_scope", F.lit("all")), "drift_rows")
    _, tau, test = tuned_models(rows, ["_scope"], features, n_folds)
    return drift_table(test.join(tau.select("_scope", "tau_f2"), "_scope"), ["tau_f2"], F.col("tau_f2"), y="label")
