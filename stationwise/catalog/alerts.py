"""Alert model evaluation and fits (inventory 2.9, third part)."""

from pyspark.sql import functions as F

from ..operators import alerts, splits
from ..session import written
from . import query, views as v
from .frames import AF, FRAME, alert_frame
from .sequences import CUT

FEATURES = ("past_mean", "past_sd", "lag_24h", "temperature", "relative_humidity", "wind_speed", "precipitation")
SETS = {
    "weather": ("temperature", "relative_humidity", "wind_speed", "precipitation"),
    "history": ("past_mean", "past_sd", "lag_24h"),
    "full": FEATURES,
}
SCORED = """scored AS (SELECT station_id, timestamp, label AS y, unnest(['steep', 'flat']) AS model, unnest([round(1 / (1 + exp(-(past_mean - 50) / 5)), 6), round(1 / (1 + exp(-(past_mean - 40) / 20)), 6)]) AS score FROM frame WHERE row_state = 'used')"""
_CHAIN = (AF, FRAME.format(6, "b.alert"), SCORED)


def scored(spark, sf):
    """Rows with two given scores, deterministic functions of the past mean."""
    used = alert_frame(spark, sf, 6).filter("row_state = 'used'")
    logit = lambda at, width: F.round(1 / (1 + F.exp(-(F.col("past_mean") - at) / width)), 6)
    cells = F.array(
        F.struct(F.lit("steep").alias("model"), logit(50, 5).alias("score")),
        F.struct(F.lit("flat").alias("model"), logit(40, 20).alias("score")),
    )
    return used.select("station_id", "timestamp", F.col("label").alias("y"), F.explode(cells).alias("_m")).select(
        "station_id", "timestamp", "y", "_m.*"
    )


def metrics_sql(keys, src="scored", tau="0.5"):
    return f"""SELECT {keys}, tp, fp, fn, tn, round(brier, 6) AS brier, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN ok THEN coalesce(tp / nullif(tp + fp, 0), 0) WHEN tp + fp > 0 THEN 0 END, 6) AS precision, round(CASE WHEN ok THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN ok THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round(CASE WHEN ok THEN 5 * tp / (5 * tp + fp + 4 * fn) END, 6) AS f2,
    round(fp / nullif(fp + tn, 0), 6) AS false_alarm_rate, CASE WHEN ok THEN 'OK' ELSE 'UNESTIMABLE' END AS status, round(CASE WHEN ok THEN auc END, 6) AS roc_auc, round(CASE WHEN ok THEN ap END, 6) AS pr_auc FROM (
      SELECT *, tp + fn > 0 AND fp + tn > 0 AS ok FROM (SELECT {keys}, count(*) FILTER (score >= {tau} AND y = 1) AS tp, count(*) FILTER (score >= {tau} AND y = 0) AS fp, count(*) FILTER (score < {tau} AND y = 1) AS fn, count(*) FILTER (score < {tau} AND y = 0) AS tn, avg(power(score - y, 2)) AS brier,
        (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc, sum(tpge / nge) FILTER (y = 1) / nullif(count(*) FILTER (y = 1), 0) AS ap FROM (
          SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {keys} ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS nge, sum(y) OVER (PARTITION BY {keys} ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS tpge FROM {src}) GROUP BY {keys}))"""


@query("classifier_metrics", v.sql("merged", metrics_sql("station_id, model"), *_CHAIN))
def _(spark, sf):
    return alerts.classifier_metrics(scored(spark, sf), ["station_id", "model"])


@query(
    "pr_curve_points",
    v.sql(
        "merged",
        "SELECT model, score, round(t / n, 6) AS precision, round(t / p, 6) AS recall, n AS n_ge, t::BIGINT AS tp_ge FROM (SELECT DISTINCT model, score, count(*) OVER w AS n, sum(y) OVER w AS t, sum(y) OVER (PARTITION BY model) AS p FROM scored WINDOW w AS (PARTITION BY model ORDER BY score DESC RANGE UNBOUNDED PRECEDING))",
        *_CHAIN,
    ),
)
def _(spark, sf):
    return alerts.pr_curve_points(scored(spark, sf), ["model"])


_GRID = "[" + ", ".join(f"{t!r}::DOUBLE" for t in alerts.THRESHOLDS) + "]"
_TABLE = f"""tt AS (SELECT model, threshold, n_hit, tp, n_pos, coalesce(tp / nullif(n_hit, 0), 0) AS precision, coalesce(tp / nullif(n_pos, 0), 0) AS recall, coalesce(2 * tp / nullif(n_hit + n_pos, 0), 0) AS f1, coalesce(5 * tp / nullif(n_hit + 4 * n_pos, 0), 0) AS f2 FROM (
  SELECT model, threshold, count(*) FILTER (score >= threshold) AS n_hit, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (y = 1) AS n_pos FROM scored CROSS JOIN (SELECT unnest({_GRID}) AS threshold) GROUP BY ALL))"""


@query(
    "threshold_table",
    v.sql(
        "merged",
        "SELECT model, round(threshold, 6) AS threshold, n_hit, tp, n_pos, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM tt",
        *_CHAIN,
        _TABLE,
    ),
)
def _(spark, sf):
    return alerts.threshold_table(scored(spark, sf), ["model"])


@query(
    "threshold_tuning",
    v.sql(
        "merged",
        """SELECT model, round(tf2, 6) AS tau_f2, round(bf2, 6) AS best_f2, round(tf1, 6) AS tau_f1, round(bf1, 6) AS best_f1, round(br, 6) AS best_recall, round(coalesce(tr, tf2), 6) AS tau_recall, CASE WHEN tr IS NULL THEN 'fallback_f2' WHEN coalesce(tr, tf2) <= 0.10 + 1e-9 OR coalesce(tr, tf2) >= 0.90 - 1e-9 THEN 'grid_edge' ELSE 'ok' END AS note FROM (
        SELECT model, arg_max(threshold, (f2, -threshold)) AS tf2, max(f2) AS bf2, arg_max(threshold, (f1, -threshold)) AS tf1, max(f1) AS bf1, arg_max(threshold, (recall, -threshold)) FILTER (precision >= 0.6) AS tr, max(recall) FILTER (precision >= 0.6) AS br FROM tt GROUP BY ALL)""",
        *_CHAIN,
        _TABLE,
    ),
)
def _(spark, sf):
    return alerts.tune_threshold(scored(spark, sf), ["model"])


_CAL = "cal AS (SELECT model, least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS n, avg(score) AS mean_score, avg(y) AS event_rate, count(*) >= 10 AS sufficient FROM scored GROUP BY ALL)"


@query(
    "calibration_table",
    v.sql("merged", "SELECT model, bin, n, round(mean_score, 6) AS mean_score, round(event_rate, 6) AS event_rate, sufficient FROM cal", *_CHAIN, _CAL),
)
def _(spark, sf):
    return alerts.calibration_table(scored(spark, sf), ["model"])


@query(
    "calibration_summary",
    v.sql(
        "merged",
        "SELECT model, round(sum(n * abs(mean_score - event_rate)) / sum(n), 6) AS ece, count(*) FILTER (sufficient) AS n_sufficient_bins, CASE WHEN count(*) FILTER (sufficient) >= 2 THEN 'OK' ELSE 'TOO_FEW_BINS' END AS status FROM cal GROUP BY ALL",
        *_CHAIN,
        _CAL,
    ),
)
def _(spark, sf):
    return alerts.calibration_summary(alerts.calibration_table(scored(spark, sf), ["model"]), ["model"])


@query(
    "drift_table",
    v.sql(
        "merged",
        metrics_sql("model, kind, period", "drift"),
        *_CHAIN,
        "drift AS (SELECT *, unnest(['year', 'month']) AS kind, unnest([year(timestamp)::VARCHAR, strftime(timestamp, '%Y-%m')]) AS period FROM scored)",
    ),
)
def _(spark, sf):
    return alerts.drift_table(scored(spark, sf), ["model"], 0.5)


def model_frame(spark, sf, horizon=6):
    """Model rows of one horizon, written once: fits read them many times."""
    return written(alert_frame(spark, sf, horizon), f"alert_frame_h{horizon}")


@query("alert_classifiers")
def _(spark, sf):
    scores = alerts.model_scores(model_frame(spark, sf), FEATURES)
    return alerts.classifier_metrics(scores, ["model"])


@query("odds_ratios")
def _(spark, sf):
    return alerts.odds_ratios(model_frame(spark, sf), FEATURES)


@query("permutation_importance")
def _(spark, sf):
    frame = model_frame(spark, sf)
    perm = alerts.permutation_importance(frame, FEATURES, repeats=20)
    return perm.join(alerts.impurity_importance(frame, FEATURES, trees=100), "feature")


@query("ablation_and_horizons")
def _(spark, sf):
    base = written(splits.alert_features(v.merged(spark, sf), min_periods=12, threshold=50.0), "alert_features")
    frames = {h: splits.classification_frame(base, CUT, h) for h in (0, 1, 6, 12, 24)}
    return alerts.ablation_and_horizons(frames, SETS, "full")


@query("out_of_fold_threshold")
def _(spark, sf):
    oof = alerts.out_of_fold_scores(model_frame(spark, sf), FEATURES)
    return alerts.tune_threshold(oof, ["model"])


@query("temporal_backtest")
def _(spark, sf):
    return alerts.temporal_backtest(model_frame(spark, sf), FEATURES)


@query("alert_drift")
def _(spark, sf):
    """Metrics per test year and month at the threshold locked on train."""
    return alerts.locked_drift(model_frame(spark, sf), FEATURES)
