"""Time the headline queries on the driver tables and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stationwise import catalog  # noqa: E402

HEADLINE = (
    "hourly_grid",
    "stuck_sensor",
    "missing_runs",
    "short_gap_interpolate",
    "period_quality_table",
    "resolve_duplicates",
    "first_wins_dedup",
    "uniqueness_audit",
    "statistical_profile",
    "pair_correlation",
    "daily_compliance",
    "alert_label",
    "past_only_features",
    "causal_rolling_instant",
    "hac_location",
    "kruskal_wallis",
    "calendar_bootstrap_ci",
    "calendar_null_test",
    "contrast_ci",
    "clean_air",
    "classifier_metrics",
    "ridge_lasso_tune",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stationwise-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    names = [n for n in HEADLINE if n in queries]
    times: dict[str, float | None] = {}
    errors: dict[str, str] = {}

    def timed(name: str) -> float | None:
        """Seconds, or None where the query fails; the others are still timed."""
        start = time.perf_counter()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {str(e)[:300]}"
            return None
        return round(time.perf_counter() - start, 3)

    timed(names[0])  # warm-up
    for name in names:
        times[name] = timed(name)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(t for t in times.values() if t is not None), 3),
                "unit": "sec",
                "queries": times,
                "errors": errors,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
