"""Packed replicates against the same replicates written out as rows, and the closed forms of a bootstrap mean."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationwise.operators import packed, quality, resample
from stationwise.plans import dataset, inference
from tests.helpers import calendar

RNG = np.random.default_rng(23)
VALUES = {
    "a": [None if i % 7 == 3 else float(RNG.integers(-4, 9)) for i in range(90)],
    "b": [None if i % 11 == 3 else float(x) for i, x in enumerate(RNG.normal(size=61))],
    "c": [1.5, None, 2.5],
}
BLOCKS = [5, 20]


@pytest.fixture(scope="module")
def cal(spark):
    return calendar(spark, VALUES, label=lambda i: i % 3).cache()


@pytest.fixture(scope="module")
def long_rows(cal):
    """{(station, block, b): (values, labels)} of 30 replicates, from the relational form."""
    out = {}
    for r in resample.replicates(cal, 30, BLOCKS, 9, labels=["label"]).collect():
        out.setdefault((r.station_id, r.block, r.b), []).append((r.dest, r.value, r.label))
    return {k: tuple(np.array(c, float) for c in list(zip(*sorted(v)))[1:]) for k, v in out.items()}


def ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def plain(name, values, labels):
    seen = ~np.isnan(values)
    x, g = values[seen], labels[seen]
    n = len(x)
    if not n:
        return np.nan
    if name == "mean":
        return x.mean()
    if name == "median":
        return np.median(x)
    if name == "h":
        if len(set(g)) < 3:
            return np.nan
        r = ranks(x)
        return 12 / (n * (n + 1)) * sum(r[g == k].sum() ** 2 / (g == k).sum() for k in set(g)) - 3 * (n + 1)
    if name == "t":
        return x.mean() / np.sqrt(x.var(ddof=1) / n) if n > 1 and x.var() > 0 else np.nan
    if name == "w":
        return ranks(abs(x))[x > 0].sum()
    x, g = x[g < 2], g[g < 2]
    na, nb = (g == 0).sum(), (g == 1).sum()
    u = ranks(x)[g == 0].sum() - na * (na + 1) / 2
    return (u if name == "u" else 2 * u / (na * nb) - 1) if na and nb else np.nan


STATISTICS = {
    "mean": packed.mean(name="mean"),
    "median": packed.median(name="median"),
    "h": packed.kruskal("label", 3, name="h"),
    "u": packed.rank_sums("label", [(0, 1)], names=["u"]),
    "rb": packed.rank_sums("label", [(0, 1)], biserial=True, names=["rb"]),
    "t": packed.student(name="t"),
    "w": packed.signed_ranks(name="w"),
}


@pytest.mark.parametrize("cells", [1 << 20, 500])
def test_every_statistic_equals_the_rows(cal, long_rows, monkeypatch, cells):
    monkeypatch.setattr(packed, "CELLS", cells)
    monkeypatch.setattr(packed, "BATCH", 8)
    got = packed.replicate_stats(cal, 30, BLOCKS, 9, list(STATISTICS.values()), ["station_id"]).collect()
    assert len(got) == len(long_rows) == 3 * 2 * 30
    for r in got:
        values, labels = long_rows[r.station_id, r.block, r.b]
        assert r.n_observed == (~np.isnan(values)).sum()
        for name in STATISTICS:
            want = plain(name, values, labels)
            assert (r[name] is None and np.isnan(want)) or r[name] == pytest.approx(want, abs=1e-9), name


def trimmed(matrix):
    import numpy as np

    out = np.full(len(matrix), np.nan)
    for i, row in enumerate(matrix):
        x = np.sort(row[~np.isnan(row)])
        cut = len(x) // 10
        if len(x):
            out[i] = x[cut : len(x) - cut].mean()
    return out


def test_a_callers_statistic_equals_numpy(cal, long_rows):
    """A trimmed mean: interval, point and replicates."""
    got = packed.replicate_stats(cal, 30, BLOCKS, 9, [packed.user_statistic(trimmed)], ["station_id"]).collect()
    by = {}
    for r in got:
        want = trimmed(long_rows[r.station_id, r.block, r.b][0][None])[0]
        assert (r.stat is None and np.isnan(want)) or r.stat == pytest.approx(want, abs=1e-12)
        by.setdefault((r.station_id, r.block), []).append(want)
    for r in resample.calendar_ci(cal, trimmed, 30, BLOCKS, 9).collect():
        x = np.array(by[r.station_id, r.block])
        x = x[~np.isnan(x)]
        assert r.ci_low == pytest.approx(np.quantile(x, 0.025)) and r.ci_high == pytest.approx(np.quantile(x, 0.975))
        assert r.point == pytest.approx(trimmed(np.array([np.nan if v is None else v for v in VALUES[r.station_id]])[None])[0])


def spread(matrix, labels):
    import numpy as np

    with np.errstate(all="ignore"):
        return np.array([[np.nanmean(r[labels == 0]) - np.nanmean(r[labels == 1]), np.nanmax(r) if (~np.isnan(r)).any() else np.nan] for r in matrix])


def test_a_callers_statistic_has_labels_several_results_and_a_null_test(cal, long_rows):
    own = packed.user_statistic(spread, ["diff", "top"], labels=["label"])
    for r in packed.replicate_stats(cal, 30, BLOCKS, 9, [own], ["station_id"]).filter("station_id = 'b'").collect():
        values, labels = long_rows["b", r.block, r.b]
        assert [r["diff"], r.top] == pytest.approx(spread(values[None], labels)[0])
    one = packed.user_statistic(lambda m, g: spread(m, g)[:, 0], labels=["label"])
    observed = packed.identity_stats(cal, one, ["station_id"]).withColumnRenamed("stat", "observed")
    p = {(r.station_id, r.block): r for r in resample.null_test(cal, one, observed, 30, BLOCKS, 9).collect()}
    for block in BLOCKS:
        obs = spread(np.array(VALUES["b"], float)[None], np.arange(61) % 3)[0, 0]
        x = np.array([spread(*(long_rows["b", block, b][0][None], long_rows["b", block, b][1]))[0, 0] for b in range(1, 31)])
        r = p["b", block]
        assert (r.n_ge, r.n_le) == ((x >= obs).sum(), (x <= obs).sum())
        assert r.p_value == pytest.approx(min(1, 2 * min((1 + r.n_ge) / 31, (1 + r.n_le) / 31)))
    with pytest.raises(ValueError):
        packed.named("mode")


def test_group_replicates_draw_until_full(spark):
    """Short windows with a single observation beside full ones: values and their order as the draws say."""
    values = [None if i % 5 else float(i) for i in range(60)] + [float(i) for i in range(60, 100)]
    cal = calendar(spark, {"s": values}, label=lambda i: (i // 25) % 2)
    windows = sorted(resample.group_windows(cal, "label", 6).collect(), key=lambda r: (r.label, r.start))
    for r in resample.packed_groups(cal, "label", 6, 12, 5).collect():
        mine = [w for w in windows if w.label == r.label]
        out, j = [], 0
        while len(out) < mine[0].n_target:
            u = packed.draws(f"5:s:{r.label}", r.b, r.b, j + 1)[0, j] / 2**32
            w = next(w for w in mine if w._lo <= u < w._hi)
            out += [v for v in values[w.start : w.start + w.len] if v is not None]
            j += 1
        assert list(r["values"]) == out[: mine[0].n_target]


def test_two_paths_of_the_mean_and_its_closed_form(spark):
    """The kernel's means equal prefix sums joined by start; mean and spread equal the closed form; a wrong figure is found."""
    dense = calendar(spark, {"a": list(RNG.normal(size=200).cumsum()), "b": list(RNG.normal(size=75))})
    again = {(r.station_id, r.block, r.b): r.stat for r in resample.mean_by_prefix_sums(dense, 40, BLOCKS, 3).collect()}
    kernel = packed.replicate_stats(dense, 40, BLOCKS, 3, [packed.mean()], ["station_id"]).collect()
    assert len(kernel) == len(again) == 160
    assert all(again[r.station_id, r.block, r.b] == pytest.approx(r.stat, abs=1e-9) for r in kernel)
    for r in resample.closed_form_mean(dense, BLOCKS).collect():
        x = np.array([v[0] for v in dense.filter(F.col("station_id") == r.station_id).orderBy("pos").select("value").collect()])
        n, size = len(x), min(r.block, len(x))
        full, rest = divmod(n, size)
        sums = lambda k: np.array([np.take(x, range(i, i + k), mode="wrap").sum() for i in range(n)])
        want = (full * sums(size).var() + (sums(rest).var() if rest else 0)) / n**2
        assert r.expected == pytest.approx(x.mean()) and r.sd == pytest.approx(np.sqrt(want))

    days = inference.labelled(dense)
    reported = resample.compact_mean_report(days, 300, BLOCKS, 3)
    checks = inference.inference_recheck(reported, days, 300, BLOCKS, 3).collect()
    assert checks and all(r.passed for r in checks), [r for r in checks if not r.passed]
    for column in ("point", "replicate_sd", "ci_low", "ci_high"):
        wrong = reported.withColumn(column, F.col(column) * F.when(F.col("station_id") == "a", 1.01).otherwise(1.0))
        failed = {(r.station_id, r.check) for r in inference.inference_recheck(wrong, days, 300, BLOCKS, 3).collect() if not r.passed}
        assert failed and all(s == "a" for s, _ in failed)
    lost = reported.filter("block = 5")
    assert any(not r.passed for r in inference.inference_recheck(lost, days, 300, BLOCKS, 3).collect())


def most_rows(df):
    """Rows that the busiest operator of a query gave out."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_prefix_sums_make_no_row_per_drawn_block(spark):
    """A replicate's drawn blocks are added up inside its row, and replicates are dealt to several tasks."""
    dense = calendar(spark, {"a": list(RNG.normal(size=200)), "b": list(RNG.normal(size=90))})
    means = resample.mean_by_prefix_sums(dense, 600, [2, 5], 3)
    assert most_rows(means) == 2 * 2 * 600  # drawn blocks are 600 * (100 + 40 + 45 + 18)
    assert means.select(F.spark_partition_id()).distinct().count() > 1


def test_revalidation_is_no_single_plan(spark):
    """Each area is written before the next, so the driver never holds the joins and broadcasts of all; a fault is still found."""
    hours = spark.range(72).select(
        F.lit("a").alias("station_id"), F.timestamp_seconds(1704067200 + F.col("id") * 3600).alias("timestamp"), F.when(F.col("id") % 9 > 1, F.col("id").cast("double")).alias("pm25")
    )
    own = {"pm25_derived": F.col("pm25"), "is_derived": F.lit(False), "season": F.lit("Winter"), "winter_year": F.lit(2024)}
    extended = hours.withColumns(own)
    published = quality.period_quality_table(extended, gaps=quality.period_gaps(extended))
    assert sorted(published.collect()) == sorted(quality.period_quality_table(extended).collect())
    results = spark.createDataFrame([("f", "a", 1.0, 0.0, 2.0, 0.5, 0.5, False)], "family string, test string, estimate double, ci_low double, ci_high double, p double, holm_p double, rejected boolean")
    for fault in (0, 1):
        out = dataset.revalidate(extended, ["a"], published.withColumn("gap_count", F.col("gap_count") + fault), results)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        rows = out.collect()
        assert {r.area for r in rows} == {"input", "reconcile", "quality_identities", "result_identities"}
        assert {r.check for r in rows if not r.passed} == ({"gap_count"} if fault else set())
