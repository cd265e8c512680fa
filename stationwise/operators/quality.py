"""Data-quality audits: profiles, uniqueness, coverage, verdict tables and contracts.

Audits first reduce the table to one row per key (or per value), then to one
row per station; the final verdict tables are stacked from a single wide row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn
from .clean import stacked, unpivoted
from .grid import missing_runs, with_step
from .joins import with_periods
from .ranks import cumulative_counts, quantiles
from .sequence import hour_number, runs
from .stats import holm


def column_profile(df: DataFrame, numeric: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    """Per column: rows, missing, distinct values and, for numbers, range and quartiles.

    Distinct values are counted by grouping (column, value), which spreads a hot
    column over all tasks.
    """
    parts = []
    if numeric:
        nums = df.select(*[F.col(c).cast("double").alias(c) for c in numeric])
        long = unpivoted(nums, [], numeric, "column", "v")
        counted = cumulative_counts(long, ["column"], "v")
        at = {}
        for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            pos = (F.col("n") - 1) * F.lit(p)
            hit = lambda r: F.max(F.when((F.col("below") <= r) & (r < F.col("below") + F.col("cnt")), F.col("v")))
            at[f"_l{name}"], at[f"_h{name}"] = hit(F.floor(pos)), hit(F.ceil(pos))
        seen = counted.groupBy("column").agg(
            F.max("n").alias("_n"),
            F.count(F.lit(1)).alias("n_distinct"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
            *[c.alias(n) for n, c in at.items()],
        )
        frac = lambda p: (F.col("_n") - 1) * F.lit(p) - F.floor((F.col("_n") - 1) * F.lit(p))
        seen = seen.select(
            "column",
            "n_distinct",
            "min",
            "max",
            *[
                (F.col(f"_l{q}") + (F.col(f"_h{q}") - F.col(f"_l{q}")) * frac(p)).alias(q)
                for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
            ],
        )
        parts.append(_with_counts(df, numeric, seen))
    if text:
        long = unpivoted(df.select(*[F.col(c).cast("string").alias(c) for c in text]), [], text, "column", "v")
        seen = (
            long.filter("v is not null")
            .groupBy("column", "v")
            .agg(F.count(F.lit(1)).alias("_c"))
            .groupBy("column")
            .agg(F.count(F.lit(1)).alias("n_distinct"))
        )
        parts.append(_with_counts(df, text, seen))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _with_counts(df: DataFrame, columns: Sequence[str], seen: DataFrame) -> DataFrame:
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_ok_{c}") for c in columns])
    rows = stacked(
        wide,
        {
            c: {
                "n_rows": "_n",
                "n_missing": F.col("_n") - F.col(f"_ok_{c}"),
                "missing_pct": F.try_divide(100.0 * (F.col("_n") - F.col(f"_ok_{c}")), F.col("_n")),
            }
            for c in columns
        },
        "column",
    )
    return rows.join(seen, "column", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))


def uniqueness_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated rows beyond the first, their rate, and rows sharing any repeated key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.sum("c").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.sum(F.col("c") - 1).alias("n_duplicate_rows"),
        (100.0 * F.sum(F.col("c") - 1) / F.sum("c")).alias("duplicate_pct"),
        F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("n_rows_in_repeated_keys"),
        (F.max("c") == 1).alias("is_unique"),
    )


def missing_representation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact counts of NULL and of each disguised marker per text column, zeros included."""
    wide = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__null") for c in columns],
        *[
            F.count_if(F.col(c) == m).alias(f"{c}__{i}")
            for c in columns
            for i, m in enumerate(S.DISGUISED_MARKERS)
        ],
    )
    cells = []
    for c in columns:
        cells.append(F.struct(F.lit(c).alias("column"), F.lit("<NULL>").alias("marker"), F.col(f"{c}__null").alias("n")))
        for i, m in enumerate(S.DISGUISED_MARKERS):
            cells.append(F.struct(F.lit(c).alias("column"), F.lit(m).alias("marker"), F.col(f"{c}__{i}").alias("n")))
    return wide.select(F.explode(F.array(*cells)).alias("_r")).select("_r.*")


def six_dimension_audit(df: DataFrame, measures: Sequence[str], bounds: Mapping[str, tuple] | None = None) -> DataFrame:
    """Completeness, accuracy, validity, uniqueness and timeliness as (dimension, metric, value) rows.

    The table is reduced to one row per (station, hour), then per station, then
    to one row; type and zone checks come from the schema and cost nothing.
    """
    bounds = {c: b for c, b in (bounds or S.AUDIT_BOUNDS).items() if c in measures}
    low = {c: F.count_if(F.col(c) < b[0]).alias(f"low_{c}") for c, b in bounds.items()}
    high = {c: F.count_if(F.col(c) > b[1]).alias(f"high_{c}") for c, b in bounds.items()}
    gap = F.col("pm25") - F.col("pm10")
    per_key = df.groupBy(S.STATION, S.TIME).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(c).alias(f"ok_{c}") for c in measures],
        *low.values(),
        *high.values(),
        F.count(gap).alias("pairs"),
        F.count_if(gap > 0).alias("strict"),
        F.count_if(gap > S.SUBSET_EPSILON).alias("beyond"),
        F.count_if(F.col("relative_humidity") > S.HUMIDITY_LIMIT).alias("humid"),
    )
    sums = [f"ok_{c}" for c in measures] + [f"low_{c}" for c in bounds] + [f"high_{c}" for c in bounds]
    sums += ["pairs", "strict", "beyond", "humid"]
    per_station = per_key.groupBy(S.STATION).agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("hours"),
        F.min(S.TIME).alias("lo"),
        F.max(S.TIME).alias("hi"),
        *[F.sum(c).alias(c) for c in sums],
    )
    total = per_station.agg(
        F.sum("rows").alias("rows"),
        F.sum("hours").alias("hours"),
        F.count(F.lit(1)).alias("stations"),
        ((F.unix_seconds(F.max("hi")) - F.unix_seconds(F.min("lo"))) / 3600 + 1).alias("shared"),
        *[F.sum(c).alias(c) for c in sums],
    )
    cells = F.lit(float(len(measures))) * F.col("rows")
    filled_cells = sum((F.col(f"ok_{c}") for c in measures), F.lit(0))
    expected = F.col("shared") * F.col("stations")
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long")}
    out = {
        ("completeness", "cell_pct"): 100.0 * filled_cells / cells,
        ("completeness", "expected_hours"): expected,
        ("completeness", "recorded_hours"): F.col("hours"),
        ("completeness", "unrecorded_pct"): 100.0 * (expected - F.col("hours")) / expected,
        ("accuracy", "pairs"): F.col("pairs"),
        ("accuracy", "strict_inversions"): F.col("strict"),
        ("accuracy", "inversions_beyond_epsilon"): F.col("beyond"),
        ("accuracy", "humid_hours"): F.col("humid"),
        **{("accuracy", f"below_{c}"): F.col(f"low_{c}") for c in bounds},
        **{("accuracy", f"above_{c}"): F.col(f"high_{c}") for c in bounds},
        **{("completeness", f"missing_{c}"): F.col("rows") - F.col(f"ok_{c}") for c in measures},
        ("validity", "nonnumeric_measures"): F.lit(len([c for c in measures if c not in numeric])),
        ("uniqueness", "duplicate_rows"): F.col("rows") - F.col("hours"),
        ("timeliness", "shared_window_hours"): F.col("shared"),
    }
    structs = [
        F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("metric"), c.cast("double").alias("value"))
        for (d, m), c in out.items()
    ]
    return total.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def group_quality(df: DataFrame, raw: DataFrame | None = None, bounds: Mapping[str, tuple] | None = None) -> DataFrame:
    """Quality counts with named denominators per (station, period).

    df may hold repeated keys, NULLs and infinities. raw, when given, is the
    reading-level table (station_id, timestamp, value) of the same stations.
    """
    bounds = {c: b for c, b in (bounds or {}).items() if c in df.columns}
    v = F.col(S.TARGET)
    finite = v.isNotNull() & ~F.isnan(v) & ~fn.is_nonfinite(v)
    low, high = S.AUDIT_BOUNDS["pm25"]
    other = [F.count_if(~F.col(c).between(*b)).alias(f"_b_{c}") for c, b in bounds.items()]
    derived = "is_derived" in df.columns
    per_key = with_step(
        df.groupBy(S.STATION, S.TIME).agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(v.isNotNull() & ~F.isnan(v)).alias("observed"),
            F.count_if(finite & v.between(low, high)).alias("valid"),
            F.count_if(fn.is_nonfinite(v)).alias("nonfinite"),
            F.count_if(finite & ~v.between(low, high)).alias("out"),
            F.count_if(finite & (v < low)).alias("negative"),
            (F.count_if("is_derived") if derived else F.lit(0)).alias("derived"),
            *other,
        )
    )
    # one state per station and month, which every longer period adds up
    month = F.date_trunc("month", S.TIME)
    sums = ["rows", "observed", "valid", "nonfinite", "out", "negative", "derived", *(f"_b_{c}" for c in bounds)]
    since = F.unix_seconds(S.TIME) - F.col("step_hours") * 3600
    months = per_key.withColumn("_inside", since >= F.unix_seconds(month)).groupBy(S.STATION, month.alias("_month")).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.count(F.lit(1)).alias("hours"),
        F.min(S.TIME).alias("_lo"),
        F.max(S.TIME).alias("_hi"),
        F.count_if((F.col("step_hours") != 1) & F.col("_inside")).alias("irregular"),
        # the first row's predecessor may be in an earlier month: inside a longer period or not
        F.min_by(F.struct("step_hours", since.alias("since"), "_inside"), S.TIME).alias("_first"),
    )
    spans = months.groupBy(S.STATION).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    start = F.col("period_start")
    across = (
        (F.col("_first.step_hours") != 1)
        & ~F.col("_first._inside")
        & (start.isNull() | (F.col("_first.since") >= F.unix_seconds(start)))
    )
    keys = [S.STATION, "period_type", "period", "period_start", "period_end"]
    agg = with_periods(months.drop("_lo", "_hi"), "_month").groupBy(*keys).agg(
        F.sum("rows").alias("active_grid_rows"),
        F.sum("hours").alias("active_grid_hours"),
        F.sum("observed").alias("observed_hours"),
        F.sum("valid").alias("valid_hours"),
        F.sum("nonfinite").alias("nonfinite_values"),
        F.sum("out").alias("out_of_bounds_values"),
        F.sum("negative").alias("negative_values"),
        F.sum("derived").alias("derived_hours"),
        (F.sum("irregular") + F.count_if(across)).alias("irregular_intervals"),
        sum((F.sum(f"_b_{c}") for c in bounds), F.lit(0)).alias("other_bound_violations"),
    )
    out = agg.join(spans, S.STATION).withColumns(
        {
            "period_start": F.coalesce("period_start", "_lo"),
            "period_end": F.coalesce("period_end", F.timestamp_seconds(F.unix_seconds("_hi") + 3600)),
        }
    )
    expected = ((F.unix_seconds("period_end") - F.unix_seconds("period_start")) / 3600).cast("long")
    out = out.withColumn("expected_calendar_hours", expected).drop("_lo", "_hi")
    if raw is not None:
        hours = raw.groupBy(S.STATION, S.TIME).agg(
            F.count(F.lit(1)).alias("_r"),
            F.count_if(F.col("value").isNull() | ~F.col("value").between(low, high)).alias("_inv"),
        )
        present = per_key.select(S.STATION, S.TIME, F.lit(1).alias("_in"))
        by_month = hours.join(present, [S.STATION, S.TIME], "left").groupBy(S.STATION, month.alias("_month")).agg(
            F.sum("_r").alias("_r"), F.sum("_inv").alias("_inv"), F.count("_in").alias("_in")
        )
        src = with_periods(by_month, "_month").groupBy(S.STATION, "period_type", "period").agg(
            F.sum("_r").alias("raw_observations"),
            F.sum("_inv").alias("invalid_source_rows"),
            F.sum("_in").alias("raw_source_hours"),
        )
        out = out.join(src, [S.STATION, "period_type", "period"], "left").withColumn(
            "missing_source_hours", F.col("active_grid_hours") - F.coalesce("raw_source_hours", F.lit(0))
        )
    duplicates = F.col("active_grid_rows") - F.col("active_grid_hours")
    passed = lambda c: F.when(c, "PASS").otherwise("FAIL")
    return out.withColumns(
        {
            "missing_hours": F.col("active_grid_rows") - F.col("valid_hours"),
            "outside_active_hours": F.col("expected_calendar_hours") - F.col("active_grid_hours"),
            "partial_period": F.col("expected_calendar_hours") > F.col("active_grid_hours"),
            "duplicate_keys": duplicates,
            "completeness_status": passed(F.col("valid_hours") == F.col("active_grid_rows")),
            "uniqueness_status": passed(duplicates == 0),
            "validity_status": passed(
                (F.col("nonfinite_values") == 0)
                & (F.col("out_of_bounds_values") == 0)
                & (F.col("other_bound_violations") == 0)
            ),
            "timeliness_status": passed(F.col("irregular_intervals") == 0),
            "accuracy_status": F.lit("UNVERIFIABLE"),
        }
    )


def gap_pieces(df: DataFrame, value: str = S.TARGET) -> DataFrame:
    """Gaps cut at month borders: station, run_first (the gap's first hour), _month and hours of each piece.

    Pieces of a gap share its first hour, so a longer period adds them up again.
    """
    hours = df.select(S.STATION, S.TIME, value).withColumn("_hour", hour_number(S.TIME))
    missing = runs(hours, [S.STATION], "_hour", F.col(value).isNull()).filter(F.col(value).isNull())
    return missing.groupBy(S.STATION, "run_first", F.date_trunc("month", S.TIME).alias("_month")).agg(
        (F.max("_hour") - F.min("_hour") + 1).alias("hours")
    )


def period_gaps(df: DataFrame, value: str = S.TARGET) -> DataFrame:
    """Gap count, longest and median gap inside each period; a gap is cut at period borders."""
    keys = [S.STATION, "period_type", "period"]
    gaps = with_periods(gap_pieces(df, value), "_month").groupBy(*keys, "run_first").agg(F.sum("hours").alias("hours"))
    gaps = gaps.withColumn("gap", F.col("hours").cast("double"))
    med = quantiles(gaps, keys, "gap", {"median_gap_hours": 0.5})
    return (
        gaps.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("gap_count"), F.max("hours").alias("longest_gap_hours"))
        .join(med, keys, "left")
    )


def period_recount(df: DataFrame, value: str = S.TARGET) -> DataFrame:
    """Coverage and gaps of each period counted the long way, on a copy of every hour per period: a check of the monthly states."""
    keys = [S.STATION, "period_type", "period"]
    v = F.col(value)
    low, high = S.AUDIT_BOUNDS["pm25"]
    valid = F.max((v.isNotNull() & ~F.isnan(v) & ~fn.is_nonfinite(v) & v.between(low, high)).cast("int"))
    hourly = df.groupBy(S.STATION, S.TIME).agg(valid.alias("_valid"), F.max(v).alias(value))
    ends = hourly.groupBy(S.STATION).agg(F.min(S.TIME).alias("_lo"), F.max(S.TIME).alias("_hi"))
    keyed = with_periods(hourly).withColumn("_hour", hour_number(S.TIME))
    r = runs(keyed, keys, "_hour", v.isNull()).join(ends, S.STATION)
    opens = v.isNull() & (F.col("run_first") == F.col("_hour"))
    start = F.coalesce("period_start", "_lo")
    end = F.coalesce("period_end", F.timestamp_seconds(F.unix_seconds("_hi") + 3600))
    span = F.max((F.unix_seconds(end) - F.unix_seconds(start)) / 3600)
    n_valid = F.coalesce(F.sum("_valid"), F.lit(0))
    return r.groupBy(*keys).agg(
        n_valid.alias("valid_hours"),
        F.count_if(opens).alias("gap_count"),
        F.coalesce(F.max(F.when(opens, F.col("run_len"))), F.lit(0)).alias("longest_gap_hours"),
        (100.0 * n_valid / span).alias("coverage_pct_calendar"),
        (100.0 * n_valid / F.count(F.lit(1))).alias("coverage_pct_active"),
    )


def period_quality_table(df: DataFrame, raw: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """group_quality plus gap statistics and coverage against calendar and active hours.

    `gaps` is the table of `period_gaps`, where a caller has written it to keep plans small.
    """
    keys = [S.STATION, "period_type", "period"]
    out = group_quality(df, raw).join(period_gaps(df) if gaps is None else gaps, keys, "left")
    return out.withColumns(
        {
            "gap_count": F.coalesce("gap_count", F.lit(0)),
            "longest_gap_hours": F.coalesce("longest_gap_hours", F.lit(0)),
            "median_gap_hours": F.coalesce("median_gap_hours", F.lit(0.0)),
            "missing_pct_active": 100.0 * F.col("missing_hours") / F.col("active_grid_hours"),
            "coverage_pct_calendar": 100.0 * F.col("valid_hours") / F.col("expected_calendar_hours"),
            "coverage_pct_active": 100.0 * F.col("valid_hours") / F.col("active_grid_hours"),
        }
    )


def missing_by_key(df: DataFrame, keys: Mapping[str, Column], value: str = S.TARGET) -> DataFrame:
    """Totals and missing shares for each key on its own, from one pass of grouping sets."""
    cols = {f"_k_{n}": c.cast("string") for n, c in keys.items()}
    tagged = df.select(value, *[c.alias(n) for n, c in cols.items()])
    sets = [[n] for n in cols]
    agg = tagged.groupingSets(sets, *cols).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
        *[F.grouping(n).alias(f"_g{n}") for n in cols],
    )
    kind, level = F.lit(None), F.lit(None)
    for n in cols:
        kind = F.when(F.col(f"_g{n}") == 0, n[3:]).otherwise(kind)
        level = F.when(F.col(f"_g{n}") == 0, F.col(n)).otherwise(level)
    return agg.select(
        kind.alias("key"),
        level.alias("level"),
        "n_rows",
        "n_missing",
        (100.0 * F.col("n_missing") / F.col("n_rows")).alias("missing_pct"),
    )


def co_missing(df: DataFrame, target: str, other: str, keys: Sequence[str] = (S.STATION,)) -> DataFrame:
    """Joint missingness of two channels, and the other channel's level while the target is missing."""
    t, o = F.col(target), F.col(other)
    lone = F.when(t.isNull(), o)
    counts = df.groupBy(*keys).agg(
        F.count_if(t.isNull() & o.isNull()).alias("both_missing"),
        F.count_if(t.isNull() & o.isNotNull()).alias("only_target_missing"),
        F.count_if(t.isNotNull() & o.isNull()).alias("only_other_missing"),
        F.avg(lone).alias("other_mean_while_missing"),
        F.avg(o).alias("other_mean"),
    )
    m = quantiles(df.select(*keys, o.alias("_o")), keys, "_o", {"other_median": 0.5})
    ml = quantiles(df.select(*keys, lone.alias("_o")), keys, "_o", {"other_median_while_missing": 0.5})
    return counts.join(m, list(keys), "left").join(ml, list(keys), "left")


def resolve_duplicates(df: DataFrame) -> DataFrame:
    """One row per (station, hour); disagreement empties the hour instead of choosing a record.

    Input: station_id, timestamp, value, status, source. The aggregates keep
    only counts and extremes, so a key repeated without bound stays small.
    """
    ok = (F.col("status") == "valid") & F.col("value").isNotNull()
    rounded = F.round(F.when(ok, F.col("value")), 6)
    g = df.groupBy(S.STATION, S.TIME).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("_ok"),
        F.min(rounded).alias("_lo"),
        F.max(rounded).alias("_hi"),
        F.min("status").alias("_s0"),
        F.max("status").alias("_s1"),
        F.min(F.when(ok, F.col("value"))).alias("_value"),
    )
    same_valid = (F.col("_ok") == F.col("n")) & (F.col("_lo") == F.col("_hi"))
    same_invalid = (F.col("_ok") == 0) & (F.col("_s0") == F.col("_s1"))
    kind = (
        F.when(F.col("n") == 1, "single")
        .when(same_valid | same_invalid, "identical")
        .otherwise("conflict")
    )
    return g.select(
        S.STATION,
        S.TIME,
        "n",
        kind.alias("kind"),
        F.when(kind != "conflict", F.col("_value")).alias("value"),
        F.when(kind == "conflict", "conflicting_duplicate").otherwise(F.col("_s0")).alias("status"),
    )


def conflict_ledger(df: DataFrame) -> DataFrame:
    """The disagreeing records themselves, one row each; never collected into a list."""
    bad = resolve_duplicates(df).filter("kind = 'conflict'").select(S.STATION, S.TIME)
    return df.join(bad, [S.STATION, S.TIME], "left_semi").select(S.STATION, S.TIME, "source", "value", "status")


def duplicate_classes(df: DataFrame, keys: Sequence[str], record: Sequence[str], kind: str, status: str, value: str) -> DataFrame:
    """Classes of repeated keys over several files, with every record compared as a whole.

    The records of a key are reduced to distinct fingerprints first, so the
    second aggregate sees each distinct record once.
    """
    distinct = df.groupBy(*keys, *record, kind, status).agg(F.count(F.lit(1)).alias("_c"))
    print_ = F.xxhash64(*record, status)
    g = distinct.groupBy(*keys).agg(
        F.sum("_c").alias("n_rows"),
        F.min(print_).alias("_f0"),
        F.max(print_).alias("_f1"),
        F.min(value).alias("_v0"),
        F.max(value).alias("_v1"),
        F.bool_or(F.col(value).isNull()).alias("_null"),
        F.bool_or(F.col(status) == "valid").alias("_valid"),
        F.bool_or(F.col(status) == "invalid").alias("_invalid"),
        F.bool_or(F.col(kind) == "YTD").alias("_ytd"),
        F.bool_or(F.col(kind) == "MTD").alias("_mtd"),
    )
    conflict = (F.col("n_rows") > 1) & (F.col("_f0") != F.col("_f1"))
    overlap = F.col("_ytd") & F.col("_mtd")
    same = (F.col("n_rows") > 1) & ~conflict
    return g.agg(
        F.count(F.lit(1)).alias("n_hours"),
        F.sum(F.col("n_rows") - 1).alias("duplicate_rows"),
        F.count_if(overlap).alias("overlap_hours"),
        F.count_if(same & overlap).alias("identical_overlap_hours"),
        F.count_if(same & ~overlap).alias("identical_same_kind_hours"),
        F.count_if(conflict).alias("conflicting_hours"),
        F.count_if(conflict & (F.col("_v0") != F.col("_v1"))).alias("conflicting_numeric_hours"),
        F.count_if(conflict & F.col("_valid") & F.col("_null")).alias("missing_vs_valid_hours"),
        F.count_if(conflict & F.col("_valid") & F.col("_invalid")).alias("invalid_vs_valid_hours"),
    )


def source_coverage(status: DataFrame, start: str, end: str) -> DataFrame:
    """Month and year coverage of one source's hour statuses against the full calendar.

    status: station_id, timestamp, status (valid / invalid / conflicting). Hours
    outside a station's own first..last hour count as source unavailable.
    """
    spans = status.groupBy(S.STATION).agg(F.min(S.TIME).alias("_lo"), F.max(S.TIME).alias("_hi"))
    days = spans.select(
        S.STATION, "_lo", "_hi", F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval 1 day)")).alias("_d")
    )
    hours = days.select(
        S.STATION,
        "_lo",
        "_hi",
        F.explode(F.expr("sequence(timestamp(_d), timestamp(_d) + interval 23 hours, interval 1 hour)")).alias(S.TIME),
    )
    cal = hours.join(status, [S.STATION, S.TIME], "left").select(
        S.STATION,
        S.TIME,
        F.coalesce("status", F.lit("missing")).alias("status"),
        F.col(S.TIME).between(F.col("_lo"), F.col("_hi")).alias("available"),
    )
    cal = cal.withColumn("gap", F.col("available") & (F.col("status") != "valid"))
    keyed = (
        cal.withColumn(
            "_p",
            F.explode(
                F.array(
                    F.struct(F.lit("month").alias("period_type"), F.date_format(S.TIME, "yyyy-MM").alias("period")),
                    F.struct(F.lit("year").alias("period_type"), F.year(S.TIME).cast("string").alias("period")),
                )
            ),
        )
        .select(S.STATION, S.TIME, "status", "available", "gap", "_p.*")
        .withColumn("_hour", hour_number(S.TIME))
    )
    keys = [S.STATION, "period_type", "period"]
    r = runs(keyed, keys, "_hour", F.col("gap"))
    st = F.col("status")
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("expected_hours"),
        F.count_if(st != "missing").alias("reported_hours"),
        F.count_if(st == "valid").alias("valid_hours"),
        F.count_if(F.col("available") & st.isin("invalid", "conflicting")).alias("invalid_or_conflict_hours"),
        F.count_if(F.col("available") & (st == "missing")).alias("missing_while_available_hours"),
        F.count_if(~F.col("available")).alias("unavailable_hours"),
        F.count_if(st == "conflicting").alias("conflicting_hours"),
        F.coalesce(F.max(F.when(F.col("gap"), F.col("run_len"))), F.lit(0)).alias("longest_gap_hours"),
    )


def verdicts(df: DataFrame, checks: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """One aggregate for any number of row-level rules; one (check, violations, passed) row each."""
    cols = {f"_v{i}": F.count_if(~F.coalesce(c, F.lit(False))).alias(f"_v{i}") for i, c in enumerate(checks.values())}
    wide = df.groupBy(*keys).agg(*cols.values()) if keys else df.agg(*cols.values())
    rows = {
        name: {"violations": f"_v{i}", "passed": F.col(f"_v{i}") == 0} for i, name in enumerate(checks)
    }
    return stacked(wide, rows, "check", keys)


def clean_validation(df: DataFrame) -> DataFrame:
    """Verdicts on a cleaned air table per station: unique hourly keys, no negatives, fine <= coarse."""
    per_key = with_step(
        df.groupBy(S.STATION, S.TIME).agg(
            F.count(F.lit(1)).alias("n"),
            F.min("pm25").alias("_p25"),
            F.min("pm10").alias("_p10"),
            F.max(F.col("pm25") - F.col("pm10")).alias("_gap"),
        )
    )
    ok = lambda c: c.isNull() | c
    return verdicts(
        per_key,
        {
            "no_duplicate_keys": F.col("n") == 1,
            "hourly_step": F.col("step_hours").isNull() | (F.col("step_hours") == 1),
            "pm25_nonnegative": ok(F.col("_p25") >= 0),
            "pm10_nonnegative": ok(F.col("_p10") >= 0),
            "fine_not_above_coarse": ok(F.col("_gap") <= 1e-3),
            "timestamp_present": F.col(S.TIME).isNotNull(),
        },
        [S.STATION],
    )


def content_summary(df: DataFrame, value: str = S.TARGET, decimals: int = 6) -> DataFrame:
    """Per station: rows, observed rows, span and an order-free content fingerprint."""
    scaled = F.round(F.col(value) * 10**decimals).cast("long").cast("string")
    return df.groupBy(S.STATION).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n_observed"),
        F.min(S.TIME).alias("first_hour"),
        F.max(S.TIME).alias("last_hour"),
        F.sum(
            fn.draw32(F.col(S.STATION), F.unix_seconds(S.TIME), F.coalesce(scaled, F.lit("NULL")))
        ).alias("fingerprint"),
    )


def contract_check(actual: DataFrame, recorded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Recorded against actual numbers per station; one verdict row per station and column."""
    a = actual.select(S.STATION, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    r = recorded.select(S.STATION, *[F.col(c).cast("string").alias(f"r_{c}") for c in columns])
    cells = [
        F.struct(
            F.lit(c).alias("field"),
            F.col(f"r_{c}").alias("recorded"),
            F.col(f"a_{c}").alias("actual"),
            F.col(f"r_{c}").eqNullSafe(F.col(f"a_{c}")).alias("passed"),
        )
        for c in columns
    ]
    return r.join(a, S.STATION, "full_outer").select(S.STATION, F.explode(F.array(*cells)).alias("_r")).select(
        S.STATION, "_r.*"
    )


def flag_audit(df: DataFrame, flag: str, value: str = S.TARGET) -> DataFrame:
    """A 0/1 flag against the target, overall and by season."""
    tagged = df.select(
        S.STATION, F.col(flag).alias("_f"), F.col(value).alias("_v"), fn.season(S.TIME).alias("season")
    )
    both = tagged.withColumn("season", F.explode(F.array("season", F.lit("ALL"))))
    keys = [S.STATION, "season"]
    on, off = F.col("_f") == 1, F.col("_f") == 0
    base = both.groupBy(*keys).agg(
        F.count_if(on).alias("n_on"),
        F.count_if(off).alias("n_off"),
        (F.min("_f") == F.max("_f")).alias("is_constant"),
        (F.avg(F.when(on, F.col("_v"))) - F.avg(F.when(off, F.col("_v")))).alias("mean_difference"),
    )
    med = quantiles(both.filter("_f is not null"), [*keys, "_f"], "_v", {"_m": 0.5})
    diff = med.groupBy(*keys).agg((F.max(F.when(on, F.col("_m"))) - F.max(F.when(off, F.col("_m")))).alias("median_difference"))
    return base.join(diff, keys, "left")


def input_contract(df: DataFrame, stations: Sequence[str], value: str = S.TARGET) -> DataFrame:
    """Row rules of the extended table: identity, ranges, derived flag, season columns, hourly steps."""
    stepped = with_step(df)
    low, high = S.AUDIT_BOUNDS["pm25"]
    v, d = F.col(value), F.col(f"{value}_derived")
    return verdicts(
        stepped,
        {
            "known_station": F.col(S.STATION).isin(list(stations)),
            "value_in_range": v.isNull() | v.between(low, high),
            "derived_in_range": d.isNull() | d.between(low, high),
            "observed_unchanged": v.isNull() | (d == v),
            "derived_flag": F.col("is_derived") == (v.isNull() & d.isNotNull()),
            "season": F.col("season") == fn.season(S.TIME),
            "winter_year": F.col("winter_year").eqNullSafe(fn.winter_year(S.TIME)),
            "hourly_step": F.col("step_hours").isNull() | (F.col("step_hours") == 1),
        },
    )


def table_identities(quality: DataFrame) -> DataFrame:
    """Arithmetic identities every published quality row must satisfy."""
    close = lambda a, b: F.abs(a - b) <= 1e-9
    q = F.col
    passed = lambda c: F.when(c, "PASS").otherwise("FAIL")
    return verdicts(
        quality,
        {
            "valid_plus_missing_is_active": q("valid_hours") + q("missing_hours") == q("active_grid_hours"),
            "active_plus_outside_is_calendar": q("active_grid_hours") + q("outside_active_hours")
            == q("expected_calendar_hours"),
            "coverage_calendar": close(q("coverage_pct_calendar"), 100.0 * q("valid_hours") / q("expected_calendar_hours")),
            "coverage_active": close(q("coverage_pct_active"), 100.0 * q("valid_hours") / q("active_grid_hours")),
            "completeness_status": q("completeness_status") == passed(q("valid_hours") == q("active_grid_hours")),
            "partial_flag": q("partial_period") == (q("outside_active_hours") > 0),
            "longest_gap_bounded": q("longest_gap_hours") <= q("missing_hours"),
        },
    )


def result_identities(results: DataFrame, alpha: float = S.ALPHA) -> DataFrame:
    """Identities of a published test table: family, estimate, ci_low, ci_high, p, holm_p, rejected."""
    redone = holm(results, ["family"], "p", "test").select("family", "test", F.col("holm_p").alias("_again"))
    j = results.join(redone, ["family", "test"], "left")
    return verdicts(
        j,
        {
            "estimate_inside_interval": F.col("estimate").between(F.col("ci_low"), F.col("ci_high")),
            "p_in_unit_interval": F.col("p").between(0, 1) & F.col("holm_p").between(0, 1),
            "holm_not_below_raw": F.col("holm_p") >= F.col("p") - 1e-12,
            "holm_recomputed": F.abs(F.col("holm_p") - F.col("_again")) <= 1e-10,
            "decision": F.col("rejected") == (F.col("holm_p") < alpha),
        },
    )


def dataset_summary(df: DataFrame, value: str = S.TARGET) -> DataFrame:
    per = df.groupBy(S.STATION).agg(
        F.min(S.TIME).alias("first_hour"),
        F.max(S.TIME).alias("last_hour"),
        F.count(F.lit(1)).alias("grid_rows"),
        F.count(value).alias("valid_rows"),
        (100.0 * F.count_if(F.col(value).isNull()) / F.count(F.lit(1))).alias("missing_pct"),
    )
    return per.withColumn("total_rows", F.sum("grid_rows").over(W.partitionBy(F.lit(0))))


def monthly_coverage(df: DataFrame, value: str = S.TARGET) -> DataFrame:
    """Observed hours per station-month against the month's full calendar hours."""
    first = F.trunc(F.col(S.TIME).cast("date"), "month")
    per = df.groupBy(S.STATION, first.alias("_m")).agg(F.count(value).alias("n"))
    expected = F.datediff(F.add_months("_m", 1), F.col("_m")) * 24
    return per.select(
        S.STATION,
        F.date_format("_m", "yyyy-MM").alias("period"),
        "n",
        expected.cast("long").alias("expected_hours"),
        (100.0 * F.col("n") / expected).alias("coverage_pct_calendar"),
    )


def gap_overview(df: DataFrame) -> DataFrame:
    """Station-level gap summary used by the composite audit."""
    return missing_runs(df).groupBy(S.STATION).agg(
        F.count(F.lit(1)).alias("n_gaps"),
        F.max("gap_hours").alias("longest_gap"),
        F.count_if(F.col("gap_hours") == 1).alias("n_isolated"),
    )
