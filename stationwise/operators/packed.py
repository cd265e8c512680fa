"""Packed block replicates: one row per replicate, none per replicate and day.

A calendar travels as one array per station beside the numbers of the replicates a task
draws; a NumPy kernel takes the statistics of a few hundred replicates at once and returns
one row for each. All block lengths use the same draws, and any number of statistics the
same replicates. A calendar is bounded by its days (36,525 a century).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Replicates of one row that goes to a task.
BATCH = 256
#: Cells of a replicate matrix that are worked on at once.
CELLS = 1 << 20
#: Stands for a label that is null or has no day.
NO_LABEL = "\0"


class Ranking:
    """Distinct values of a series in order; NaN is missing (code -1)."""

    def __init__(self, values: np.ndarray):
        self.values, code = np.unique(values, return_inverse=True)
        self.values = self.values[~np.isnan(self.values)]
        self.code = np.where(np.isnan(values), -1, code).astype(np.int32)

    def ranks(self, code: np.ndarray) -> np.ndarray:
        """Average ranks inside each row of codes; 0 where missing."""
        k = len(self.values) + 1
        rows = np.arange(len(code))[:, None]
        held = np.bincount((rows * k + code + 1).ravel(), minlength=len(code) * k).reshape(-1, k)
        held[:, 0] = 0
        rank = held.cumsum(axis=1) - (held - 1) / 2.0
        rank[:, 0] = 0
        return rank[rows, code + 1]


class Replicates:
    """Replicates of one calendar: `source` (replicates x days) holds the day that each cell's value comes from.

    Values, with NaN where missing, move with their day; labels stay at their place.
    """

    def __init__(self, calendar: Mapping[str, np.ndarray], source: np.ndarray, rankings: dict):
        self.calendar, self.source, self._rankings = calendar, source, rankings

    def matrix(self, value: str = "value") -> np.ndarray:
        return self.calendar[value][self.source]

    def labels(self, label: str) -> np.ndarray:
        return self.calendar[label]

    def ranking(self, value: str, absolute: bool = False) -> Ranking:
        key = (value, absolute)
        if key not in self._rankings:
            v = self.calendar[value]
            self._rankings[key] = Ranking(np.abs(v) if absolute else v)
        return self._rankings[key]


@dataclass(frozen=True)
class Statistic:
    """Names of results and a function of Replicates that returns (replicates x names); NaN where undefined.

    `value` and `labels` are the columns of the calendar that it reads. With `blocks` it is
    taken for these block lengths only.
    """

    names: tuple[str, ...]
    run: Callable[[Replicates], np.ndarray]
    value: str = "value"
    labels: tuple[str, ...] = ()
    blocks: tuple[int, ...] | None = field(default=None)


def _safe(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, np.nan)


def mean(value: str = "value", name: str = "stat") -> Statistic:
    def run(r: Replicates) -> np.ndarray:
        m = r.matrix(value)
        with np.errstate(invalid="ignore"):
            return np.nansum(m, axis=1) / (~np.isnan(m)).sum(axis=1)

    return Statistic((name,), run, value)


def median(value: str = "value", name: str = "stat") -> Statistic:
    """By the places of values in the calendar's order, so that replicates are sorted as small integers."""

    def run(r: Replicates) -> np.ndarray:
        ranking = r.ranking(value)
        k = len(ranking.values)
        code = np.where(ranking.code < 0, k, ranking.code).astype(np.int16 if k < 1 << 15 else np.int32)[r.source]
        n = (code < k).sum(axis=1)
        code.sort(axis=1, kind="stable")
        rows, at = np.arange(len(code)), np.maximum(n - 1, 0)
        v = np.append(ranking.values, np.nan)
        low, high = v[code[rows, at // 2]], v[code[rows, np.minimum((at + 1) // 2, code.shape[1] - 1)]]
        return np.where(n > 0, low + (high - low) * 0.5, np.nan)

    return Statistic((name,), run, value)


def kruskal(label: str, n_labels: int, value: str = "value", name: str = "stat", blocks: Sequence[int] | None = None) -> Statistic:
    """Kruskal-Wallis H without tie correction; undefined where a replicate lacks a label. Days without a label take no part."""

    def run(r: Replicates) -> np.ndarray:
        ranking, labels = r.ranking(value), r.labels(label)
        known = labels != NO_LABEL if labels.dtype.kind == "U" else ~np.isnan(labels)
        labels = labels[known]
        code = ranking.code[r.source[:, known]]
        rank, seen = ranking.ranks(code), code >= 0
        n = seen.sum(axis=1).astype(float)
        total, groups = np.zeros(len(code)), np.zeros(len(code), int)
        for g in np.unique(labels):
            at = labels == g
            k = seen[:, at].sum(axis=1).astype(float)
            s = rank[:, at].sum(axis=1)
            total += np.divide(s * s, k, out=np.zeros_like(s), where=k > 0)
            groups += k > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            h = 12 / (n * (n + 1)) * total - 3 * (n + 1)
        return np.where(groups == n_labels, h, np.nan)

    return Statistic((name,), run, value, (label,), tuple(blocks) if blocks else None)


def rank_sums(label: str, pairs: Sequence[tuple], biserial: bool = False, value: str = "value", names: Sequence[str] = ("stat",), blocks: Sequence[int] | None = None) -> Statistic:
    """Mann-Whitney U (or rank-biserial) of each pair of labels, ranks taken inside the pair."""

    def run(r: Replicates) -> np.ndarray:
        ranking = r.ranking(value)
        out = np.full((len(r.source), len(pairs)), np.nan)
        for j, (a, b) in enumerate(pairs):
            is_a, is_b = r.labels(label) == a, r.labels(label) == b
            code = ranking.code[r.source[:, is_a | is_b]]
            mine, seen = is_a[is_a | is_b], code >= 0
            na, nb = (seen[:, side].sum(axis=1).astype(float) for side in (mine, ~mine))
            u = ranking.ranks(code)[:, mine].sum(axis=1) - na * (na + 1) / 2
            with np.errstate(divide="ignore", invalid="ignore"):
                out[:, j] = np.where((na > 0) & (nb > 0), 2 * u / (na * nb) - 1 if biserial else u, np.nan)
        return out

    return Statistic(tuple(names), run, value, (label,), tuple(blocks) if blocks else None)


def student(value: str = "value", name: str = "stat", blocks: Sequence[int] | None = None) -> Statistic:
    """Mean over its standard error; undefined below two values or without spread."""

    def run(r: Replicates) -> np.ndarray:
        m = r.matrix(value)
        n = (~np.isnan(m)).sum(axis=1).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            centre = np.nansum(m, axis=1) / n
            v = np.nansum((m - centre[:, None]) ** 2, axis=1) / (n - 1)
            return np.where((n > 1) & (v > 0), centre / np.sqrt(v / n), np.nan)

    return Statistic((name,), run, value, (), tuple(blocks) if blocks else None)


def signed_ranks(value: str = "value", name: str = "stat", blocks: Sequence[int] | None = None) -> Statistic:
    """Sum of the ranks of absolute values over positive values; undefined without values."""

    def run(r: Replicates) -> np.ndarray:
        ranking = r.ranking(value, absolute=True)
        code = ranking.code[r.source]
        with np.errstate(invalid="ignore"):
            positive = (r.calendar[value] > 0)[r.source]
        total = np.where(positive, ranking.ranks(code), 0).sum(axis=1)
        return np.where((code >= 0).any(axis=1), total, np.nan)

    return Statistic((name,), run, value, (), tuple(blocks) if blocks else None)


def user_statistic(function: Callable[..., np.ndarray], names: Sequence[str] = ("stat",), value: str = "value", labels: Sequence[str] = ()) -> Statistic:
    """A caller's function of the matrix of values (replicates x days, NaN where missing) and of one label array per name.

    It returns one result per replicate, or (replicates x names). It must skip NaN itself,
    and is run in tasks, so it should import what it needs.
    """

    def run(r: Replicates) -> np.ndarray:
        return np.asarray(function(r.matrix(value), *(r.labels(c) for c in labels)), float)

    return Statistic(tuple(names), run, value, tuple(labels))


def named(statistic: str | Statistic | Callable, value: str = "value") -> Statistic:
    """median, mean, a Statistic, or a function for user_statistic."""
    if isinstance(statistic, Statistic):
        return statistic
    if callable(statistic):
        return user_statistic(statistic, value=value)
    if statistic not in ("median", "mean"):
        raise ValueError(f"statistic must be median or mean, got {statistic!r}")
    return median(value) if statistic == "median" else mean(value)


def draws(prefix: str, first: int, last: int, count: int) -> np.ndarray:
    """32-bit draws (replicates x count), the first 32 bits of md5('prefix:b:j') as `draw32` has them."""
    tails = [b"%d" % j for j in range(count)]
    out = np.empty((last - first + 1, count), np.int64)
    for i, b in enumerate(range(first, last + 1)):
        head = hashlib.md5(f"{prefix}:{b}:".encode())
        digests = []
        for t in tails:
            h = head.copy()
            h.update(t)
            digests.append(h.digest()[:4])
        out[i] = np.frombuffer(b"".join(digests), ">u4")
    return out


def block_sources(drawn: np.ndarray, n: int, block: int) -> np.ndarray:
    """Source day of each cell: circular blocks of `block` days from the drawn starts, cut at n."""
    size = min(block, n)
    starts = (drawn[:, : -(-n // size)] % n).astype(np.int32)
    cells = (starts[:, :, None] + np.arange(size, dtype=np.int32)).reshape(len(drawn), -1)[:, :n]
    return np.where(cells >= n, cells - n, cells)


def packed_calendar(calendar: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per key: days as an array of (pos, columns), in order, and their number."""
    cells = F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("_cells")
    return calendar.groupBy(*keys).agg(cells, (F.max("pos") + 1).alias("_n"))


def unpacked(cells: pa.StructArray, n: int, columns: Sequence[str]) -> dict[str, np.ndarray]:
    """Arrays over all n days; numbers as doubles with NaN where missing, other labels as objects."""
    at = cells.field("pos").to_numpy(zero_copy_only=False)
    out = {}
    for c in columns:
        col = cells.field(c)
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            names = np.array([x if x is not None else NO_LABEL for x in col.to_pylist()], object)
            full = np.full(n, NO_LABEL, object)
            full[at] = names
            out[c] = full.astype(str)
        else:
            full = np.full(n, np.nan)
            full[at] = col.cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[c] = full
    return out


def spread_out(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to all cores by key; few and small rows that mean much work stay in several tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


def batches_of(n_boot: int) -> Column:
    """First and last number of each batch of replicates, 1 to n_boot."""
    starts = F.sequence(F.lit(1), F.lit(n_boot), F.lit(BATCH))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + BATCH - 1, F.lit(n_boot)).alias("last")))


def replicate_stats(calendar: DataFrame, n_boot: int, blocks: Sequence[int], seed: int, statistics: Sequence[Statistic], keys: Sequence[str], observed_of: str = "value") -> DataFrame:
    """keys, block, b, the statistics' names, and n_observed (values of `observed_of` in the replicate).

    A statistic is null where it is undefined or not taken for a block length.
    """
    keys, names = list(keys), [x for s in statistics for x in s.names]
    columns = list(dict.fromkeys([observed_of, *(c for s in statistics for c in (s.value, *s.labels))]))
    key_types = {f.name: f.dataType.simpleString() for f in calendar.schema.fields if f.name in keys}
    prefix = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    rows = packed_calendar(calendar, columns, keys).withColumn("_prefix", prefix).withColumn("_batch", F.explode(batches_of(n_boot)))
    rows = spread_out(rows.select("*", "_batch.*").drop("_batch"), *keys, "first")
    blocks = sorted(set(blocks))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i] for c in batch.schema.names}
                n, first, last = one["_n"].as_py(), one["first"].as_py(), one["last"].as_py()
                days = unpacked(one["_cells"].values, n, columns)
                drawn = draws(one["_prefix"].as_py(), first, last, max(-(-n // min(b, n)) for b in blocks))
                rankings: dict = {}
                seen = ~np.isnan(days[observed_of])
                for block in blocks:
                    found = []
                    step = max(1, CELLS // n)
                    for lo in range(0, len(drawn), step):
                        source = block_sources(drawn[lo : lo + step], n, block)
                        r = Replicates(days, source, rankings)
                        parts = [s.run(r).reshape(len(source), -1) if s.blocks is None or block in s.blocks else np.full((len(source), len(s.names)), np.nan) for s in statistics]
                        found.append(np.column_stack([*parts, seen[source].sum(axis=1)]))
                    found = np.concatenate(found)
                    size = len(found)
                    cols = [pa.repeat(one[k], size) for k in keys]
                    cols += [pa.array(np.full(size, block, np.int64)), pa.array(np.arange(first, last + 1, dtype=np.int32))]
                    cols += [pa.array(_safe(found[:, j]), from_pandas=True) for j in range(len(names))]
                    cols += [pa.array(found[:, -1].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=[*keys, "block", "b", *names, "n_observed"])

    schema = ", ".join([*(f"`{k}` {key_types[k]}" for k in keys), "block long", "b int", *(f"`{x}` double" for x in names), "n_observed long"])
    return rows.mapInArrow(run, schema)


def identity_stats(calendar: DataFrame, statistic: Statistic, keys: Sequence[str]) -> DataFrame:
    """keys and the statistic's names, taken of the calendar as it is."""
    keys = list(keys)
    columns = list(dict.fromkeys([statistic.value, *statistic.labels]))
    key_types = {f.name: f.dataType.simpleString() for f in calendar.schema.fields if f.name in keys}
    rows = packed_calendar(calendar, columns, keys)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("_n")[i].as_py()
                days = unpacked(batch.column("_cells")[i].values, n, columns)
                found = _safe(statistic.run(Replicates(days, np.arange(n)[None], {})).reshape(1, -1))
                cols = [pa.repeat(batch.column(k)[i], 1) for k in keys]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(found[:, j], from_pandas=True) for j in range(found.shape[1]))], names=[*keys, *statistic.names])

    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {key_types[k]}" for k in keys), *(f"`{x}` double" for x in statistic.names)]))


def window_replicates(windows: DataFrame, calendar: DataFrame, n_boot: int, seed: int, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """`group`, b and the array `values` of each replicate; as many observed values as the group has.

    `windows` has start, len, _obs, n_target, _lo and _hi of the windows of each group. A
    draw picks the window that holds it, and a replicate draws until it is full, no more.
    """
    keys, group = list(keys), list(group)
    cols = ["start", "len", "_obs", "n_target", "_lo", "_hi"]
    key_types = {f.name: f.dataType.simpleString() for f in windows.schema.fields if f.name in group}
    prefix = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in group])
    wins = windows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("_wins"))
    rows = wins.join(packed_calendar(calendar, ["value"], keys), keys).withColumn("_prefix", prefix)
    rows = rows.withColumn("_batch", F.explode(batches_of(n_boot))).select("*", "_batch.*").drop("_batch")
    rows = spread_out(rows, *group, "first")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i] for c in batch.schema.names}
                first, last = one["first"].as_py(), one["last"].as_py()
                values = unpacked(one["_cells"].values, one["_n"].as_py(), ["value"])["value"]
                seen = ~np.isnan(values)
                before = np.concatenate([[0], seen.cumsum()])
                start, _, obs, target, _, high = (one["_wins"].values.field(c).to_numpy(zero_copy_only=False) for c in cols)
                target = int(target[0])
                size = last - first + 1
                picked = np.zeros((size, 0), np.int64)
                while not picked.shape[1] or (obs[picked].sum(axis=1) < target).any():
                    more = max(8, int(1.2 * target / obs.mean()) - picked.shape[1])
                    u = draws(one["_prefix"].as_py(), first, last, picked.shape[1] + more)[:, picked.shape[1] :] / 4294967296.0
                    picked = np.hstack([picked, np.searchsorted(high, u, side="right").clip(max=len(high) - 1)])
                taken = obs[picked]
                past = taken.cumsum(axis=1) - taken
                taken = np.clip(target - past, 0, taken)
                flat = taken.ravel()
                at = np.repeat(before[start[picked]].ravel() - (flat.cumsum() - flat), flat) + np.arange(flat.sum())
                out = values[seen][at]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, target, dtype=np.int32)), pa.array(out))
                fixed = [pa.repeat(one[k], size) for k in group]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(first, last + 1, dtype=np.int32)), lists], names=[*group, "b", "values"])

    schema = ", ".join([*(f"`{k}` {key_types[k]}" for k in group), "b int", "values array<double>"])
    return rows.mapInArrow(run, schema)
