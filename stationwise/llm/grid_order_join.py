"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .jaccard_join import attach, components

#: Leading principal dimensions of the grid.
DIMS = 8
#: Vectors of an interval of the sequence that travel together.
BLOCK = 4096
#: Vectors of the shortest intervals, compared by one matrix product.
LEAF = 256
#: Intervals that one task compares its own interval with.
PARTNERS = 16
#: An interval holds 2 ** FAN intervals of the next level.
FAN = 4
#: Vectors of different lengths are so far apart in the first coordinate.
APART = 10.0
COORDS = [f"y{j}" for j in range(DIMS + 1)]


def good(v: Column) -> Column:
    """Not null, not zero, all components present and finite."""
    whole = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(whole & F.exists(v, lambda e: e != 0), F.lit(False))


def by_length(column: pa.Array):
    """(rows, matrix of unit vectors) of the vectors of each length."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(n):
        rows = np.flatnonzero(n == size)
        x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), size)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        yield rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame) -> np.ndarray:
    """Leading principal axes (size x DIMS) of all unit vectors of the most common length; results don't depend on them.

    Each task sends its moments, and these are added up by cell.
    """
    common = vectors.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if not common:
        return np.zeros((0, 0))
    size = common["size"]

    def moments(batches):
        g, s = np.zeros((size, size)), np.zeros(size)
        for b in batches:
            for _, x in by_length(b.column("v")):
                g += x.T @ x
                s += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size + size)), pa.array(np.concatenate([g.ravel(), s]))], names=["cell", "value"])

    parts = vectors.filter(F.size("v") == size).select("v").mapInArrow(moments, "cell long, value double")
    cells = parts.groupBy("cell").agg(F.sum("value").alias("value")).toPandas().sort_values("cell")["value"].to_numpy()  # size * (size + 1) rows
    g, s = cells[: size * size].reshape(size, size), cells[size * size :]
    return np.linalg.eigh(g - np.outer(s, s) / max(1, common["count"]))[1][:, ::-1][:, :DIMS]


def coordinates(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Length and leading coordinates of unit vectors; distances in them are never larger than in full."""
    y = x @ axes if x.shape[1] == len(axes) else x[:, :DIMS]
    out = np.zeros((len(x), DIMS + 1))
    out[:, 0] = APART * x.shape[1]
    out[:, 1 : 1 + y.shape[1]] = y
    return out


def apart(a: str, b: str) -> Column:
    """Squared distance between the boxes of two intervals."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{a}.lo_{c}") - F.col(f"{b}.hi_{c}"), F.col(f"{b}.lo_{c}") - F.col(f"{a}.hi_{c}")) for c in COORDS]
    return reduce(lambda s, g: s + g, [g * g for g in gaps])


def near_intervals(boxes: DataFrame, count: int, reach: float) -> DataFrame:
    """(a, b), a <= b, of the intervals that aren't provably distant.

    The sequence is halved FAN times a level, so a long interval is a shorter number. A
    pair of intervals that isn't distant is replaced by the pairs of their parts, down to
    single blocks; no level compares all its intervals.
    """
    level = 0
    while max(0, count - 1) >> (FAN * level):
        level += 1
    pairs = boxes.sparkSession.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))  # the whole sequence with itself
    for k in range(level - 1, -1, -1):
        ends = [f(f"{e}_{c}").alias(f"{e}_{c}") for c in COORDS for e, f in (("lo", F.min), ("hi", F.max))]
        nodes = boxes.groupBy(F.shiftright("block", FAN * k).alias("node")).agg(*ends).withColumn("up", F.shiftright("node", FAN))
        one, two = nodes.alias("one"), nodes.alias("two")
        both = pairs.join(one, F.col("a") == F.col("one.up")).join(two, F.col("b") == F.col("two.up"))
        near = both.filter((F.col("one.node") <= F.col("two.node")) & (apart("one", "two") <= reach))
        pairs = near.select(F.col("one.node").alias("a"), F.col("two.node").alias("b"))
    return pairs


def leaf_join(mine: dict, other: dict | None, threshold: float, reach: float):
    """Links of two intervals (or within one): rows (node, label, links), by leaves that aren't distant.

    A label is the smallest node that links of the leaf pair reach; links count the rows
    of linked vectors.
    """
    same = other is None
    other = mine if same else other
    cuts = [[slice(i, i + LEAF) for i in range(0, len(s["node"]), LEAF)] for s in (mine, other)]
    boxes = [(np.array([s["y"][c].min(0) for c in cut]), np.array([s["y"][c].max(0) for c in cut])) for s, cut in zip((mine, other), cuts)]
    gap = np.maximum(0, np.maximum(boxes[0][0][:, None] - boxes[1][1][None], boxes[1][0][None] - boxes[0][1][:, None]))
    out = []
    for i, j in zip(*np.nonzero((gap * gap).sum(2) <= reach)):
        if same and j < i:
            continue
        p, q = cuts[0][i], cuts[1][j]
        left, right = mine["x"][p], other["x"][q]
        s = left @ right.T
        link = s >= threshold
        for r, c in zip(*np.nonzero(np.abs(s - threshold) < 1e-13)):
            link[r, c] = (left[r] * right[c]).sum() >= threshold
        a, b = mine["node"][p], other["node"][q]
        if same and i == j:
            np.fill_diagonal(link, False)
            link = np.triu(link)
        if not link.any():
            continue
        at_a, at_b = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
        link = link[np.ix_(at_a, at_b)]
        low_a, low_b = a[at_a], b[at_b]
        while True:
            new_b = np.minimum(low_b, np.where(link, low_a[:, None], np.iinfo(np.int64).max).min(0))
            new_a = np.minimum(low_a, np.where(link, new_b[None], np.iinfo(np.int64).max).min(1))
            if (new_a == low_a).all() and (new_b == low_b).all():
                break
            low_a, low_b = new_a, new_b
        out.append((a[at_a], low_a, link @ other["held"][q][at_b]))
        out.append((b[at_b], low_b, mine["held"][p][at_a] @ link))
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of the table: vec_id, n_links, component_id, kept; vectors link by cosine >= threshold, in double precision.

    1. Equal vectors are one class with a count of rows.
    2. Classes are sorted by the cells of an epsilon grid on leading principal dimensions
       of the unit vectors (a cosine is a distance there), and the sequence cut into blocks.
    3. Interval pairs are split, level by level, as long as their boxes are within reach.
    4. Pairs of blocks meet in a task, which goes on to short intervals, and compares
       those that are within reach by a matrix product. It sends per vector a count of
       links and the smallest node reached, never the pairs.
    5. Connected components by stars, in written rounds.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing: no links, their own id as component. Vectors of different lengths don't link.
    n_links counts other rows, so repeated rows of a key count. Rows without a key have the
    component of the others they reach (null if none has a key); kept is whether both ids
    are the same, two nulls included. Extra columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[vector]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v = F.col(f"`{vector}`").cast(kind)
    src = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.when(good(v), v).alias("v"))
    reach = (2 - 2 * threshold) * (1 + 1e-9) + 1e-12
    width = float(np.sqrt(reach))

    def sign(batches):
        for b in batches:
            at = b.column("v")
            at = at if isinstance(at, pa.ListArray) else at.cast(pa.list_(at.type.value_type))
            ends, flat = at.offsets.to_numpy(), at.values.to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
            present = at.is_valid().to_numpy(zero_copy_only=False)
            digest = [hashlib.md5(flat[i:j].tobytes()).digest() if ok else None for i, j, ok in zip(ends[:-1], ends[1:], present)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(digest, pa.binary()), b.column("v")], names=["vec_id", "digest", "v"])

    signed = src.mapInArrow(sign, f"vec_id long, digest binary, v {kind}")
    own = written(signed.select("vec_id", "digest"), "own")
    axes = principal_axes(src.filter("v is not null"))
    classes = signed.filter("v is not null").groupBy("digest").agg(F.min("vec_id").alias("low"), F.count("*").alias("held"), F.first("v").alias("v"))

    def place(batches):
        for b in batches:
            y = np.zeros((b.num_rows, DIMS + 1))
            for rows, x in by_length(b.column("v")):
                y[rows] = coordinates(x, axes)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(np.floor(y / width).astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("digest", "low", "held", "v")), cells, *map(pa.array, y.T)], names=["digest", "low", "held", "v", "cells", *COORDS])

    placed = f"digest binary, low long, held long, v {kind}, cells array<int>, " + ", ".join(f"{c} double" for c in COORDS)
    ordered = classes.mapInArrow(place, placed).sort("cells", "digest").withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered.drop("cells"), "ordered")
    counts = {r["part"]: r["count"] for r in ordered.groupBy(F.shiftright("at", 33).alias("part")).count().collect()}  # a row per partition
    before, total = {}, 0
    for part in sorted(counts):
        before[part] = total
        total += counts[part]

    def number(batches):
        """The place in the sequence is a vector's node."""
        for b in batches:
            at = b.column("at").to_numpy()
            node = (at & ((1 << 33) - 1)) + np.array([before[p] for p in (at >> 33).tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node // BLOCK), *(b.column(c) for c in b.schema.names if c != "at")], names=["node", "block", *(c for c in b.schema.names if c != "at")])

    numbered = ordered.mapInArrow(number, "node long, block long, " + placed.replace(", cells array<int>", ""))
    ends = [f(c).alias(f"{e}_{c}") for c in COORDS for e, f in (("lo", F.min), ("hi", F.max))]
    boxes = written(numbered.groupBy("block").agg(*ends), "boxes")
    pairs = written(near_intervals(boxes, -(-total // BLOCK), reach), "pairs")
    dealt = pairs.withColumn("group", F.floor((F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1) / PARTNERS).cast("int"))
    asks = dealt.filter("a != b").select("a", "group", F.col("b").alias("block"), F.lit(1).alias("ask"))
    homes = dealt.groupBy("a", "group").agg(F.max(F.col("a") == F.col("b")).alias("self")).select("a", "group", F.col("a").alias("block"), F.when(F.col("self"), -1).otherwise(0).alias("ask"))
    by = ["a", "group", "ask", "node"]
    visits = homes.unionByName(asks).join(numbered.select("block", "node", "held", "v"), "block")
    visits = visits.repartition("a", "group").sortWithinPartitions(*by)

    def compare(batches):
        now, held, ready, alone = None, [], None, False

        def side(parts):
            """Vectors of one length each, in order."""
            for size in {p["x"].shape[1] for p in parts}:
                same = [p for p in parts if p["x"].shape[1] == size]
                yield size, {c: np.concatenate([p[c] for p in same]) for c in same[0]}

        def rows(found):
            cols = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else ((), (), ()))]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["node", "label", "links"])

        def settle():
            nonlocal ready
            if ready is None:
                ready = dict(side(held))
                if alone:
                    return [f for s in ready.values() for f in leaf_join(s, None, threshold, reach)]
            return []

        for b in batches:
            if not b.num_rows:
                continue
            kinds = np.stack([b.column(c).to_numpy() for c in by[:3]], axis=1)
            cuts = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]).any(1)) + 1).tolist(), len(kinds)]
            found = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                place_, ask = tuple(kinds[lo, :2].tolist()), kinds[lo, 2]
                if place_ != now:
                    if now is not None:
                        found += settle()
                    now, held, ready = place_, [], None
                part = b.slice(lo, hi - lo)
                node, many = part.column("node").to_numpy(), part.column("held").to_numpy()
                parts = [{"node": node[r], "held": many[r], "x": x, "y": coordinates(x, axes)} for r, x in by_length(part.column("v"))]
                if ask < 1:
                    alone = ask < 0
                    held += parts
                else:
                    found += settle()
                    for size, s in side(parts):
                        if size in ready:
                            found += leaf_join(ready[size], s, threshold, reach)
            yield rows(found)
        if now is not None:
            yield rows(settle())

    linked = written(visits.select("a", "group", "ask", "node", "held", "v").mapInArrow(compare, "node long, label long, links long"), "linked")
    degree = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("node").alias("a"), F.col("label").alias("b")))
    nodes = numbered.select("node", "digest", "low", "held").join(degree, "node", "left").join(roots, "node", "left")
    nodes = written(nodes.withColumn("root", F.coalesce("root", "node")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("held") - 1), "nodes")
    least = written(nodes.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("held")), "least")
    named = written(attach(nodes.withColumnRenamed("held", "many"), least, "root", "node", total).select("digest", F.col("links").alias("n_links"), "component_id", F.col("many").alias("held")), "named")
    out = attach(own, named, "digest", "vec_id", own.count())
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
