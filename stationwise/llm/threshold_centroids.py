"""Integer centroid clustering; the nearest centroid of a vector is found by the threshold algorithm."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Vectors that walk the sorted lists together.
BATCH = 2048
#: Components up to this size have squared distances that fit 64 bits in any sum of 2^6 of them.
SMALL = 1 << 27
#: Components from this size on do not fit a long.
WIDE = float(1 << 63)


def kept_vectors(vectors: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """vec_id and v (double) of the vectors with `dim` components, none null or non-finite, all of which fit a long when scaled."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) * scale < WIDE))
    out = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v"))
    return out.filter(F.coalesce((F.size("v") == dim) & good, F.lit(False)))


def integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * scale).astype(np.int64)


def exact_distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows; Python integers where 64 bits could overflow."""
    d = x - c
    return (d * d).sum(axis=-1)


def nearest_centroids(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row of x, ties to the smaller number.

    Each dimension has its centroids sorted by their component. From a vector's own value
    two pointers walk outward, so centroids come up in the order of their distance in that
    dimension. A centroid that comes up anywhere is compared exactly, once. One that hasn't
    come up is at least as far in each dimension as that list's last step (the frontier);
    the walk ends when the squares of the frontiers add up to more than the best distance.
    """
    wide = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) > SMALL
    if wide:
        x, centroids = x.astype(object), centroids.astype(object)
    k, dim = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    lists = np.take_along_axis(centroids, order, axis=0)
    kind = object if wide else np.int64
    number, best = np.zeros(len(x), np.int64), np.zeros(len(x), kind)
    dims = np.arange(dim)
    for lo in range(0, len(x), BATCH):
        rows = np.arange(lo, min(lo + BATCH, len(x)))
        v = x[rows]
        right = np.stack([np.searchsorted(lists[:, j], v[:, j]) for j in range(dim)], axis=1)
        left = right - 1
        seen = np.zeros((len(rows), k), bool)
        near, far = np.full(len(rows), k), None
        for step in range(k):
            down = v - lists[np.maximum(left, 0), dims]
            up = lists[np.minimum(right, k - 1), dims] - v
            go_left = (left >= 0) & ((right >= k) | (down <= up))
            frontier = np.where(go_left, down, up)
            came = order[np.where(go_left, left, right), dims]
            left, right = left - go_left, right + ~go_left
            new = np.zeros_like(seen)
            new[np.arange(len(rows))[:, None], came] = True
            new &= ~seen
            seen |= new
            r, c = np.nonzero(new)
            d = exact_distance(v[r], centroids[c])
            if far is None:  # in the first step each vector meets a centroid
                far = np.zeros(len(rows), kind)
                far[r[::-1]] = d[::-1]
                near[r[::-1]] = c[::-1]
            for at in range(k):  # centroids in ascending order, so that an equal distance changes nothing
                mine = c == at
                better = (d[mine] < far[r[mine]]) | ((d[mine] == far[r[mine]]) & (at < near[r[mine]]))
                far[r[mine][better]], near[r[mine][better]] = d[mine][better], at
            go = (frontier * frontier).sum(axis=1) <= far
            if step == k - 1 or not go.any():
                number[rows], best[rows] = near, far
                break
            if not go.all():
                number[rows[~go]], best[rows[~go]] = near[~go], far[~go]
                rows, v, left, right, seen, near, far = rows[go], v[go], left[go], right[go], seen[go], near[go], far[go]
    return number, best


def first_centroids(kept: DataFrame, k: int, dim: int, scale: int) -> np.ndarray:
    """The k kept vectors of the smallest sha256 of '1:<vec_id>'; rows without an id come last."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(name.alias("name"), "vec_id", "v").orderBy(F.asc_nulls_last("name"), "v").limit(k).collect()
    return np.floor(np.array([r["v"] for r in rows], float).reshape(len(rows), dim) * scale).astype(np.int64)


def moved(kept: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; one without vectors stays.

    A task sends one sum per centroid and dimension, so a cluster with most of the
    vectors is added up where its vectors are.
    """
    k, dim = centroids.shape

    def sums(batches):
        total, n = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                x = integers(b.column("v"), dim, scale)
                at = nearest_centroids(x, centroids)[0]
                n += np.bincount(at, minlength=k)
                x = x if np.abs(x).max() < 1 << 40 else x.astype(object)
                for c in np.unique(at):
                    total[c] += x[at == c].sum(axis=0)
        c, j = np.meshgrid(np.arange(k), np.arange(dim), indexing="ij")
        whole = pa.array([Decimal(int(t)) for t in total.ravel()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), whole, pa.array(np.repeat(n, dim))], names=["c", "j", "total", "n"])

    parts = kept.select("v").mapInArrow(sums, "c int, j int, total decimal(38,0), n long")
    out = centroids.copy()
    for r in parts.groupBy("c", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0").collect():  # k * dim rows
        out[r["c"], r["j"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `dim` components, none null or non-finite; components become
    floor(scale * x). Centroids start as the k kept vectors of the smallest sha256 of
    '1:<vec_id>'. Each round assigns every vector to its nearest centroid (ties to the
    smaller number) and moves each centroid to the floor of its vectors' mean; then
    vectors are assigned once more. All arithmetic is exact.

    Rows of a repeated vec_id each count (as first centroids, by their components); rows
    without a vec_id are clustered and start a centroid only if too few others are there.
    With fewer than k vectors there are fewer centroids; an empty table gives no rows. A
    vector with a component that does not fit a long once scaled takes no part; a distance
    or sum that does not fit a long is null. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, key, vector, dim, scale)
    centroids = first_centroids(kept, k, dim, scale)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(kept, centroids, scale)

    def assign(batches):
        for b in batches:
            at, d = nearest_centroids(integers(b.column("v"), dim, scale), centroids) if b.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            d = pa.array([int(x) if x < 1 << 63 else None for x in d], pa.int64()) if d.dtype == object else pa.array(d)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at.astype(np.int32)), d], names=["vec_id", "cluster", "distance"])

    found = written(kept.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    unknown = F.count_if(F.col("distance").isNull())
    sums = {r["cluster"]: r for r in found.groupBy("cluster").agg(whole.alias("s"), unknown.alias("u")).collect()}  # k rows

    def fits(s, bad):
        return int(s) if not bad and s < 1 << 63 else None

    each = [fits(sums[c]["s"], sums[c]["u"]) if c in sums else 0 for c in range(len(centroids))]
    total = fits(sum(r["s"] for r in sums.values()), sum(r["u"] for r in sums.values())) if all(r["s"] is not None for r in sums.values()) else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(F.array(*[F.lit(x).cast("long") for x in each]), F.col("cluster") + 1).alias("cluster_inertia"),
        F.lit(total).cast("long").alias("inertia"),
        F.element_at(F.array(*map(F.lit, digest)), F.col("cluster") + 1).alias("centroid_sha256"),
    )
