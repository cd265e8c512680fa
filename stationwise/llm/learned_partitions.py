"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Vectors that partitions and router are learned on at most (those of the smallest hashes).
SAMPLE = 4096
#: Neighbours of a vector in the graph that is partitioned.
GRAPH_NEIGHBOURS = 10
#: Share of the sample that is not learned on, but tells how many partitions to search.
CHECKED = 0.2
#: Share of true neighbours that the searched partitions must hold on that share.
AIM = 0.92
#: Vectors of a partition that are searched together; larger partitions are dealt out.
BLOCK = 4096
#: A partition may exceed its fair share of the sample by this factor.
SLACK = 1.1
ROUTED = ["part", "ask", "vec_id", "asked", "v"]


@dataclass
class Router:
    """One hidden layer: chances that a vector's neighbours are in each partition.

    A query searches the likeliest partitions until their chances add up to `mass`, and at
    most `probes` of them.
    """

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int
    mass: float = 1.0

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def best(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.chances(x), axis=1, kind="stable")[:, :n]

    def searched(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Partitions in the order of their chances, and how many of them each vector searches."""
        chances = self.chances(x)
        order = np.argsort(-chances, axis=1, kind="stable")
        below = np.cumsum(np.take_along_axis(chances, order, axis=1), axis=1) < self.mass
        return order, np.minimum(below.sum(axis=1) + 1, min(self.probes, order.shape[1]))


def nearest(x: np.ndarray, y: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Indices in y of the k largest inner products of each row of x; its own index left out if x is y."""
    out = []
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ y.T
        if own:
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out.append(np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 10) -> np.ndarray:
    """Partition of a neighbour graph: median cuts along principal directions, then moves that cut fewer edges within the slack."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        part[rows] = first
        if n > 1 and len(rows) > 1:
            c = x[rows] - x[rows].mean(0)
            direction = np.linalg.eigh(c.T @ c)[1][:, -1]
            order = rows[np.argsort(c @ direction, kind="stable")]
            left = n // 2
            at = len(rows) * left // n
            todo += [(order[:at], first, left), (order[at:], first + left, n - left)]
    size = np.bincount(part, minlength=parts)
    most = int(np.ceil(SLACK * len(x) / parts))
    back: list[list[int]] = [[] for _ in range(len(x))]
    for a, row in enumerate(graph):
        for b in row.tolist():
            back[b].append(a)
    near = [np.array([*row.tolist(), *back[a]], np.int64) for a, row in enumerate(graph)]
    for _ in range(rounds):
        moved = 0
        for a in range(len(x)):
            votes = np.bincount(part[near[a]], minlength=parts)
            votes[(size >= most) & (np.arange(parts) != part[a])] = -1
            to = int(votes.argmax())
            if votes[to] > votes[part[a]]:
                size[part[a]] -= 1
                size[to] += 1
                part[a] = to
                moved += 1
        if not moved:
            break
    return part


def learn(x: np.ndarray, parts: int, k: int, seed: int = 7) -> Router:
    """Partitions and router of a sample, and how many partitions to search."""
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    checked = int(CHECKED * len(x))
    held, x = x[:checked], x[checked:]
    scale = 1 / max(1e-12, float(np.sqrt((x**2).mean())))
    dim, hidden = x.shape[1], 128
    graph = nearest(x, x, min(GRAPH_NEIGHBOURS, len(x) - 1), True) if len(x) > 1 else np.zeros((len(x), 0), np.int64)
    part = balanced_parts(x, graph, parts)
    target = np.eye(parts)[part]
    if graph.shape[1]:
        target = 0.3 * target + 0.7 * np.eye(parts)[part[graph]].mean(1)
    weights = [rng.normal(0, np.sqrt(2 / dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(40):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            rows = order[i : i + 128]
            v = x[rows] * scale
            h = np.maximum(v @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ weights[2].T) * (h > 0)
            step += 1
            for w, g, m, s in zip(weights, (v.T @ dh, dh.sum(0), h.T @ d, d.sum(0)), first, second):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    router = Router(scale, *weights, parts)
    if checked and len(x) > k:
        true = nearest(held, x, k, False)
        home = router.best(x, 1)[:, 0]
        order = router.best(held, parts)
        place = np.argsort(order, axis=1)  # of each partition in the order of search
        found = np.take_along_axis(place, home[true], axis=1)
        before = np.cumsum(np.take_along_axis(router.chances(held), order, axis=1), axis=1)
        least = parts
        for mass in [*np.linspace(0.5, 0.995, 100), 1.0]:  # of all pairs that reach AIM, the one that searches least
            n = np.minimum((before < mass).sum(axis=1) + 1, parts)
            most = next((m for m in range(1, parts + 1) if (found < np.minimum(n, m)[:, None]).mean() >= AIM), None)
            if most and np.minimum(n, most).mean() < least:
                least, router.probes, router.mass = np.minimum(n, most).mean(), most, float(mass)
    return router


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and v (double) of the vectors that take part: not null, not zero, all components finite, of the most common length."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    out = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    sizes = out.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return out.filter(F.size("v") == (sizes["dim"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", partitions: int | None = None) -> DataFrame:
    """Near neighbours by inner product: query_id, rank (from 1), vec_id, score (double).

    Queries are the vectors whose key is divisible by `every`; candidates all but the
    query's own key. Partitions and router are learned on at most SAMPLE vectors; all
    vectors are indexed, each in the partition that the router finds likeliest, and each
    query searches its likeliest partitions until their chances add up to a mass, and at most
    a number of them; both are the cheapest that hold AIM of the true neighbours of a part of
    the sample that was not learned on. Where those hold fewer than k others, it searches all. Scores are exact, summed alike for equal vectors; ties
    go to the smaller key. Fewer candidates than k give fewer rows.

    Vectors that are null, zero, of another length than most, or hold null or non-finite
    components take no part. Rows of one key with several vectors count each; as queries, each
    distinct vector of a key is asked once and has its own ranks. Extra columns
    are ignored; an empty table gives no rows.
    """
    indexed = usable(vectors, key, vector)
    n = indexed.count()
    sample = indexed.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toPandas()["v"].tolist()
    x = np.array(sample, float).reshape(len(sample), len(sample[0]) if sample else 0)
    parts = partitions or int(np.clip(round(np.sqrt(n) / 3), 1, SAMPLE // 16))
    parts = max(1, min(parts, len(x) // 16))
    router = learn(x, parts, k) if parts > 1 else None

    def home(batches):
        """A row for the home of each vector (ask 0)."""
        for b in batches:
            if b.num_rows:
                part = router.best(_matrix(b.column("v")), 1)[:, 0] if router else np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.zeros(b.num_rows, np.int32)), b.column("vec_id"), pa.nulls(b.num_rows, pa.int64()), b.column("v")], names=ROUTED)

    schema = "part int, ask int, vec_id long, asked long, v array<double>"
    homes = written(indexed.mapInArrow(home, schema), "homes")
    held_by = np.zeros(max(1, parts), np.int64)
    for r in homes.groupBy("part").count().collect():  # at most 256 rows
        held_by[r["part"]] = r["count"]

    def route(batches):
        """A row for each partition that a query searches (ask 1): the likeliest, or all if those may hold fewer than k others."""
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("v"))
            order, probes = router.searched(m) if router else (np.zeros((len(m), 1), np.int64), np.ones(len(m), np.int64))
            inside = np.arange(order.shape[1])[None, :] < probes[:, None]
            short = np.where(inside, held_by[order], 0).sum(1) - b.column("own").to_numpy() < k
            rows, at = np.nonzero(short[:, None] | inside)
            pick = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(order[rows, at].astype(np.int32)), pa.array(np.ones(len(rows), np.int32)), b.column("vec_id").take(pick), b.column("asked").take(pick), b.column("v").take(pick)], names=ROUTED)

    mine = homes.filter(F.col("vec_id") % every == 0)
    own = mine.groupBy("vec_id").agg(F.count("*").alias("own"))
    asking = mine.select("vec_id", "v").distinct().withColumn("asked", F.monotonically_increasing_id()).join(own, "vec_id")
    asks = written(asking.select("vec_id", "asked", "own", "v").mapInArrow(route, schema), "asks")
    routed = homes.unionByName(asks)
    blocks = homes.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = routed.join(blocks, "part")  # one row per partition
    mine = F.array(F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("ask") == 0, mine).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))).drop("blocks")
    dealt = dealt.repartition("part", "block").sortWithinPartitions("part", "block", "ask")

    def compare(batches):
        now, held, ready = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            kind = np.stack([b.column(c).to_numpy() for c in ("part", "block", "ask")], axis=1)
            cuts = [0, *(np.flatnonzero((kind[1:] != kind[:-1]).any(1)) + 1).tolist(), len(kind)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                place, ask = tuple(kind[lo, :2].tolist()), kind[lo, 2]
                if place != now:
                    now, held, ready = place, [], None
                part = b.slice(lo, hi - lo)
                ids, m = part.column("vec_id").to_numpy(), _matrix(part.column("v"))
                if not ask:
                    held.append((ids, m))
                elif held:
                    ready = ready or (np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
                    yield _top(part.column("asked").to_numpy(), ids, m, *ready, k)

    near = dealt.mapInArrow(compare, "asked long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")).cast("int")
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top(asked: np.ndarray, queries: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest of each query in a block, all ties at the edge considered."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ v.T
        room = 1e-9 * np.abs(s).max(axis=1)
        s[ids[None, :] == queries[i : i + len(s), None]] = -np.inf  # a query's own key, in however many rows, is no candidate
        edge = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] > k else np.full(len(s), -np.inf)
        for r, row in enumerate(s):
            at = np.flatnonzero((row >= edge[r] - room[r]) & (ids != queries[i + r]))
            score = (v[at] * q[i + r]).sum(axis=1)
            best = np.lexsort([ids[at], -score])[:k]
            out[0].append(np.full(len(best), asked[i + r]))
            out[1].append(np.full(len(best), queries[i + r]))
            out[2].append(ids[at][best])
            out[3].append(score[best])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["asked", "query_id", "vec_id", "score"])

