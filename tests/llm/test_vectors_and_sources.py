"""Centroid clustering, grid order join and source divergence against brute force, and on odd inputs."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from stationwise.llm import grid_order_join, level_products, threshold_centroids

VECTORS = "vec_id long, embedding array<double>, cluster string"
ODD = [(900, None), (901, []), (902, [1.0]), (903, [0.0] * 64), (904, [float("nan")] + [0.0] * 63), (905, [None] * 64), (906, [float("inf")] * 64)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_clusters(data, k=16, rounds=3):
    """The contract with Python integers: {row: (vec_id, cluster, distance, cluster inertia, inertia, digest)} in order of data."""
    kept = [(i, [floor(64 * Fraction(x)) for x in v]) for i, v in data if v is not None and len(v) == 64 and all(x is not None and abs(x) < float("inf") for x in v)]
    named = sorted((r for r in kept if r[0] is not None), key=lambda r: (sha(f"1:{r[0]}"), r[1]))
    centroids = [v for _, v in (named + sorted((r for r in kept if r[0] is None), key=lambda r: r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        centroids = [[sum(col) // len(col) for col in zip(*(v for (_, v), a in zip(kept, at) if a == n))] if n in at else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, fit(d), fit(inertia[c]), fit(sum(inertia.values())), sha(",".join(map(str, centroids[c])))) for i, c, d in found), key=str)


@pytest.mark.parametrize("scale", [1.0, 0.02, 1e13])
def test_threshold_algorithm_equals_brute_force(spark, monkeypatch, scale):
    """Also with many equal distances, and with components whose squares need more than 64 bits."""
    monkeypatch.setattr(threshold_centroids, "BATCH", 37)
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(5, 64))[rng.integers(0, 5, 150)] + 0.3 * rng.normal(size=(150, 64))) * scale
    v[40:60] = v[40]
    data = [(i, x.tolist()) for i, x in enumerate(v)] + ODD + [(7, v[3].tolist()), (None, v[4].tolist()), (7, v[3].tolist())]
    frame = spark.createDataFrame([(*r, "clash") for r in data], VECTORS)
    got = sorted((tuple(r) for r in threshold_centroids.cluster(frame).collect()), key=str)
    assert got == plain_clusters(data)


def test_walk_ends_before_all_lists_are_read():
    """A centroid beyond the frontier is never compared, and the nearest one is right; ties go to the smaller number."""
    rng = np.random.default_rng(1)
    centroids = rng.integers(-900, 900, (40, 3))
    centroids[7] = centroids[31]
    x = rng.integers(-900, 900, (500, 3))
    pairs = []
    real = threshold_centroids.exact_distance
    try:
        threshold_centroids.exact_distance = lambda a, b: pairs.append(len(a)) or real(a, b)
        number, best = threshold_centroids.nearest_centroids(x, centroids)
    finally:
        threshold_centroids.exact_distance = real
    d = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (number == d.argmin(1)).all() and (best == d.min(1)).all()
    assert sum(pairs) < 0.6 * d.size


def test_few_and_no_vectors_to_cluster(spark):
    few = [(3, [0.5] * 64), (4, [0.25] * 64), (None, [0.5] * 64)]
    frame = spark.createDataFrame([(*r, "") for r in few + ODD], VECTORS)
    assert sorted((tuple(r) for r in threshold_centroids.cluster(frame).collect()), key=str) == plain_clusters(few + ODD)
    assert threshold_centroids.cluster(frame.filter("vec_id > 899")).count() == 0 + sum(v is not None and v == [0.0] * 64 for _, v in ODD)
    assert threshold_centroids.cluster(frame.limit(0)).count() == 0


def plain_links(data, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in data]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max() if o else None for (_, v), o in zip(data, ok)]
    n = len(data)
    near = [[i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [data[j][0] for j in seen if data[j][0] is not None]
        root = min(ids) if ids else None
        out.append((data[i][0], sum(near[i]), root, data[i][0] == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_grid_order_join_equals_brute_force(spark, monkeypatch, kind):
    for name, size in (("BLOCK", 24), ("LEAF", 7), ("PARTNERS", 2), ("FAN", 1)):
        monkeypatch.setattr(grid_order_join, name, size)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(30, 12)) * [6, 4, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1]
    v = (base[rng.integers(0, 30, 260)] + 0.35 * rng.normal(size=(260, 12))).astype(np.float32 if kind == "float" else float)
    v[100:150] = v[100]
    v[150:190] = v[100] * np.linspace(0.1, 9, 40)[:, None].astype(v.dtype)
    data = [(i, x.tolist()) for i, x in enumerate(v)] + ODD[:3] + [(i, x[:12] if x else x) for i, x in ODD[3:]]
    data += [(1000 + i, x[:5].tolist()) for i, x in enumerate(v[:20])] + [(5, v[5].tolist()), (5, v[9].tolist()), (None, v[100].tolist()), (None, None)]
    data += [(2000, [1e30] * 12 if kind == "float" else [1e300] * 12), (2001, [1e-30] * 12 if kind == "float" else [1e-300] * 12)]
    frame = spark.createDataFrame([(*r, 1) for r in data], f"vec_id long, embedding array<{kind}>, n_links int")
    got = sorted((tuple(r) for r in grid_order_join.near_duplicates(frame).collect()), key=str)
    want = plain_links(data)
    assert got == want
    assert max(r[1] for r in got) > 90 and len({r[2] for r in got}) > 20


def test_distant_intervals_are_skipped(spark, monkeypatch):
    """Far clusters: few of all pairs of intervals come to a product."""
    monkeypatch.setattr(grid_order_join, "LEAF", 16)
    rng = np.random.default_rng(2)
    x = np.repeat(np.eye(8), 64, axis=0) + 0.02 * rng.normal(size=(512, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = grid_order_join.coordinates(x, np.eye(8))
    side = {"node": np.arange(512), "held": np.ones(512, np.int64), "x": x, "y": y}
    found = grid_order_join.leaf_join(side, None, 0.95, 0.1)
    assert len(found) / 2 == 8 * 10  # of 32 * 33 / 2 pairs
    degree = np.zeros(512, np.int64)
    for node, _, links in found:
        np.add.at(degree, node, links)
    assert (degree == ((x @ x.T) >= 0.95).sum(1) - 1).all()


def test_no_vectors_to_join(spark):
    frame = spark.createDataFrame([(*r, 1) for r in ODD], "vec_id long, embedding array<double>, n_links int")
    assert sorted(map(tuple, grid_order_join.near_duplicates(frame.filter("vec_id != 902")).collect())) == [(i, 0, i, True) for i, _ in ODD if i != 902]
    assert grid_order_join.near_duplicates(frame.limit(0)).count() == 0


def plain_audit(rows, least=3, ranks=200):
    words = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, l, s in rows]
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in words:
        docs[lang].update(set(w))
        groups[lang, source].update(w)
    out = []
    for (lang, source), _ in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = {s: c for (g, s), c in groups.items() if g == lang}

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, whole = share(sources[source]), share(sum(sources.values(), Counter()))
        pair = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), s) for s, c in sources.items() if s != source for q in [share(c)]]
        term = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if sources[source][t] and p[t] > whole[t]]
        for part, found in (("pair", pair), ("term", term)):
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, r) for r, (value, item) in enumerate(found[: ranks if part == "term" else None], 1)]
    return sorted(out)


def test_level_products_equal_brute_force(spark, monkeypatch):
    for name, size in (("RARE_TERMS", 5), ("OTHER_TERMS", 3), ("RARE", 3), ("BLOCK_SOURCES", 2), ("HELD_TERMS", 20)):
        monkeypatch.setattr(level_products, name, size)
    rng = np.random.default_rng(4)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Ünï", "日本", "é", "_x9y", "A", "a"]
    rows = [(" ".join(vocabulary[int(i)] for i in np.minimum(65, rng.geometric(0.08, int(rng.integers(0, 60))) - 1)), ["en", "de"][int(rng.integers(2))], f"s{rng.integers(5)}") for _ in range(160)]
    rows += [(None, "en", "empty"), ("", "en", "s1"), ("a a A", None, None), ("a", None, "x"), ("a\x1cb c", None, "x"), ("rare", "fr", "one"), ("rare rare", "fr", "two"), ("1 2 [", "es", None)]
    rows += [rows[0]] * 3 + [("long tail " * 30_000, "en", "s2")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, value int")
    assert sorted(map(tuple, level_products.audit(frame, ranks=9).collect())) == plain_audit(rows, ranks=9)
    assert level_products.audit(frame.limit(0)).count() == 0


def test_counts_beyond_64_bits_are_priced_exactly():
    """10^9 times such a count does not fit a long."""
    counts = np.array([[20 * 10**9, 3], [0, 5]], np.int64)
    totals = np.array([20 * 10**9, 8], object)
    p = [[1 + 10**9 * (int(c) + 1) // (int(t) + 4) for c, t in zip(row, totals)] for row in [*counts, (0, 0), (0, 0)]]
    want = {(0, 1): sum((a - b) ** 2 // b for a, b in p), (1, 0): sum((a - b) ** 2 // a for a, b in p)}
    assert {(int(g), int(h)): int(x) for g, h, x in level_products.joint_prices(counts, 4, totals, 4, np.array([0, 1]), np.array([0, 1]))} == want
    assert {(int(g), int(h)): int(x) for g, h, x in level_products.joint_prices(counts, 4, totals, 4, np.array([0]), np.array([1]))} == want
