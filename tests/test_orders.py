"""Nearest points by leaves, order statistics, folds and depth-first orders against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.operators import forest, nearest, ordered, spatial_join
from geoweave.operators.graph import Graph


def brute(asks, points, k, near=0.0):
    out = []
    for q, x, y in asks:
        d = sorted((float(np.sqrt((x - a) ** 2 + (y - b) ** 2)), i) for i, a, b in points if not ((abs(x - a) < near and abs(y - b) < near) or (x == a and y == b)))
        out += [(q, i, round(v, 9), r + 1) for r, (v, i) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("k, leaf, near", [(3, 8, 0.0), (1, 5, 0.5), (40, 16, 0.0)])
def test_nearest_by_leaves_equals_brute_force(spark, k, leaf, near):
    own = np.random.default_rng(k)
    clump = own.normal(50, 0.01, (150, 2)).round(4)
    even = own.integers(0, 100, (200, 2)).astype(float)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate((clump, even, even[:9])))]
    asks = points[::7] + [(900, -500.0, 3.0), (901, 50.0, 50.0)]
    p, q = spark.createDataFrame(points, "id long, x double, y double").repartition(3), spark.createDataFrame([*asks, (902, None, 1.0)], "qid long, x double, y double")
    got = sorted((r.qid, r.id, round(r.distance, 9), r["rank"]) for r in nearest.nearest(q, p, k, near, leaf).collect())
    assert got == brute(asks, points, k, near)
    assert nearest.nearest(q, p.limit(0), k).count() == 0 and nearest.nearest(q.limit(0), p, k).count() == 0


def test_asks_of_a_leaf_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ASKS", 10)
    points = [(i, float(i % 20), float(i // 20)) for i in range(100)]
    asks = [(i, 0.5 + (i % 7) / 10, 0.25 + i / 1000) for i in range(200)]
    got = nearest.nearest(spark.createDataFrame(asks, "qid long, x double, y double"), spark.createDataFrame(points, "id long, x double, y double"), 2, leaf=30)
    assert sorted((r.qid, r.id, round(r.distance, 9), r["rank"]) for r in got.collect()) == brute(asks, points, 2)


def test_leaves_are_as_full_in_clumps_as_elsewhere():
    own = np.random.default_rng(1)
    points = np.concatenate((own.normal(0, 1e-6, (20_000, 2)), own.uniform(-1, 1, (20_000, 2))))
    tree = nearest.Tree.of_sample(points[own.permutation(len(points))[: 32 * 64]], 64)
    sizes = np.bincount(tree.leaf_of(points[:, 0], points[:, 1]))
    assert sizes.max() < 4 * 40_000 / 64 and (sizes > 0).sum() >= 60


def test_order_statistics(spark):
    values = [5, 1, 1, 9, 3, 3, 3, 8, None, 2]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(3)
    plan = ordered.order_statistics(df, "v", [0.5, 0.75, 1.0])
    assert tuple(plan.first()) == (3, 3, 9)  # the 4th, 6th and 9th of 1 1 2 3 3 3 5 8 9
    assert tuple(ordered.order_statistics(df.limit(0), "v", [0.5]).first()) == (None,)


@pytest.mark.parametrize("fan_in", [2, 5, 64])
def test_folds_keep_the_order(spark, fan_in):
    rows = [(g, i, f"{i} ") for g, n in (("a", 130), ("b", 1), ("c", 3)) for i in range(n)] + [(None, 1, "x")]
    df = spark.createDataFrame(rows, "g string, o int, v string").orderBy(F.rand(3)).repartition(3)
    got = {r.g: r.v for r in ordered.fold_in_order(df, "g", "o", "v", lambda a, b: F.concat(a, b), fan_in).collect()}
    assert got == {"a": "".join(f"{i} " for i in range(130)), "b": "0 ", "c": "0 1 2 ", None: "x"}


def walk_by_hand(edges, nodes):
    tree, up = {n: [] for n in nodes}, {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in sorted({(min(e), max(e)) for e in edges if e[0] != e[1]}):
        if find(a) != find(b):
            up[find(a)] = find(b)
            tree[a].append(b)
            tree[b].append(a)
    out = {}
    for root in sorted(nodes):
        if root in out:
            continue
        entries = exits = 0
        stack = [(root, None, 0, False)]
        while stack:
            n, p, depth, leaving = stack.pop()
            if leaving:
                out[n] += (exits,)
                exits += 1
                continue
            out[n] = (root, p, depth, entries)
            entries += 1
            stack.append((n, p, depth, True))
            stack += [(c, n, depth + 1, False) for c in sorted(tree[n], reverse=True) if c != p]
    return out


def test_depth_first_order_of_forests(spark):
    own = np.random.default_rng(2)
    edges = [tuple(int(v) for v in own.integers(0, 60, 2)) for _ in range(55)] + [(100, 101), (101, 102), (7, 7)]
    g = Graph.of_edges(spark.createDataFrame(edges, "src long, dst long"), nodes=spark.createDataFrame([(i,) for i in [*range(60), 100, 101, 102, 500]], "id long"))
    got = {r.id: (r.root, r.parent, r.depth, r.entry, r.exit) for r in forest.depth_first(g).collect()}
    assert got == walk_by_hand(edges, [*range(60), 100, 101, 102, 500])


def test_a_long_chain_is_walked_in_few_rounds(spark):
    n = 2000
    g = Graph.of_edges(spark.range(n - 1).selectExpr("(id * 7) % 2000 AS src", "((id + 1) * 7) % 2000 AS dst"))
    got = {r.id: r for r in forest.depth_first(g).collect()}
    assert len(got) == n and sorted(r.entry for r in got.values()) == list(range(n)) and sorted(r.exit for r in got.values()) == list(range(n))
    assert sum(r.depth == 0 for r in got.values()) == 1 and all(r.parent is None or got[r.parent].entry < r.entry and got[r.parent].exit > r.exit for r in got.values())
