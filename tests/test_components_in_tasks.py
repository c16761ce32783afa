"""What components of a bounded size need is done in tasks."""

import random

from pyspark.sql import functions as F

from geoweave.operators import forest
from geoweave.operators import graph_algorithms as GA
from geoweave.operators.graph import Graph
from geoweave.operators.storage import cut


def _graph(spark, seed):
    rng, edges = random.Random(seed), []
    for first, n, m in ((0, 12, 22), (100, 9, 8), (200, 2, 2)):
        edges += [(first + a, first + b, rng.choice([None, float("nan"), -1.0, 0.0, 2.0])) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m))]
    nodes = spark.createDataFrame([(i,) for i in (*range(15), 500, 501)], "id long")
    return Graph.of_edges(spark.createDataFrame(edges, "src long, dst long, w double"), nodes=nodes, keep_multi=True)


def test_walks_of_small_components_need_no_rounds(spark, monkeypatch):
    g = _graph(spark, 7)
    g = Graph(cut(g.nodes), cut(g.edges))
    rows = lambda most: sorted(tuple(r) for r in forest.depth_first(g, F.col("w"), most).select("id", "root", F.coalesce("parent", F.lit(-1)), "depth", "entry", "exit").collect())
    want = rows(9)  # the first component by the cluster, the others in tasks
    monkeypatch.setattr(forest, "number_cycles", lambda links: 1 / 0)
    assert rows(1000) == want and len(want) == g.nodes.count()


def test_edges_are_tied_in_tasks_before_rounds(spark, monkeypatch):
    rng, n = random.Random(3), 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000)]
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    g = Graph.of_edges(spark.createDataFrame(edges * 3, "src long, dst long"), keep_multi=True)
    got = lambda: {(r.id, r.component) for r in GA.connected_components(g).collect()}
    monkeypatch.setattr(GA, "SLICE_EDGES", 50)
    assert got() == set(label.items())
    one = Graph(g.nodes, g.edges.coalesce(1))
    monkeypatch.setattr(GA, "SLICE_EDGES", 1 << 20)
    monkeypatch.setattr(GA, "_tie_greater", lambda pairs: 1 / 0)
    assert {(r.id, r.component) for r in GA.connected_components(one).collect()} == set(label.items())
