"""Batched insertion into acyclic graphs against insertion one by one."""

import numpy as np
import pytest

from geoweave.operators import acyclic
from geoweave.operators import graph_algorithms as GA
from geoweave.operators.graph import Graph


def one_by_one(edges):
    out, taken = {}, []
    for _, s, d in edges:
        seen, todo = {d}, [d]
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        ok = s is not None and d is not None and s != d and s not in seen
        if ok:
            out.setdefault(s, set()).add(d)
        taken.append(ok)
    return taken


def random_edges(seed, nodes, n):
    own = np.random.default_rng(seed)
    return [(10 * i, int(own.integers(0, nodes)), int(own.integers(0, nodes))) for i in range(n)]


@pytest.mark.parametrize("nodes, n", [(3, 20), (12, 60), (40, 60), (200, 900)])
def test_the_order_refuses_what_closes_cycles(nodes, n):
    edges = random_edges(nodes, nodes, n)
    order = acyclic.Order()
    assert [order.add(s, d) for _, s, d in edges] == one_by_one(edges)


@pytest.mark.parametrize("most", [acyclic.MOST, 6])
def test_batches_equal_single_insertions(spark, most):
    edges = random_edges(1, 7, 9) if most < 10 else random_edges(2, 60, 150)
    edges = sorted([*edges, (5, 100, 101), (15, 101, 102), (25, 102, 100), (26, 100, 101), (27, 102, 102), (35, 300, 301), (45, 301, 300), (46, 400, 401), (47, None, 3)])
    df = spark.createDataFrame(edges, "step long, src long, dst long").repartition(3)
    got = {r.step: r.taken for r in acyclic.insert_in_order(df, most=most).collect()}
    assert [got[s] for s, _, _ in edges] == one_by_one(edges)
    assert acyclic.insert_in_order(df.limit(0)).count() == 0


def test_edges_are_added_to_a_graph(spark):
    g = Graph.of_edges(spark.createDataFrame([(1, 2)], "src long, dst long"), directed=True)
    g, taken = GA.add_acyclic(g, [(2, 3), (3, 1), (4, 4), (3, 4), (4, 1), (2, 3)])
    assert taken == [True, False, False, True, False, True] and sorted((r.src, r.dst) for r in g.edges.collect()) == [(1, 2), (2, 3), (3, 4)]
