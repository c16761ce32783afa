"""Insertion of many edges into an acyclic graph, as if one by one in their order: an edge that would close a cycle is left out.

Edges that lie on no cycle of all edges together are taken at once: rounds peel off edges from nodes that nothing leads to, and into nodes that
lead nowhere. What is left falls into components, which cannot influence each other. Components of a bounded size are decided in tasks,
edge by edge, where a topological order limits each search to the nodes between the edge's ends. A larger one is decided by the whole cluster: the longest
part of its edges, in their order, that has no cycle is found by halving and taken, the edge after it is left out, and so on. Which edges are left out is by nature
decided in order, so such a component takes as many rounds as it loses edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.operators.graph import Graph
from geoweave.operators.graph_algorithms import connected_components
from geoweave.operators.storage import cut, release

#: Edges of a component that one task decides, and rounds of peeling before components are looked for.
MOST, PEELS = 1 << 18, 8


class Order:
    """A graph that stays acyclic: an edge is refused if it would close a cycle. Nodes have places in a topological order, which are
    moved only between the ends of an edge that runs against them."""

    def __init__(self):
        self.place: dict[int, int] = {}
        self.out: dict[int, set[int]] = {}
        self.into: dict[int, set[int]] = {}

    def _know(self, n: int) -> None:
        if n not in self.place:
            self.place[n] = len(self.place)
            self.out[n], self.into[n] = set(), set()

    def _walk(self, start: int, ways: dict[int, set[int]], low: int, high: int) -> list[int]:
        """Nodes that can be reached with places from low to high."""
        seen, todo = {start}, [start]
        while todo:
            for m in ways[todo.pop()]:
                if m not in seen and low <= self.place[m] <= high:
                    seen.add(m)
                    todo.append(m)
        return sorted(seen, key=self.place.__getitem__)

    def add(self, src: int, dst: int) -> bool:
        if src == dst:
            return False
        self._know(src), self._know(dst)
        low, high = self.place[dst], self.place[src]
        if low < high:
            after = self._walk(dst, self.out, low, high)
            if after[-1] == src:
                return False
            moved = self._walk(src, self.into, low, high) + after
            for n, p in zip(moved, sorted(self.place[n] for n in moved)):
                self.place[n] = p
        self.out[src].add(dst)
        self.into[dst].add(src)
        return True


def _in_task(t: pa.Table) -> pa.Table:
    by = np.argsort(t["step"].to_numpy(), kind="stable")
    src, dst = t["src"].to_numpy()[by].tolist(), t["dst"].to_numpy()[by].tolist()
    order = Order()
    taken = [order.add(s, d) for s, d in zip(src, dst)]
    return pa.Table.from_arrays([pa.array(t["step"].to_numpy()[by]), pa.array(taken)], names=["step", "taken"])


def _peel(edges: DataFrame, rounds: int | None) -> DataFrame:
    """The edges without those on no cycle, as far as `rounds` of peeling find them; None: all that lead to or from no cycle."""
    n = edges.count()
    while n and rounds != 0:
        new = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns), "peeled")
        m = new.count()
        release(edges)
        edges, rounds = new, None if rounds is None else rounds - 1
        if m == n:
            break
        n = m
    return edges


def _acyclic(edges: DataFrame) -> bool:
    return _peel(cut(edges, "tried"), None).isEmpty()


def _by_cluster(edges: DataFrame) -> DataFrame:
    """Steps of a component's edges that are left out."""
    spark, lost, start = edges.sparkSession, [], None
    refused = lambda: spark.createDataFrame([(x,) for x in lost], "step long")
    while True:
        left = cut(edges.join(F.broadcast(refused()), "step", "left_anti"), "left") if lost else edges  # as many as the rounds so far
        if _acyclic(left):
            return refused()
        low, high = start, left.agg(F.max("step")).first()[0]  # acyclic up to low, not up to high
        while True:
            middle = left.where(F.col("step") <= high).where(F.lit(True) if low is None else F.col("step") > low).agg(F.percentile_approx("step", 0.5, 100_000)).first()[0]
            if _acyclic(left.where(F.col("step") <= middle)):
                low = middle
            else:
                high = middle
            first = left.where(F.col("step") > low).agg(F.min("step")).first()[0] if low is not None else left.agg(F.min("step")).first()[0]
            if first == high:
                break
        lost.append(high)
        start = low


def insert_in_order(edges: DataFrame, most: int = MOST, peels: int = PEELS) -> DataFrame:
    """(step, src, dst, taken) of edges (step, src, dst): what becomes of them if they are inserted in the order of their steps.

    Steps are unlike longs, nodes are longs. Loops are left out, an edge that is there already is taken again; rows with nulls are
    left out of the graph (taken is false); no edges give no rows. Existing edges are those with the least steps.
    """
    given = cut(edges.select(F.col("step").cast("long").alias("step"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), "edges")
    good = given.where("src <> dst")
    rest = _peel(cut(good, "rest"), peels)
    labels = connected_components(Graph.of_edges(rest.select("src", "dst")))
    placed = cut(rest.join(labels.select(F.col("id").alias("src"), "component"), "src"), "placed")
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    small = placed.join(sizes.where(F.col("n") <= most), "component").groupBy("component").applyInArrow(_in_task, "step long, taken boolean")
    lost = small.where("not taken").select("step")
    for row in sizes.where(F.col("n") > most).collect():  # all edges by `most` at most
        lost = lost.unionByName(_by_cluster(cut(placed.where(F.col("component") == row.component).select("step", "src", "dst"), "large")))
    lost = lost.withColumn("lost", F.lit(True))
    return given.join(lost, "step", "left").select("step", "src", "dst", (F.coalesce(F.col("src") != F.col("dst"), F.lit(False)) & F.col("lost").isNull()).alias("taken"))
