"""Spanning forests and depth-first orders of graphs in rounds that grow with the logarithm of their size.

Components of a bounded size are walked in tasks, many at once; a larger one is walked by the whole cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType

from geoweave.operators.arrangement import number_cycles
from geoweave.operators.graph import Graph, canonical
from geoweave.operators.graph_algorithms import connected_components
from geoweave.operators.storage import cut, release

#: Edges of a component that one task walks.
MOST = 1 << 18


def _pairs(graph: Graph, weight: Column | None) -> DataFrame:
    """(src, dst, w), src < dst: unlike ends, each pair once with its least weight."""
    e = graph.edges.withColumn("w", weight if weight is not None else F.lit(0))
    return e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))


def spanning_forest(graph: Graph, weight: Column | None = None) -> DataFrame:
    """(src, dst), src < dst: the edges of the least spanning forest; edges go by weight, then by their ends. Directions do not matter.

    In each round every part of the forest takes its least edge to another part, and parts that are joined so become one, so parts are
    halved at least. Loops and repeated edges are ignored; a graph without edges has no forest.
    """
    pairs = _pairs(graph, weight)
    left = cut(pairs.select("src", "dst", "w", F.col("src").alias("p"), F.col("dst").alias("q")), "left")
    forest = None
    while not left.isEmpty():
        edge = F.struct("w", "src", "dst", "p", "q")
        sides = left.select(F.col("p").alias("part"), edge.alias("e")).unionByName(left.select(F.col("q").alias("part"), edge.alias("e")))
        chosen = cut(sides.groupBy("part").agg(F.min("e").alias("e")).select("e.*").distinct(), "chosen")
        forest = chosen.select("src", "dst") if forest is None else forest.unionByName(chosen.select("src", "dst"))
        links = chosen.select(F.col("p").alias("src"), F.col("q").alias("dst"))
        parts = cut(connected_components(Graph.of_edges(links)), "parts")
        of = lambda c: parts.select(F.col("id").alias(c), F.col("component").alias(f"{c}2"))  # noqa: E731, B023
        moved = left.join(of("p"), "p").join(of("q"), "q")
        new = cut(moved.where("p2 <> q2").select("src", "dst", "w", F.col("p2").alias("p"), F.col("q2").alias("q")), "left")
        release(left)
        left = new
    return cut(forest if forest is not None else pairs.select("src", "dst").limit(0), "forest")


def rooted(forest: DataFrame) -> DataFrame:
    """(id, parent) of all nodes of a forest but its roots, the least nodes of their trees.

    Each edge is two arcs; an arc goes on to the next neighbour around its end, so a tree's arcs make one cycle. The cycle is numbered
    from its least arc, which leaves the root, and of an edge's two arcs the first one leads away from the root.
    """
    placed = _tour(forest.unionByName(forest.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    back = placed.select(F.struct(F.col("edge.dst").alias("src"), F.col("edge.src").alias("dst")).alias("edge"), F.col("place").alias("back"))
    return cut(placed.join(back, "edge").where("place < back").select(F.col("edge.dst").alias("id"), F.col("edge.src").alias("parent")), "parents")


def _tour(arcs: DataFrame) -> DataFrame:
    around = Window.partitionBy("src").orderBy("dst")
    to = F.coalesce(F.lead("dst").over(around), F.first("dst").over(around))  # the arc src -> to follows dst -> src
    links = arcs.select(F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")).alias("edge"), F.struct("src", to.alias("dst")).alias("next"))
    return number_cycles(links)


def _walk_in_task(t: pa.Table) -> pa.Table:
    """The walk of one component from its edges."""
    w = t["w"].combine_chunks()
    missing = w.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((t["dst"].to_numpy(), t["src"].to_numpy(), w.fill_null(0).to_numpy(zero_copy_only=False), ~missing))  # nulls first, NaN last, as Spark has them
    ids, at = np.unique(np.concatenate((t["src"].to_numpy()[order], t["dst"].to_numpy()[order])), return_inverse=True)
    n, m = len(ids), len(order)
    top, near = list(range(n)), [[] for _ in range(n)]
    for u, v in zip(at[:m].tolist(), at[m:].tolist()):
        a, b = u, v
        while top[a] != a:
            top[a] = a = top[top[a]]
        while top[b] != b:
            top[b] = b = top[top[b]]
        if a != b:
            top[max(a, b)] = min(a, b)
            near[u].append(v)
            near[v].append(u)
    above, depth, entry, leave = [-1] * n, [0] * n, [0] * n, [0] * n
    todo, entered, left = [0], 0, 0
    while todo:
        u = todo.pop()
        if u < 0:
            leave[~u], left = left, left + 1
            continue
        entry[u], entered = entered, entered + 1
        todo.append(~u)
        for v in sorted(near[u], reverse=True):
            if v != above[u]:
                above[v], depth[v] = u, depth[u] + 1
                todo.append(v)
    parents = pa.array(ids[np.array(above)], mask=np.array(above) < 0)
    return pa.table({"id": ids, "root": np.full(n, ids[0]), "parent": parents, "depth": depth, "entry": entry, "exit": leave})


def depth_first(graph: Graph, weight: Column | None = None, most: int = MOST) -> DataFrame:
    """(id, root, parent, depth, entry, exit): a depth-first walk of the least spanning forest from the least node of each tree, lesser children first.

    entry counts the nodes entered before it in its tree, exit those left before it; so a node lies below another if it is entered later and left
    earlier. Components of at most `most` edges are walked in tasks. The walk of larger ones, and of nodes or weights that are no numbers, is a list of
    arcs that is numbered by pointer doubling. So no tree of more than `most` edges is ever in one task. Nodes without edges are trees of their own.
    """
    pairs = _pairs(graph, weight)
    kind = graph.nodes.schema["id"].dataType
    if not (isinstance(kind, IntegralType) and isinstance(pairs.schema["src"].dataType, IntegralType) and isinstance(pairs.schema["w"].dataType, (IntegralType, FloatType, DoubleType))):
        return _by_cluster(graph, weight)
    pairs = cut(pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "w"), "pairs")
    labels = cut(connected_components(Graph.of_edges(pairs.select("src", "dst"))), "labels")
    placed = pairs.join(labels.select(F.col("id").alias("src"), "component"), "src")
    sizes = cut(placed.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") > most).select("component")
    walked = placed.join(large, "component", "left_anti").groupBy("component").applyInArrow(_walk_in_task, "id long, root long, parent long, depth long, entry long, exit long")
    zero = F.lit(0).cast("long")
    alone = graph.nodes.join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("root"), F.lit(None).cast(kind).alias("parent"), zero.alias("depth"), zero.alias("entry"), zero.alias("exit"))
    out = walked.select(*[F.col(c).cast(kind).alias(c) for c in ("id", "root", "parent")], "depth", "entry", "exit").unionByName(alone)
    if large.isEmpty():
        return out
    rest = labels.join(large, "component").select(F.col("id").cast(kind).alias("id"))
    edges = cut(placed.join(large, "component").select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), "w"), "large")
    return out.unionByName(_by_cluster(Graph(rest, edges), F.col("w")))


def _by_cluster(graph: Graph, weight: Column | None) -> DataFrame:
    """The walk as a list of arcs."""
    parents = rooted(spanning_forest(graph, weight))
    # the walk: down to the least child; from the last of its children, or without any, up again
    kids = Window.partitionBy("parent").orderBy("id")
    nodes = parents.select("id", "parent", F.lead("id").over(kids).alias("sibling"))
    first = parents.groupBy(F.col("parent").alias("id")).agg(F.min("id").alias("child"))
    roots = parents.select(F.col("parent").alias("id")).distinct().join(parents.select("id"), "id", "left_anti")
    arc = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    i, p, c, s = (F.col(x) for x in ("id", "parent", "child", "sibling"))
    known = nodes.join(first, "id", "left")
    down = known.select(arc(p, i).alias("edge"), F.when(c.isNotNull(), arc(i, c)).otherwise(arc(i, p)).alias("next"))
    above = parents.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
    tops = roots.join(first, "id").select(F.col("id").alias("parent"), F.col("child").alias("start"))
    up = nodes.join(above, "parent", "left").join(tops, "parent", "left").select(arc(i, p).alias("edge"), F.when(s.isNotNull(), arc(p, s)).when(F.col("above").isNotNull(), arc(p, F.col("above"))).otherwise(arc(p, F.col("start"))).alias("next"))
    placed = number_cycles(down.unionByName(up))
    of_edge = placed.select(F.col("edge.src").alias("a"), F.col("edge.dst").alias("b"), F.col("ring.src").alias("root"), "place")
    entered = of_edge.join(parents.select(F.col("id").alias("b"), F.col("parent").alias("a")), ["a", "b"]).select(F.col("b").alias("id"), F.col("a").alias("parent"), "root", F.col("place").alias("down"))
    left = of_edge.join(parents.select(F.col("id").alias("a"), F.col("parent").alias("b")), ["a", "b"]).select(F.col("a").alias("id"), F.col("place").alias("up"))
    # of the arcs before a node's downward one, depth - 1 more lead down than up; of those before its upward one, its own and its ancestors' more
    both = entered.join(left, "id").join(_depths(parents), "id")
    size = F.expr("(up - down + 1) div 2")
    entry = F.expr("(down + depth - 1) div 2 + 1")
    below = both.select("id", "root", "parent", "depth", entry.alias("entry"), (entry + size - 1 - F.col("depth")).alias("exit"))
    sizes = below.groupBy(F.col("root").alias("id")).agg((F.count("*")).alias("exit"))
    tops = graph.nodes.select("id").join(parents.select("id"), "id", "left_anti").join(sizes, "id", "left")
    zero = F.lit(0).cast("long")
    tops = tops.select("id", F.col("id").alias("root"), F.lit(None).cast(graph.nodes.schema["id"].dataType).alias("parent"), zero.alias("depth"), zero.alias("entry"), F.coalesce("exit", zero).alias("exit"))
    return below.unionByName(tops)


def _depths(parents: DataFrame) -> DataFrame:
    """(id, depth) by pointer doubling: how many steps it is to the root."""
    state = cut(parents.select("id", F.col("parent").alias("to"), F.lit(1).cast("long").alias("depth")), "depths")
    while True:
        far = state.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("depth").alias("more"))
        joined = state.join(far, "to", "left")
        new = cut(joined.select("id", F.coalesce("to2", "to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("to2").isNotNull().alias("moved")), "depths")
        release(state)
        state = new
        if new.where("moved").isEmpty():
            return new.select("id", "depth")
