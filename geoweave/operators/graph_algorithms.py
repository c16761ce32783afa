"""Components, paths, cycle checks and contraction of graphs, as loops over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.functions.constants import ID_MODULUS
from geoweave.operators.graph import Graph, canonical
from geoweave.operators.storage import cut
from geoweave.operators.ties import tie_slices

#: Edges that a task ties together at once.
SLICE_EDGES = 1 << 20


def connected_components(graph: Graph, predicate: Callable[[Column, Column], Column] | Column | None = None, max_rounds: int = 100) -> DataFrame:
    """(id, component): the least node id that can be reached over edges that pass the predicate.

    Edges are rewired in rounds of two steps: each node's greater neighbours are tied to its least neighbour,
    then its lesser ones are. Stars are left after a number of rounds that grows with the logarithm of the
    size. Directions do not matter. Minima are combined before the shuffle. Ids that are longs are first tied in the tasks that have
    their edges, slice by slice, so that about a row a node of each slice goes on; if one slice had them all, no round is needed.
    """
    e = graph.edges if predicate is None else graph.edges.where(predicate)
    pairs, whole = canonical(e.select("src", "dst")).where("src <> dst"), False
    if {t for _, t in pairs.dtypes} == {"bigint"}:
        tied = cut(pairs.select(F.col("dst").alias("u"), F.col("src").alias("v")).mapInArrow(tie_slices(SLICE_EDGES), "u long, v long, slice long"), "tied")
        pairs = tied.select(F.col("v").alias("src"), F.col("u").alias("dst"))
        first, last = tied.agg(F.min("slice"), F.max("slice")).first()
        whole = first == last  # none too
    if not whole:
        pairs = cut(pairs.distinct(), "pairs")
    state = (0,) if whole else _state(pairs)
    for _ in range(max_rounds):
        if not state[0]:
            break
        pairs = cut(_tie_lesser(_tie_greater(pairs)), "pairs")
        before, state = state, _state(pairs)
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    named = pairs.select(F.col("dst").alias("id"), F.col("src").alias("component"))
    return graph.nodes.select("id").distinct().join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _state(pairs: DataFrame) -> tuple:
    r = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.xxhash64("dst", "src").cast("decimal(20,0)"))).first()
    return tuple(r)


def _tie_greater(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.where("dst > src").join(least, "src").select(F.col("m").alias("src"), "dst").where("src <> dst").distinct()


def _tie_lesser(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("dst").agg(F.min("src").alias("m"))
    moved = pairs.join(least, "dst").where("src <> m").select(F.col("m").alias("src"), F.col("src").alias("dst"))
    return moved.union(least.select(F.col("m").alias("src"), "dst")).distinct()


def shortest_paths(graph: Graph, start, predicate: Column | None = None, goal=None, max_hops: int | None = None) -> DataFrame:
    """(id, hops, path): a path of fewest edges from start to each node it reaches; of equals the least array.

    Nodes beyond max_hops are an error, not left out.
    """
    both = graph.both() if predicate is None else graph.both().where(predicate)
    steps = cut(both.select("src", "dst").where("src <> dst").distinct(), "steps")
    here = graph.nodes.where(F.col("id") == start).select("id", F.lit(0).alias("hops"), F.array("id").alias("path"))
    found = frontier = cut(here, "reached")
    for hop in count(1):
        reach = frontier.select(F.col("id").alias("src"), "path").join(steps, "src").join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
        frontier = cut(reach.groupBy("dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path")).select(F.col("dst").alias("id"), F.lit(hop).alias("hops"), "path"), "frontier")
        if frontier.isEmpty():
            break
        if max_hops is not None and hop > max_hops:
            raise RuntimeError(f"paths go on beyond {max_hops} hops")
        found = cut(found.unionByName(frontier), "reached")
        if goal is not None and not frontier.where(F.col("id") == goal).isEmpty():
            break
    return found if goal is None else found.where(F.col("id") == goal)


def path_edges(paths: DataFrame) -> DataFrame:
    """paths with edges: the path as an array of (src, dst); empty for start = goal."""
    pairs = F.transform(F.slice("path", 2, F.size("path")), lambda x, i: F.struct(F.get("path", i).alias("src"), x.alias("dst")))
    return paths.withColumn("edges", pairs)


@dataclass
class Search:
    """What a search tells of: each hook gets a table, for all nodes or edges of a round at once.

    on_open(id, hops, parent), on_edge(src, dst), on_close(id); stop(id, hops, parent) ends the search if it is true of newly
    opened nodes. The search returns (id, status, hops, parent), status being closed, open (when it was stopped) or unknown.
    """

    on_open: Callable[[DataFrame], None] = lambda _: None
    on_edge: Callable[[DataFrame], None] = lambda _: None
    on_close: Callable[[DataFrame], None] = lambda _: None
    stop: Callable[[DataFrame], bool] = lambda _: False

    def run(self, graph: Graph, start, predicate: Column | None = None) -> DataFrame:
        both = graph.both() if predicate is None else graph.both().where(predicate)
        steps = cut(both.select("src", "dst").where("src <> dst").distinct(), "steps")
        kind = graph.nodes.schema["id"].dataType
        opened = cut(graph.nodes.where(F.col("id") == start).select("id", F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("parent")), "opened")
        closed = opened.limit(0)
        for hop in count(1):
            self.on_open(opened)
            if opened.isEmpty() or self.stop(opened):
                break
            out = cut(opened.select(F.col("id").alias("src")).join(steps, "src"), "out")
            self.on_edge(out)
            self.on_close(opened.select("id"))
            closed = cut(closed.unionByName(opened), "closed")
            new = out.join(closed.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy("dst").agg(F.min("src").alias("parent"))
            opened = cut(new.select(F.col("dst").alias("id"), F.lit(hop).alias("hops"), "parent"), "opened")
        seen = closed.withColumn("status", F.lit("closed")).unionByName(opened.withColumn("status", F.lit("open")))
        return graph.nodes.select("id").join(seen, "id", "left").select("id", F.coalesce("status", F.lit("unknown")).alias("status"), "hops", "parent")


def depth_first_path(graph: Graph, start, goal) -> DataFrame:
    """Some path from start to goal; the shortest one is as good as any."""
    return shortest_paths(graph, start, goal=goal)


def closes_cycle(graph: Graph, src, dst) -> bool:
    """Whether an edge src -> dst would close a cycle: a loop, or dst already leads to src."""
    return src == dst or not shortest_paths(graph, dst, goal=src).isEmpty()


def add_acyclic(graph: Graph, pairs: list[tuple]) -> tuple[Graph, list[bool]]:
    """Insert edges in the order given; those that would close a cycle are rejected. For edges in a table see acyclic.insert_in_order()."""
    from geoweave.operators.acyclic import insert_in_order

    spark, n = graph.edges.sparkSession, len(pairs)
    new = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(pairs)], "step long, src long, dst long")
    old = graph.edges.select((-1 - F.monotonically_increasing_id()).alias("step"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    done = cut(insert_in_order(old.unionByName(new)).where("step >= 0"), "inserted")
    taken = {r.step: r.taken for r in done.collect()}
    graph = graph.add_edges(done.where("taken").select("src", "dst"))
    return replace(graph, nodes=cut(graph.nodes, "nodes"), edges=cut(graph.edges, "edges")), [taken[i] for i in range(n)]


def contract(graph: Graph, predicate: Column | None, reduce: list[Column], components: DataFrame | None = None) -> Graph:
    """One node for each component over the edges that pass the predicate, with the reduced columns.

    Edges between different components are relabelled, and repeated ones are one. Nodes without
    neighbours are reduced alone. Labels are the least node ids.
    """
    labels = connected_components(graph, predicate) if components is None else components  # of a written table: source and result may share a name
    nodes = graph.nodes.join(labels, "id").groupBy("component").agg(*reduce).withColumnRenamed("component", "id")
    ends = labels.select(F.col("id").alias("src"), F.col("component").alias("c1")), labels.select(F.col("id").alias("dst"), F.col("component").alias("c2"))
    e = graph.edges.join(ends[0], "src").join(ends[1], "dst").where("c1 <> c2").select(F.col("c1").alias("src"), F.col("c2").alias("dst"))
    return Graph(nodes, (e if graph.directed else canonical(e)).distinct(), graph.directed)


def id_sum(id_col: str = "id") -> Column:
    """Sum of ids as unsigned 64-bit numbers, below 10^18."""
    total = F.sum(F.col(id_col).cast("decimal(20,0)"))
    return ((total % F.lit(str(2**64)).cast("decimal(20,0)")) % F.lit(str(ID_MODULUS)).cast("decimal(20,0)")).cast("long")


def fold(order: str, value: str, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Pairwise fold of a group's values in the order of a column."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return F.aggregate(items, zero, lambda a, x: merge(a, x["v"]))


def pack_workloads(components: DataFrame, most: int = 5000) -> DataFrame:
    """(workload, files, components, nodes): components in several files one by one; others file by file,
    in equal parts of at most `most` components with the rest in the last part.

    components: (component, file, id), one row per node.
    """
    per = components.groupBy("component").agg(F.array_sort(F.collect_set("file")).alias("files"), F.count_distinct("id").alias("nodes"))
    single = per.where(F.size("files") == 1).withColumn("file", F.get("files", F.lit(0)))
    sizes = single.groupBy("file").agg(F.count("*").alias("n"))
    placed = single.join(sizes, "file")
    parts = F.ceil(F.col("n") / most)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("file").orderBy("component")) - 1
    part = F.least(F.floor(place / F.floor(F.col("n") / parts)), parts - 1).cast("int")
    packed = placed.withColumn("part", part).groupBy("file", "part").agg(F.array_sort(F.collect_list("component")).alias("components"), F.sum("nodes").alias("nodes"))
    one = packed.select(F.concat_ws("#", "file", "part").alias("workload"), F.array("file").alias("files"), "components", "nodes")
    many = per.where(F.size("files") > 1).select(F.concat(F.lit("component#"), F.col("component")).alias("workload"), "files", F.array("component").alias("components"), "nodes")
    return one.unionByName(many)


def contract_to_fixed_point(graph: Graph, distance: Callable[[Graph], DataFrame], limit: float, reduce: list[Column]) -> Graph:
    """Contract edges of at most `limit` until none is left; distance(graph) gives edges (src, dst, distance) of the present nodes."""
    while True:
        edges = cut(distance(graph), "distances")
        near = edges.where(F.col("distance") <= limit)
        if near.isEmpty():
            return replace(graph, edges=edges)
        labels = cut(connected_components(Graph(graph.nodes, near)), "components")
        merged = contract(replace(graph, edges=edges), None, reduce, labels)
        graph = replace(merged, nodes=cut(merged.nodes, "nodes"), edges=cut(merged.edges, "edges"))


def component_tables(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components as nodes (component), and which node is part of which (id, component)."""
    return labels.select("component").distinct(), labels.select("id", "component").distinct()


def nodes_of_components(part_of: DataFrame, wanted: DataFrame) -> DataFrame:
    """(component, id) of the wanted components (component)."""
    return part_of.join(wanted.select("component").distinct(), "component").select("component", "id")


def files_of_components(part_of: DataFrame, stored: DataFrame) -> DataFrame:
    """(component, file), each once: the files in which the nodes of a component (id, component) are stored (id, file)."""
    return part_of.select("id", "component").join(stored.select("id", "file"), "id").select("component", "file").distinct()
