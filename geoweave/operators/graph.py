"""Graphs as two tables: nodes(id, ...) and edges(src, dst, ...).

Undirected edges are stored once, with the lesser end first. Every operation returns a new graph or a
DataFrame; nothing is evaluated until an action asks for it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    @staticmethod
    def of_edges(edges: DataFrame, directed: bool = False, nodes: DataFrame | None = None, keep_multi: bool = False) -> Graph:
        """A graph from pairs; missing endpoints become nodes, repeated edges are one unless keep_multi."""
        ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst"))).distinct()
        all_nodes = ends if nodes is None else nodes.unionByName(ends.join(nodes, "id", "left_anti"), allowMissingColumns=True)
        g = Graph(all_nodes, edges if directed else canonical(edges), directed)
        return g if keep_multi else replace(g, edges=g.edges.dropDuplicates(["src", "dst"]))

    def _pairs(self, pairs: DataFrame) -> DataFrame:
        return pairs if self.directed else canonical(pairs)

    def add_nodes(self, nodes: DataFrame) -> Graph:
        new = nodes.dropDuplicates(["id"]).join(self.nodes, "id", "left_anti")
        return replace(self, nodes=self.nodes.unionByName(new, allowMissingColumns=True))

    def remove_nodes(self, ids: DataFrame) -> Graph:
        """Without these nodes and all edges at them."""
        ids = ids.select("id").distinct()
        e = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return replace(self, nodes=self.nodes.join(ids, "id", "left_anti"), edges=e.select(self.edges.columns))

    def contains_nodes(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.nodes.select("id", F.lit(True).alias("found")), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def add_edges(self, pairs: DataFrame, keep_multi: bool = False) -> Graph:
        pairs = self._pairs(pairs)
        new = pairs if keep_multi else pairs.dropDuplicates(["src", "dst"]).join(self.edges, ["src", "dst"], "left_anti")
        g = replace(self, edges=self.edges.unionByName(new, allowMissingColumns=True))
        return g.add_nodes(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")))

    def remove_edges(self, pairs: DataFrame) -> Graph:
        return replace(self, edges=self.edges.join(self._pairs(pairs), ["src", "dst"], "left_anti"))

    def contains_edges(self, pairs: DataFrame) -> DataFrame:
        return self._pairs(pairs).join(self.edges.select("src", "dst", F.lit(True).alias("found")), ["src", "dst"], "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def both(self) -> DataFrame:
        """Edges from each node: as they are, or for undirected graphs in both directions."""
        if self.directed:
            return self.edges
        turned = self.edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in self.edges.columns if c not in ("src", "dst")])
        return self.edges.unionByName(turned)

    def neighbours(self, node=None) -> DataFrame:
        e = self.both()
        return e if node is None else e.where(F.col("src") == node)

    def reachable_from(self, node=None) -> DataFrame:
        """Direct predecessors."""
        e = self.both() if not self.directed else self.edges
        return e if node is None else e.where(F.col("dst") == node)

    outbound, inbound = neighbours, reachable_from

    def degrees(self) -> DataFrame:
        """(id, degree): neighbours of each node, repeated ones counted again; out-edges for directed graphs."""
        return self._count(self.both(), "src", "degree")

    def in_degrees(self) -> DataFrame:
        return self._count(self.edges if self.directed else self.both(), "dst", "in_degree")

    def out_degrees(self) -> DataFrame:
        return self._count(self.both(), "src", "out_degree")

    def _count(self, edges: DataFrame, end: str, name: str) -> DataFrame:
        n = edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))
        return self.nodes.select("id").join(n, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))

    def roots(self) -> DataFrame:
        """Nodes that no edge leads to."""
        return self.nodes.join(self.edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")

    def weighted(self, weight: Column, overrides: DataFrame | None = None) -> Graph:
        """Edges with weight: that of overrides(src, dst, weight) if there is one, else the expression's over src and dst."""
        e = self.edges.drop("weight").withColumn("default_weight", weight)
        if overrides is None:
            return replace(self, edges=e.withColumnRenamed("default_weight", "weight"))
        o = self._pairs(overrides).dropDuplicates(["src", "dst"])
        return replace(self, edges=e.join(o, ["src", "dst"], "left").withColumn("weight", F.coalesce("weight", "default_weight")).drop("default_weight"))

    def problems(self) -> DataFrame:
        """(kind, id) of repeated node ids and of edge ends that are no nodes; empty for a sound graph."""
        twice = self.nodes.groupBy("id").count().where("count > 1").select(F.lit("repeated id").alias("kind"), "id")
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).distinct()
        return twice.unionByName(ends.join(self.nodes, "id", "left_anti").select(F.lit("unknown end").alias("kind"), "id"))


def canonical(pairs: DataFrame) -> DataFrame:
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest)


def edge_text(src: Column, dst: Column, directed: bool) -> Column:
    return F.format_string("(%s)->(%s)" if directed else "(%s)-(%s)", src, dst)
