"""Graphs in JSON files: {"nodes": [{"id", "data"}], "edges": [{"from", "to"}]}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.operators.graph import Graph


def read(spark: SparkSession, path: str, data: str = "struct<x:double,y:double>", directed: bool = True) -> Graph:
    """Nodes and edges of a file. Missing keys, other names than .json and edges of unknown nodes are errors."""
    if not path.endswith(".json"):
        raise ValueError("a graph file must end in .json")
    schema = f"nodes array<struct<id:bigint,data:{data}>>, edges array<struct<`from`:bigint,`to`:bigint>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not rows.where("nodes is null or edges is null").isEmpty():
        raise ValueError("the file lacks nodes or edges")
    nodes = rows.select(F.explode("nodes").alias("n")).select("n.id", "n.data")
    edges = rows.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"))
    graph = Graph(nodes, edges, directed)
    unknown = graph.problems().where("kind = 'unknown end'").limit(5).collect()
    if unknown:
        raise ValueError(f"edges name unknown nodes, such as {[r.id for r in unknown]}")
    return graph


def to_json(graph: Graph) -> DataFrame:
    """One row with the document; the format holds a whole graph in one value, so this is for graphs of that size."""
    nodes = graph.nodes.select(F.struct("id", *[c for c in graph.nodes.columns if c != "id"]).alias("n"))
    edges = graph.edges.select(F.struct(F.col("src").alias("from"), F.col("dst").alias("to")).alias("e"))
    n, e = nodes.agg(F.array_sort(F.collect_list("n")).alias("nodes")), edges.agg(F.array_sort(F.collect_list("e")).alias("edges"))
    return n.join(F.broadcast(e)).select(F.to_json(F.struct("nodes", "edges")).alias("value"))


def write(graph: Graph, path: str) -> None:
    if not path.endswith(".json"):
        raise ValueError("a graph file must end in .json")
    with open(path, "w") as f:
        f.write(to_json(graph).first().value)
