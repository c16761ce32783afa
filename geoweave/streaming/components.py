"""Components of streams of edges, handed on as their windows of time close.

Edges belong to tumbling windows; a window's graph is complete when the watermark (the greatest time seen, less a delay) has passed its
end, and then its components are handed on, once. What is open is kept as stars (node, component) in versioned tables beside the
output, one version a batch; a batch that is run again after a failure finds the version before it and writes the same again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.operators.graph import Graph
from geoweave.operators.graph_algorithms import connected_components

OPEN = "end timestamp, node long, component long, edges long"
OUT = "end timestamp, component long, nodes long, edges long"


def _stars(edges: DataFrame) -> DataFrame:
    """(end, node, component, edges) of edges (end, src, dst, edges): one row a node; a component's edges are counted at its least node."""
    at = lambda c: F.struct("end", F.col(c).alias("id"))
    labels = connected_components(Graph.of_edges(edges.select(at("src").alias("src"), at("dst").alias("dst"))))
    found = labels.select(F.col("id.end").alias("end"), F.col("id.id").alias("node"), F.col("component.id").alias("component"))
    ends = found.select("end", F.col("node").alias("src"), "component")
    counts = edges.join(ends, ["end", "src"]).groupBy("end", F.col("component").alias("node")).agg(F.sum("edges").alias("edges"))
    return found.join(counts, ["end", "node"], "left").select("end", "node", "component", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


def _totals(stars: DataFrame) -> DataFrame:
    return stars.groupBy("end", "component").agg(F.count("*").alias("nodes"), F.sum("edges").alias("edges"))


def _dated(edges: DataFrame, window: str) -> DataFrame:
    return edges.where("src is not null and dst is not null and ts is not null").select(F.window("ts", window)["end"].alias("end"), "src", "dst", F.lit(1).cast("long").alias("edges"))


def window_components(edges: DataFrame, window: str = "1 hour") -> DataFrame:
    """(end, component, nodes, edges) of the graph of each window of edges (src, dst, ts). Loops count as edges; rows with nulls are left out."""
    return _totals(_stars(_dated(edges, window)))


@dataclass
class ClosingComponents:
    """A stream's components under a folder that all executors share: results in out/, what is open in open/, late edges counted in marks/."""

    spark: SparkSession
    folder: str
    window: str = "1 hour"
    delay: str = "10 minutes"

    def start(self, edges: DataFrame, **trigger):
        """Run a stream of edges (src, dst, ts); its checkpoint lies in the folder too."""
        writer = edges.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(**trigger).start() if trigger else writer.start()

    def batch(self, rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = spark.read.schema("mark timestamp, late long").parquet(f"{self.folder}/marks/{number - 1}").first() if number else None
        passed = before.mark if before else None
        dated = _dated(rows, self.window)
        on_time = dated if passed is None else dated.where(F.col("end") > F.lit(passed))
        seen, late = rows.agg(F.max("ts") - F.expr(f"interval {self.delay}")).first()[0], 0 if passed is None else dated.where(F.col("end") <= F.lit(passed)).count()
        mark = max((x for x in (passed, seen) if x is not None), default=None)
        if number:
            held = spark.read.schema(OPEN).parquet(f"{self.folder}/open/{number - 1}")
            on_time = on_time.unionByName(held.select("end", F.col("node").alias("src"), F.col("component").alias("dst"), "edges"))
        stars = _stars(on_time)
        closes = F.col("end") <= F.lit(mark) if mark is not None else F.lit(False)
        # a batch's tables are named by its number: if it is run again, it replaces them
        stars.where(~closes).write.mode("overwrite").parquet(f"{self.folder}/open/{number}")
        _totals(stars.where(closes)).write.mode("overwrite").parquet(f"{self.folder}/out/batch={number}")
        spark.createDataFrame([(mark, late)], "mark timestamp, late long").write.mode("overwrite").parquet(f"{self.folder}/marks/{number}")

    def closed(self) -> DataFrame:
        """What was handed on so far."""
        return self.spark.read.schema(OUT).parquet(f"{self.folder}/out").select("end", "component", "nodes", "edges")

    def late(self) -> int:
        """Edges that came after their window was closed."""
        return self.spark.read.schema("mark timestamp, late long").parquet(f"{self.folder}/marks/*").agg(F.sum("late")).first()[0] or 0
