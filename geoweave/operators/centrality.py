"""Measures of nodes by their neighbours; each returns (id, value column), zero for isolated nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.operators.graph import Graph


def degree_centrality(graph: Graph) -> DataFrame:
    return graph.degrees().withColumnRenamed("degree", "DegreeCent")


def _with_ends(graph: Graph, columns: list[str]) -> DataFrame:
    side = lambda end: graph.nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
    return graph.both().join(side("src"), "src").join(side("dst"), "dst")


def _measure(graph: Graph, columns: list[str], value, name: str) -> DataFrame:
    m = _with_ends(graph, columns).groupBy(F.col("src").alias("id")).agg(value.alias(name))
    return graph.nodes.select("id").join(m, "id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def mean_local_significance(graph: Graph, area: str = "area", distance: str = "distance", log: bool = False) -> DataFrame:
    """Mean of area * area / squared distance over the neighbours; infinite at distance zero. Edges carry the distance."""
    d2 = F.col(distance) * F.col(distance)
    each = F.when(d2 == 0, F.lit(float("inf"))).otherwise(F.col(f"src_{area}") * F.col(f"dst_{area}") / F.when(d2 == 0, 1.0).otherwise(d2))
    value = F.log10(F.avg(each)) if log else F.avg(each)
    return _measure(graph, [area], value, "MeanLocSig")


def smaller_neighbours_ratio(graph: Graph, area: str = "area") -> DataFrame:
    """Share of the neighbours with a strictly smaller area."""
    return _measure(graph, [area], F.avg((F.col(f"src_{area}") > F.col(f"dst_{area}")).cast("double")), "SmallNeigh")


MEASURES: dict[str, Callable[[Graph], DataFrame]] = {
    "DegreeCentralityMeasure": degree_centrality,
    "MeanLocalSignificance": mean_local_significance,
    "SmallerNeighboursRatio": smaller_neighbours_ratio,
}


def register_measure(name: str, measure: Callable[[Graph], DataFrame]) -> None:
    """Make a measure available to configurations; it gets the graph and returns (id, value)."""
    MEASURES[name] = measure


def apply_measures(graph: Graph, names: list[str]) -> DataFrame:
    unknown = [n for n in names if n not in MEASURES]
    if unknown:
        raise ValueError(f"unknown measures: {unknown}")
    out = graph.nodes
    for n in names:
        out = out.join(MEASURES[n](graph), "id", "left")
    return out


def merge_attributes(rows: DataFrame, group: str, area: str = "area", imperviousness: str = "imp", population: str = "pop") -> DataFrame:
    """Area and population summed, imperviousness weighted by area."""
    share = F.sum(F.col(imperviousness) * F.col(area)) / F.sum(area)
    return rows.groupBy(group).agg(F.sum(area).alias(area), share.alias(imperviousness), F.sum(population).alias(population))


def settlement_value(area, imperviousness=None, population=None, scale: float = 1.0):
    """Area, weighted by imperviousness if there is one, and raised by the population."""
    base = F.when(imperviousness.isNotNull(), area * imperviousness).otherwise(area) if imperviousness is not None else area
    return F.when(population.isNotNull(), base + area * population / scale).otherwise(base) if population is not None else base
