"""Rasters as (row, col, val) tables, made into polygons of equal value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.functions import vectors as V
from geoweave.operators.arrangement import chain_rings
from geoweave.operators.graph import Graph
from geoweave.operators.graph_algorithms import connected_components
from geoweave.operators.storage import cut


def regions(cells: DataFrame, mask_zero: bool = True) -> DataFrame:
    """cells with region: 8-connected cells of equal value share it. Neighbours are listed, so this is an equi-join."""
    used = cells.where("val <> 0") if mask_zero else cells
    used = used.withColumn("id", F.col("row").cast("long") * F.lit(1 << 31) + F.col("col"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    asks = used.select(F.col("id").alias("src"), "val", (F.col("row")).alias("r"), F.col("col").alias("c"), step.alias("s")).select("src", "val", (F.col("r") + F.col("s.i")).alias("row"), (F.col("c") + F.col("s.j")).alias("col"))
    edges = asks.join(used.select(F.col("id").alias("dst"), "val", "row", "col"), ["row", "col", "val"]).select("src", "dst")
    parts = connected_components(Graph(used.select("id"), edges))
    return used.join(parts, "id").withColumnRenamed("component", "region").drop("id")


def polygonise(cells: DataFrame, mask_zero: bool = True) -> DataFrame:
    """(pixel_val, region, rings): outlines of each region in cell corners, from their least corners on; the first ring is the outer one.

    The sides between a region's cells and others are rows, which are chained by pointer doubling, so a region as large as the raster is traced by all
    tasks. Cells that touch at a corner keep rings of their own; outer rings are counter-clockwise, with rows upwards, holes clockwise.
    """
    placed = cut(regions(cells, mask_zero).select(F.struct("region", F.col("val").alias("val")).alias("group"), "row", "col"), "regions")
    corner = lambda dx, dy: F.struct((F.col("col") + dx).cast("long").alias("x"), (F.col("row") + dy).cast("long").alias("y"))
    side = lambda dr, dc, a, b: F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), corner(*a).alias("u"), corner(*b).alias("v"))
    sides = F.array(side(-1, 0, (0, 0), (1, 0)), side(0, 1, (1, 0), (1, 1)), side(1, 0, (1, 1), (0, 1)), side(0, -1, (0, 1), (0, 0)))
    border = placed.select("group", F.explode(sides).alias("s")).select("group", "s.*").join(placed, ["group", "row", "col"], "left_anti")
    rings = chain_rings(border.select("group", "u", "v"), 1.0)
    at = V.bound(lambda r, k: F.concat(F.slice(r, k, F.size(r)), F.slice(r, F.lit(1), k - 1)))
    turned = V.bound(lambda r: at(r, F.array_position(r, F.array_min(r)).cast("int")))
    return rings.groupBy("group").agg(F.sort_array(F.collect_list(turned(F.col("ring")))).alias("rings")).select(F.col("group.val").alias("pixel_val"), F.col("group.region").alias("region"), "rings")
