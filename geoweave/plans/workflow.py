"""Settlement delineation and analysis as one chain of DataFrames.

Stages: split, filter, neighbours, components, contraction, analysis, merge. What later stages read again is
written to the shared folder; run_files() goes from shapefiles to shapefiles.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from geoweave.functions import areal as A
from geoweave.functions import geodesy, hulls, kernels, predicates
from geoweave.functions import linear as N
from geoweave.functions import vectors as V
from geoweave.operators import centrality, layers, spatial_join
from geoweave.operators.graph import Graph
from geoweave.operators.graph_algorithms import connected_components, contract, id_sum
from geoweave.operators.storage import cut
from geoweave.plans.config import WorkflowConfig
from geoweave.sources import files

EDGE_WIDTH = 0.000001


@dataclass
class Result:
    """What each stage gave; None for stages that were not reached."""

    split: DataFrame | None = None
    filtered: DataFrame | None = None
    edges: DataFrame | None = None
    components: DataFrame | None = None
    contracted: Graph | None = None
    analysed: DataFrame | None = None
    edge_shapes: DataFrame | None = None


def filter_stage(polygons: DataFrame, config: WorkflowConfig) -> DataFrame:
    """Polygons that pass all filters, with FEATURE_ID; equal geometries are one feature."""
    named = polygons.withColumn("FEATURE_ID", A.geometry_id(A.canonical_polygon(F.col("geom")))).dropDuplicates(["FEATURE_ID"])
    unary = predicates.all_of(*map(predicates.unary_filter, config.unary_filters))
    if not config.binary_filters:
        return named.where(unary(F.col("geom")))
    binary = predicates.all_of(*map(predicates.binary_filter, config.binary_filters))
    return spatial_join.mutual_filter(named, unary, binary, "FEATURE_ID", "geom")


def buffered_box(distance: float, crs: str):
    """Box of a polygon, wider by the distance on every side; metres become degrees at the box's own latitude."""

    def box(geom: Column) -> Column:
        b = A.ring_box(geom["boundary"])
        if crs != "geographic":
            return A.rectangle(b["xmin"] - distance, b["ymin"] - distance, b["xmax"] + distance, b["ymax"] + distance)
        per_degree = 3.141592653589793 * geodesy.RADIUS / 180 * 0.99  # a little less than any degree of latitude
        high = F.least(F.lit(89.0), F.greatest(F.abs(b["ymin"]), F.abs(b["ymax"])))
        dy = F.lit(distance / per_degree)
        dx = dy / F.cos(F.radians(high + dy))
        return A.rectangle(b["xmin"] - dx, b["ymin"] - dy, b["xmax"] + dx, b["ymax"] + dy)

    return box


def neighbour_stage(filtered: DataFrame, config: WorkflowConfig) -> DataFrame:
    """(src, dst, closest) of polygons that are neighbours."""
    wanted = [predicates.neighbour_predicate(c, config.crs) for c in config.neighbouring_predicates]
    wanted = wanted or [predicates.distance_predicate(config.max_distance_meters, config.crs)]
    found = spatial_join.neighbours(
        filtered, buffered_box(config.max_distance_meters / 2, config.crs), predicates.all_of(*wanted), config.max_neighbours, "FEATURE_ID", "geom"
    )
    return found.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "closest").dropDuplicates(["src", "dst"])


def contraction_stage(filtered: DataFrame, edges: DataFrame, config: WorkflowConfig) -> tuple[DataFrame, Graph]:
    """Component labels, and the graph of multi-polygons."""
    rules = [predicates.neighbour_predicate(c, config.crs) for c in config.contraction_predicates]
    mergeable = predicates.any_of(*rules)(F.col("closest"))
    graph = Graph(filtered.select(F.col("FEATURE_ID").alias("id"), "geom"), edges)
    labels = cut(connected_components(graph, mergeable), "components")
    merged = contract(graph, None, [id_sum().alias("FEATURE_ID"), F.sort_array(F.collect_list("geom")).alias("geom"), F.count("*").alias("parts")], labels)
    return labels, merged


def analysis_stage(graph: Graph, config: WorkflowConfig) -> DataFrame:
    """Nodes with the fields of the measures asked for; distances are those of the shapes."""
    nodes = cut(graph.nodes.withColumn("area", A.multi_area(F.col("geom"))), "shapes")
    side = lambda end: nodes.select(F.col("id").alias(end), F.col("geom").alias(f"{end}_geom"))
    ends = graph.edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")
    gap = kernels.closest_udf("multi", "multi")(F.col("src_geom"), F.col("dst_geom"))
    edges = cut(ends.select("src", "dst", gap["d"].alias("distance")), "distances")
    return centrality.apply_measures(Graph(nodes, edges, graph.directed), config.centrality_measures)


@V.bound
def edge_shape(closest: Column) -> Column:
    """A thin rectangle around the segment of STRUCT<d, a, b>, clockwise; null where shapes touch."""
    s = N.segment(closest["a"], closest["b"])
    return _thin(s, V.scale(V.normalize(V.orthogonal(N.direction(s))), EDGE_WIDTH / 2))


@V.bound
def _thin(s: Column, side: Column) -> Column:
    p, q = s["p"], s["q"]
    corners = F.array(V.add(p, side), V.add(q, side), V.subtract(q, side), V.subtract(p, side))
    return _clockwise(corners, V.raw((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2), V.distance(p, q) > 0)


@V.bound
def _clockwise(corners: Column, middle: Column, apart: Column) -> Column:
    placed = F.transform(corners, lambda c: F.struct(V.angle_to(c, middle).alias("w"), c.alias("c")))
    return F.when(apart, F.transform(F.reverse(F.array_sort(placed)), lambda t: t["c"]))


@V.bound
def nearest_parts(a: Column, b: Column) -> Column:
    """STRUCT<p, q>: of two multi-polygons the parts with the closest centroids."""
    pairs = F.flatten(F.transform(a, lambda p, i: F.transform(b, lambda q, j: F.struct(V.bound(V.distance)(A.polygon_centroid(p), A.polygon_centroid(q)).alias("d"), i.alias("i"), j.alias("j")))))
    pick = V.bound(lambda best, x, y: F.struct(F.get(x, best["i"]).alias("p"), F.get(y, best["j"]).alias("q")))
    return pick(F.array_min(pairs), a, b)


def edge_layer(graph: Graph) -> DataFrame:
    side = lambda end: graph.nodes.select(F.col("id").alias(end), F.col("geom").alias(f"{end}_geom"))
    pairs = graph.edges.join(side("src"), "src").join(side("dst"), "dst").withColumn("near", nearest_parts(F.col("src_geom"), F.col("dst_geom")))
    near = cut(pairs.select("src", "dst", "near"), "near-parts")
    closest = cut(near.select("src", "dst", kernels.closest_udf()(F.col("near.p"), F.col("near.q")).alias("closest")), "closest")
    return closest.select("src", "dst", edge_shape(F.col("closest")).alias("ring")).where("ring is not null").select("src", "dst", A.polygon(F.col("ring")).alias("geom"))


def split_stage(polygons: DataFrame, config: WorkflowConfig) -> DataFrame:
    """polygons with tx, ty: the tile of each one's centroid, (splits + 1) x (splits + 1) tiles over the common box."""
    c = polygons.withColumn("__c", A.polygon_centroid(F.col("geom")))
    box = c.agg(F.min("__c.x").alias("xmin"), F.min("__c.y").alias("ymin"), F.max("__c.x").alias("xmax"), F.max("__c.y").alias("ymax"))
    return layers.split(c, config.splits, F.col("__c.x"), F.col("__c.y"), box).drop("__c")


def merge_stage(folder: str, prefix: str, spark) -> DataFrame | None:
    """The union of the layers in a folder whose names start with prefix; None if there is none."""
    found = files.results_of(spark, folder, prefix)
    return layers.merge(*[spark.read.format("shapefile").option("geometry", "multi").load(f) for f in found]) if found else None


def run(layers_in: list[DataFrame], config: WorkflowConfig) -> Result:
    """All stages up to the one the configuration names. Layers need a polygon column geom."""
    out = Result()
    out.split = cut(split_stage(layers.merge(*layers_in), config), "split")
    if not config.reaches("FILTER"):
        return out
    out.filtered = cut(filter_stage(out.split.drop("tx", "ty"), config), "filtered")
    if config.reaches("NEIGHBOURS"):
        out.edges = cut(neighbour_stage(out.filtered, config), "edges")
    if config.reaches("COMPONENTS"):
        out.components, out.contracted = contraction_stage(out.filtered, out.edges, config)
    if config.reaches("ANALYSIS"):
        out.contracted = replace(out.contracted, nodes=cut(out.contracted.nodes, "merged"), edges=cut(out.contracted.edges, "merged-edges"))
        out.analysed = analysis_stage(out.contracted, config)
        out.edge_shapes = edge_layer(out.contracted) if config.visualize_edges else None
    return out


def run_files(spark, inputs: list[str], config: WorkflowConfig, folder: str) -> dict[str, str]:
    """From shapefiles to shapefiles: the paths written under folder, by name of the layer.

    split holds a layer for each tile (tile_X_Y), features the filtered polygons, clusters the merged ones with their
    measures, edges the links between them. Each is a folder of one bundle for each partition.
    """
    out = run([spark.read.format("shapefile").load(x) for x in inputs], config)
    written = {}

    def keep(name: str, layer: DataFrame | None) -> None:
        if layer is not None:
            flat = layer.select(*[c for c in layer.columns if not isinstance(layer.schema[c].dataType, (ArrayType, StructType)) or c == "geom"])
            written[name] = files.write(flat, f"{folder}/{name}")

    if config.splits:
        for r in out.split.select("tx", "ty").distinct().orderBy("tx", "ty").collect():  # as many as tiles
            keep(f"tile_{r.tx}_{r.ty}", out.split.where((F.col("tx") == r.tx) & (F.col("ty") == r.ty)).drop("tx", "ty"))
    keep("features", out.filtered)
    keep("clusters", out.analysed if out.analysed is not None else out.contracted and out.contracted.nodes)
    keep("edges", out.edge_shapes)
    return written


def settlement_outlines(nodes: DataFrame) -> DataFrame:
    """Concave outlines of merged settlements in place of their parts, with their attributes."""
    return nodes.withColumn("geom", hulls.outline_udf()(F.col("geom")))


def outline_files(spark, path: str, target: str | None = None) -> str:
    """The outlines of a layer of merged settlements, from shapefile to shapefile; returns where they are."""
    nodes = spark.read.format("shapefile").option("geometry", "multi").load(path)
    return files.write(settlement_outlines(nodes), target or files.append_to_name(path, "_concave_hull"))
