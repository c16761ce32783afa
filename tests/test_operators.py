"""Joins, graphs, layers, sources and workflows on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.functions import areal as A
from geoweave.functions import kernels, predicates
from geoweave.functions import vectors as V
from geoweave.operators import centrality, layers, spatial_join
from geoweave.operators import graph_algorithms as GA
from geoweave.operators.graph import Graph

RING = "array<struct<x:double,y:double>>"


def polygons(spark, named):
    rows = [(k, [tuple(map(float, p)) for p in r]) for k, r in named.items()]
    return spark.createDataFrame(rows, f"id string, r {RING}").select("id", A.polygon(F.col("r")).alias("geom"))


def box(tl, br):
    return [tl, (br[0], tl[1]), br, (tl[0], br[1])]


def rhombus(c, r):
    return [(c[0], c[1] + r), (c[0] + r, c[1]), (c[0], c[1] - r), (c[0] - r, c[1])]


def test_sweep_filter_keeps_the_outer_box(spark):
    layer = polygons(spark, {"a": box((4, 4), (0, 0)), "b": box((2, 2), (3, 3)), "c": box((-1.1, -1.1), (-1.0, -1.0))})
    kept = spatial_join.mutual_filter(layer, lambda g: A.polygon_area(g) >= 0.5, predicates.inside_polygon_filter())
    assert [r.id for r in kept.collect()] == ["a"]


def test_polygon_neighbours(spark):
    named = {
        "b1": box((0, 0), (2, 2)), "b2": box((3.5, 2), (4, 1)), "b3": box((2.5, 3), (3.5, 4)), "b4": box((2, -0.5), (2.5, -1)),
        "t1": [(5, 2), (4, 3), (5, 3)], "r1": rhombus((-1, 3), 1), "r2": rhombus((-0.5, -0.5), 0.5),
    }
    wide = lambda g: (lambda b: A.rectangle(b["xmin"] - 1.0, b["ymin"] - 1.0, b["xmax"] + 1.0, b["ymax"] + 1.0))(A.ring_box(g["boundary"]))
    found = spatial_join.neighbours(polygons(spark, named), wide, predicates.distance_predicate(1.0), 2)
    pairs = {tuple(sorted((r.a, r.b))) for r in found.collect()}
    assert {("b1", "b4"), ("b1", "r2"), ("b2", "t1"), ("b3", "t1")} <= pairs
    assert all(("b3", x) not in pairs and (x, "b3") not in pairs for x in ("b4", "r1", "r2"))


def test_box_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    xy, size = rng.random((300, 2)) * 100, rng.choice([0.0, 0.3, 2, 40], (300, 2))
    rows = [(i, *map(float, (*xy[i], *(xy[i] + size[i])))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double").select("id", A.rectangle(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("box"))
    got = [(r.a, r.b) for r in spatial_join.box_pairs(df).collect()]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if (xy[i] <= xy[j] + size[j]).all() and (xy[j] <= xy[i] + size[i]).all()}
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_points(spark):
    at = {"A": (0, 3), "B": (1, 3.5), "C": (-1, 2), "D": (-1.5, 4.5), "E": (0, 6), "F": (-2, 1), "G": (2, 1), "H": (3, 3), "I": (4, 3), "J": (3, 0), "K": (6, 1), "L": (-4, 3), "M": (-12, -4)}
    pts = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in at.items()], "id string, x double, y double").select("id", V.raw(F.col("x"), F.col("y")).alias("p"))
    got = {}
    for r in spatial_join.all_nearest(pts, 2).collect():
        got.setdefault(r.id, {})[r.rank] = r.neighbour
    for k, (x, y) in at.items():
        order = sorted((np.hypot(x - u, y - v), n) for n, (u, v) in at.items() if n != k)
        assert [got[k][1], got[k][2]] == [n for _, n in order[:2]]
    assert spatial_join.all_nearest(pts.limit(1), 2).count() == 0


def graph(spark, pairs, directed=False):
    return Graph.of_edges(spark.createDataFrame(pairs, "src long, dst long"), directed)


def test_degrees_of_path_star_and_complete_graph(spark):
    degree = lambda g: dict(g.degrees().collect())
    assert degree(graph(spark, [(1, 2), (2, 3)])) == {1: 1, 2: 2, 3: 1}
    assert degree(graph(spark, [(0, i) for i in range(1, 11)])) == {0: 10} | {i: 1 for i in range(1, 11)}
    assert set(degree(graph(spark, [(i, j) for i in range(4) for j in range(4) if i != j])).values()) == {3}


def test_components_on_chains_and_rings(spark):
    chain, ring_ = [(i, i + 1) for i in range(100, 160)], [(i, (i + 1) % 7) for i in range(7)]
    got = dict(GA.connected_components(graph(spark, chain + ring_ + [(500, 500)])).collect())
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(7)} == {0} and got[500] == 500


def test_contraction_leaves_no_mergeable_edge(spark):
    rng = np.random.default_rng(1)
    xy = rng.random((30, 2)) * 100
    pairs = [(i, j, float(np.hypot(*(xy[i] - xy[j])))) for i in range(30) for j in range(i)]
    g = Graph.of_edges(spark.createDataFrame(pairs, "src long, dst long, weight double"))
    labels = dict(GA.connected_components(g, F.col("weight") < 15).collect())
    out = GA.contract(g, F.col("weight") < 15, [F.count("*").alias("n")])
    assert sum(r.n for r in out.nodes.collect()) == 30
    assert all(labels[i] == labels[j] for i, j, w in pairs if w < 15)
    assert {(r.src, r.dst) for r in out.edges.collect()} == {tuple(sorted((labels[i], labels[j]))) for i, j, _ in pairs if labels[i] != labels[j]}


def test_json_graph(spark, tmp_path):
    from geoweave.sources import json_graph

    doc = {"nodes": [{"id": 1, "data": {"x": 1, "y": 2}}, {"id": 2, "data": {"x": 3, "y": 4}}, {"id": 3, "data": {"x": 5, "y": -6}}], "edges": [{"from": 1, "to": 2}, {"from": 2, "to": 3}, {"from": 3, "to": 1}]}
    p = tmp_path / "g.json"
    p.write_text(json.dumps(doc))
    g = json_graph.read(spark, str(p))
    json_graph.write(g, str(tmp_path / "h.json"))
    assert json.loads((tmp_path / "h.json").read_text())["edges"] == doc["edges"]
    p.write_text(json.dumps(doc | {"edges": [{"from": 1, "to": 9}]}))
    with pytest.raises(ValueError, match="unknown nodes"):
        json_graph.read(spark, str(p))


def test_shapefile_round_trip(spark, tmp_path):
    from geoweave.sources import files, shapefile

    hole = [[(2.0, 8.0), (8.0, 8.0), (8.0, 2.0), (2.0, 2.0)]]
    rows = [(1, 2.5, "ab", ([(0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)], hole)), (2, None, None, ([(20.0, 0.0), (22.0, 0.0), (20.0, 2.0)], []))]
    layer = spark.createDataFrame(rows, f"id int, v double, t string, geom struct<boundary:{RING},holes:array<{RING}>>")
    out = str(tmp_path / "layer")
    files.overwrite(layer.coalesce(1), out)
    shapefile.register(spark)
    back = spark.read.format("shapefile").load(out).select("id", "v", "t", A.polygon_area(F.col("geom")).alias("a")).orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, 2.5, "ab", 64.0), (2, 0.0, "", 2.0)]
    multi = spark.read.format("shapefile").option("geometry", "multi").load(out)
    assert [r.n for r in multi.select(F.size("geom").alias("n")).collect()] == [1, 1]
    assert files.write(layer, out) == out + "_1"
    assert files.try_read(spark, str(tmp_path / "none.shp"))[1]


def test_raster_regions_touch_at_corners(spark):
    from geoweave.sources.raster import polygonise

    cells = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (0, 1, 2), (3, 3, 1), (2, 0, 0)], "row int, col int, val int")
    got = sorted((r.pixel_val, len(r.rings)) for r in polygonise(cells).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_layer_fields(spark):
    layer = spark.range(2).select(F.lit(1).alias("geom"), "id")
    assert layers.has_field(layers.add_field(layer, "score", "double"), "score", "double")
    with pytest.raises(ValueError):
        layers.add_field(layer, "elevenchars", "text")
    with pytest.raises(ValueError):
        layers.add_field(layer, "id", "text")
    assert layers.clear_fields(layer).columns == ["geom"]


def test_workflow_merges_close_squares(spark):
    from geoweave.plans import workflow
    from geoweave.plans.config import WorkflowConfig, urban_clusters

    step = 0.001  # about 74 m by 111 m here
    named = {"a": box((10.0, 48.0 + step), (10.0 + step, 48.0)), "b": box((10.0 + 1.3 * step, 48.0 + step), (10.0 + 2.3 * step, 48.0)), "c": box((10.0 + 5 * step, 48.0 + step), (10.0 + 6 * step, 48.0))}
    near = lambda d: {"name": "DistanceBiPredicate", "maxDistanceMeters": d}
    config = WorkflowConfig.from_json(json.dumps({"unary-filters": [{"name": "ApproxAreaFilter", "requiredArea": 1000}], "maxDistanceMeters": 300, "maxNeighbours": 3, "neighbouring-predicates": [near(300)], "contraction-predicates": [near(50)], "centrality-measures": list(centrality.MEASURES), "visualize-edges": True, "executor": "x"}))
    out = workflow.run([polygons(spark, named).select("geom")], config)
    rows = sorted((r.parts, r.DegreeCent) for r in out.analysed.collect())
    assert rows == [(1, 1), (2, 1)] and out.edge_shapes.count() == 1 and config.extra == {"executor": "x"}
    assert urban_clusters().max_neighbours == 5


def test_streamed_tiles(spark, tmp_path):
    from geoweave.streaming import tiles

    layer = polygons(spark, {"big": box((0, 4), (4, 0)), "small": box((0, 1), (1, 0))})
    layer.write.parquet(str(tmp_path / "in"))
    s = tiles.filter_stream(tiles.stream_layer(spark, str(tmp_path / "in"), layer.schema), lambda g: A.polygon_area(g) >= 2)
    q = s.select("id").writeStream.format("memory").queryName("tiles").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert [r.id for r in spark.table("tiles").collect()] == ["big"]


def test_hull_and_outline():
    pts = np.random.default_rng(2).random((50, 2))
    hull = kernels.convex_hull(pts)
    assert (kernels.locate(pts, hull) != kernels.OUT).all()


def test_shortest_paths_do_not_end_silently_at_a_bound(spark):
    nodes = spark.range(1, 6).select("id")
    g = Graph(nodes, spark.createDataFrame([(i, i + 1) for i in range(1, 5)], "src long, dst long"), False)
    with pytest.raises(RuntimeError):
        GA.shortest_paths(g, 1, max_hops=3)
    for most in (4, None):
        assert sorted((r.id, r.hops) for r in GA.shortest_paths(g, 1, max_hops=most).collect()) == [(i, i - 1) for i in range(1, 6)]


def test_swept_closest_points_equal_brute_force():
    rng = np.random.default_rng(5)
    for n, m in ((24, 28), (116, 570), (300, 900), (3, 4000)):
        turn = lambda k: np.sort(rng.random(k)) * 2 * np.pi
        ring = lambda k, at: at + (1 + 0.5 * rng.random((k, 1))) * np.stack((np.cos(t := turn(k)), np.sin(t)), axis=1)
        for at in ((2.5, 0.3), (0.2, 9.0), (0.5, 0.5)):
            a, b = ring(n, np.zeros(2)), ring(m, np.array(at))
            swept, brute = kernels.closest_points_swept(a, b), kernels.closest_points_of_all(a, b)
            assert swept[0] == pytest.approx(brute[0], abs=1e-12)
            assert np.linalg.norm(swept[1] - swept[2]) == pytest.approx(swept[0], abs=1e-12)


def test_segments_in_polygons_with_holes():
    hole = np.array([(2.0, 8.0), (8.0, 8.0), (8.0, 2.0), (2.0, 2.0)])
    p = [np.array([(0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]), hole]
    inside = lambda *s: kernels.polygon_contains_segment(p, np.array(s))
    assert inside((1.0, 1.0), (9.0, 1.0)) and not inside((1.0, 1.0), (9.0, 9.0)) and not inside((1.0, 1.0), (11.0, 1.0))
    assert kernels.multi_contains_segment([[hole], p], np.array([(1.0, 1.0), (1.0, 9.0)]))


def test_search_tells_of_nodes_and_edges(spark):
    g = Graph(spark.range(1, 8).select("id"), spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5)], "src long, dst long"), True)
    told = []
    hooks = {k: (lambda d, k=k: told.append((k, d.count()))) for k in ("on_open", "on_edge", "on_close")}
    out = {r.id: (r.status, r.hops, r.parent) for r in GA.Search(**hooks, stop=lambda new: not new.where("id = 3").isEmpty()).run(g, 1).collect()}
    assert out == {1: ("closed", 0, None), 2: ("closed", 1, 1), 5: ("closed", 1, 1), 3: ("open", 2, 2), **{k: ("unknown", None, None) for k in (4, 6, 7)}}
    assert told == [("on_open", 1), ("on_edge", 2), ("on_close", 1), ("on_open", 2), ("on_edge", 1), ("on_close", 2), ("on_open", 1)]


def test_contraction_to_a_fixed_point(spark):
    g = Graph(spark.createDataFrame([(i, float(x)) for i, x in enumerate((0, 4, 7, 20, 40))], "id long, x double"), spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "src long, dst long"))

    def distance(graph):
        side = lambda e: graph.nodes.select(F.col("id").alias(e), F.col("x").alias(f"{e}_x"))
        return graph.edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", F.abs(F.col("src_x") - F.col("dst_x")).alias("distance"))

    out = GA.contract_to_fixed_point(g, distance, 17.0, [F.max("x").alias("x")])  # 20 is near enough only after the first merge
    assert sorted((r.id, r.x) for r in out.nodes.collect()) == [(0, 20.0), (4, 40.0)]


def test_jobs_run_in_order_and_can_be_resumed(spark):
    from geoweave.plans import jobs

    j, e = jobs.plan(spark, ["t_0_0", "t_0_1"], [("t_0_0", "t_0_1"), ("t_0_1", "t_0_0")], "COMPONENTS")
    done, fail, rounds = [], {("NEIGHBOURS", "t_0_1")}, []

    def work(kind, file):
        if (kind, file) in fail:
            raise RuntimeError("lost")
        done.append((kind, file))

    first = jobs.schedule(j, e, work, lambda d: rounds.append({r.state: r.n for r in jobs.count_by_state(d).collect()}))
    assert done == [("FILTER", "t_0_0"), ("FILTER", "t_0_1"), ("NEIGHBOURS", "t_0_0")] and rounds[-1] == {"FINISHED": 3, "FAILED": 1, "RUNNABLE": 1}
    fail.clear()
    jobs.schedule(first, e, work)
    assert done[3:] == [("NEIGHBOURS", "t_0_1"), ("COMPONENTS", "")] and jobs.next_id(j).first().job == 6


def test_workflow_from_shapefiles_to_shapefiles(spark, tmp_path):
    from geoweave.plans import workflow
    from geoweave.plans.config import WorkflowConfig
    from geoweave.sources import files

    step = 0.001
    named = {"a": box((10.0, 48.0 + step), (10.0 + step, 48.0)), "b": box((10.0 + 1.3 * step, 48.0 + step), (10.0 + 2.3 * step, 48.0)), "c": box((10.0 + 5 * step, 48.0 + step), (10.0 + 6 * step, 48.0))}
    layer = polygons(spark, named)
    files.overwrite(layer.where("id <> 'c'").coalesce(1), str(tmp_path / "in_0"))
    files.overwrite(layer.where("id = 'c'").coalesce(1), str(tmp_path / "in_1"))
    config = WorkflowConfig.from_json("""{
      "unary-filters": [{"name": "ApproxAreaFilter", "requiredArea": 1000}], "binary-filters": [{"name": "InsidePolygonFilter"}], "maxDistanceMeters": 300, "maxNeighbours": 3, "splits": 1,
      "neighbouring-predicates": [{"name": "DistanceBiPredicate", "distance": 300}], "contraction-predicates": [{"name": "DistanceBiPredicate", "distance": 50}],
      "centrality-measures": ["DegreeCentralityMeasure"], "visualize-edges": true}""")
    out = workflow.run_files(spark, [str(tmp_path / "in_0"), str(tmp_path / "in_1")], config, str(tmp_path / "out"))
    assert {"features", "clusters", "edges"} < set(out) and sum(k.startswith("tile_") for k in out) == 2
    clusters = spark.read.format("shapefile").option("geometry", "multi").load(out["clusters"])
    assert sorted((r.parts, r.DegreeCent, r.n) for r in clusters.select("parts", "DegreeCent", F.size("geom").alias("n")).collect()) == [(1, 1, 1), (2, 1, 2)]
    assert workflow.merge_stage(str(tmp_path / "out"), "tile_", spark).count() == 3
    assert workflow.merge_stage(str(tmp_path / "out"), "none", spark) is None
