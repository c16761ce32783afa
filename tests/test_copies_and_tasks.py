"""Layers are dealt to many tasks, and what only a shape decides is told once for its copies."""

import numpy as np
from pyspark.sql import functions as F

from geoweave.functions import areal as A
from geoweave.functions import hulls, kernels
from geoweave.operators import arrangement, spatial_join
from geoweave.plans import layers_from_tables as T
from geoweave.plans.tiles import TileNeighbours


def test_a_table_of_one_file_is_many_tasks(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.range(200).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{at}/part.parquet")
    for layer in (T.parcels, T.lots):
        rows = layer(spark, at)
        assert rows.select(F.spark_partition_id().alias("t")).distinct().count() > 1 and rows.count() == 200


def test_equal_shapes_are_told_once():
    asked = []
    kernel = kernels.told_once(lambda v: asked.append(v) or len(v))
    a, b = np.arange(6.0).reshape(3, 2), np.arange(2.0).reshape(1, 2)
    assert [kernel([a]), kernel([a.copy()]), kernel([a[:1], a[1:]]), kernel([a, b])] == [1, 1, 2, 2] and len(asked) == 3


def test_corners_only_are_not_triangulated(monkeypatch):
    monkeypatch.setattr(hulls, "delaunay", lambda p: 1 / 0)
    square = np.array([[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]])
    assert hulls.concave_hull(square[::-1], 0.3)[0].tolist() == square.tolist()


def _counting(monkeypatch, module):
    paired, keep = [], spatial_join.box_pairs
    monkeypatch.setattr(module, "box_pairs", lambda df, *a, **b: paired.append(df.count()) or keep(df, *a, **b))
    return paired


def test_equal_boxes_of_a_tile_are_paired_once(spark, tmp_path, monkeypatch):
    paired = _counting(monkeypatch, spatial_join)
    work = TileNeighbours(spark, f"file://{tmp_path}/w", 1.0)
    box = F.expr("named_struct('xmin', 0.0D, 'ymin', 0.0D, 'xmax', 1.0D, 'ymax', 1.0D)").alias("box")
    work.arrive("t_0_0.shp", spark.range(60).select("id", box))
    work.arrive("t_1_0.shp", spark.range(60, 100).select("id", box))
    assert paired == [1, 2]
    rows = [(r.a, r.b) for r in work.pairs().collect()]
    assert len(rows) == 100 * 99 // 2 and set(rows) == {(a, b) for a in range(100) for b in range(a + 1, 100)}


def test_equal_segments_are_crossed_once(spark, monkeypatch):
    paired = _counting(monkeypatch, arrangement)
    point = "struct<x:double,y:double>"
    lines = [(i, (0.0, 0.0), (2.0, 2.0)) if i % 2 else (i, (0.0, 1.0), (2.0, 1.0)) for i in range(40)]
    got = arrangement.crossings(spark.createDataFrame(lines, f"id long, p {point}, q {point}")).collect()
    assert paired == [2] and {(r.a, r.b) for r in got} == {(a, b) for a in range(40) for b in range(a + 1, 40) if (a + b) % 2} and len(got) == 400
    assert all(abs(r.x - 1) < 1e-6 and abs(r.y - 1) < 1e-6 for r in got)


def _squares(spark, rows):
    """(group, part, x, y, side) as polygons."""
    df = spark.createDataFrame(rows, "group long, part long, x double, y double, s double")
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    return df.select("group", "part", A.polygon(A.box_ring(x, y, x + s, y + s)).alias("geom"))


def _split(monkeypatch):
    """How many shapes had their edges taken."""
    taken, keep = [], arrangement.directed_edges
    monkeypatch.setattr(arrangement, "directed_edges", lambda shapes, *a, **b: taken.append(shapes.count()) or keep(shapes, *a, **b))
    return taken


def test_equal_polygons_are_split_once_and_counted_all(spark, monkeypatch):
    taken = _split(monkeypatch)
    layer = _squares(spark, [(1, i, 0.0, 0.0, 4.0) for i in range(3)] + [(1, 3 + i, 2.0, 2.0, 4.0) for i in range(2)])
    covered = arrangement.covered_pieces(layer).collect()
    assert taken == [2] and {frozenset((r.left, r.right)) for r in covered} == {frozenset(p) for p in ((0, 3), (0, 2), (3, 5), (2, 5))}


def test_outlines_of_copies_are_those_of_one(spark, monkeypatch):
    taken = _split(monkeypatch)
    one = [(1, 0, 0.0, 0.0, 2.0), (1, 1, 5.0, 1.0, 2.0), (2, 2, 0.0, 0.0, 1.0)]
    rows = lambda layer: sorted((r.group, r.place, round(r.area, 6), len(r.ring)) for r in arrangement.extended_outlines(layer).collect())
    assert rows(_squares(spark, one + [(g, p + 10 * k, x, y, s) for k in (1, 2) for g, p, x, y, s in one])) == rows(_squares(spark, one)) and taken == [3, 3]


def test_only_near_points_of_a_query_are_sorted(spark, monkeypatch):
    """All points were sorted for each query."""
    ranked, keep = [], spatial_join.top_k
    monkeypatch.setattr(spatial_join, "top_k", lambda rows, *a: ranked.append(rows.count()) or keep(rows, *a))
    points = spark.range(2000).selectExpr("id", "cast(id * 37 % 2003 AS double) AS x", "0.0D AS y")
    queries = spark.createDataFrame([(1, 500.0, 0.0), (2, 0.5, 3.0)], "qid long, qx double, qy double")
    got = {(r.qid, r["rank"]): (r.distance, r.id) for r in spatial_join.nearest_of(queries, points, 2).collect()}
    sites, want = [(i, float(i * 37 % 2003)) for i in range(2000)], {}
    for q, x, y in ((1, 500.0, 0.0), (2, 0.5, 3.0)):
        best = sorted((((px - x) ** 2 + y * y) ** 0.5, i) for i, px in sites if (px, y) != (x, 0.0))[:2]
        want |= {(q, n + 1): b for n, b in enumerate(best)}
    assert got == want and ranked[0] < 200


def test_what_a_kind_decides_is_told_once(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3, 0.5) for i in range(60)], "id long, k long, x double")
    told = []
    got = T.told_by_kind(rows, ["k", "x"], lambda kinds: told.append(kinds.count()) or kinds.select("k", "x", (F.coalesce("k", F.lit(9)) + F.col("x")).alias("y"))).collect()
    assert told == [3] and sorted((r.id, r.k, r.y) for r in got) == [(i, None if i % 3 == 0 else i % 3, (i % 3 or 9) + 0.5) for i in range(60)]
