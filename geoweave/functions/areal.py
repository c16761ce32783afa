"""Rings, rectangles, polygons and multi-polygons as column expressions.

Ring: ARRAY<STRUCT<x, y>>, open (the first vertex is not repeated). Polygon: STRUCT<boundary, holes>.
Multi-polygon: ARRAY<polygon>. Rectangle: STRUCT<xmin, ymin, xmax, ymax>.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.functions import linear as N
from geoweave.functions import vectors as V
from geoweave.functions.constants import EPSILON, ID_MODULUS

RING = "array<struct<x:double,y:double>>"
POLYGON = f"struct<boundary:{RING},holes:array<{RING}>>"
INSIDE, BOUNDARY, OUTSIDE = "INSIDE", "BOUNDARY", "OUTSIDE"


def ring(*points: Column) -> Column:
    return F.array(*points)


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners from the top left clockwise."""
    return F.array(V.point(x0, y1), V.point(x1, y1), V.point(x1, y0), V.point(x0, y0))


def polygon(boundary: Column, *holes: Column) -> Column:
    empty = F.array().cast(f"array<{RING}>")
    return F.struct(boundary.alias("boundary"), (F.array(*holes) if holes else empty).alias("holes"))


def next_point(r: Column, i: Column) -> Column:
    return F.get(r, (i + 1) % F.size(r))


@V.bound
def segments(r: Column) -> Column:
    return F.transform(r, lambda p, i: F.struct(p.alias("p"), next_point(r, i).alias("q")))


@V.bound
def ring_from_points(points: Column) -> Column:
    """Drop repeated vertices, the closing one included; the first of equals stays."""
    return F.filter(points, lambda p, i: F.forall(F.slice(points, 1, i), lambda q: ~V.equals(p, q)))


def _sum(items: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + f(x))


@V.bound
def signed_area(r: Column) -> Column:
    return _sum(segments(r), lambda s: V.cross(s["p"], s["q"])) * 0.5


def ring_area(r: Column) -> Column:
    return F.abs(signed_area(r))


@V.bound
def polygon_area(p: Column) -> Column:
    return ring_area(p["boundary"]) - _sum(p["holes"], ring_area)


def multi_area(m: Column) -> Column:
    return _sum(m, polygon_area)


@V.bound
def ring_centroid(r: Column) -> Column:
    """Mean of the vertices."""
    return V.raw(_sum(r, lambda p: p["x"]) / F.size(r), _sum(r, lambda p: p["y"]) / F.size(r))


def _weighted(parts: Column, area: Callable, centre: Callable) -> tuple[Column, Column, Column]:
    return _sum(parts, area), _sum(parts, lambda r: centre(r)["x"] * area(r)), _sum(parts, lambda r: centre(r)["y"] * area(r))


@V.bound
def polygon_centroid(p: Column) -> Column:
    """Vertex means of the rings weighted by area, holes counting negative."""
    mean = V.bound(lambda b, a, h, hx, hy: V.raw((b["x"] * a - hx) / (a - h), (b["y"] * a - hy) / (a - h)))
    return mean(ring_centroid(p["boundary"]), ring_area(p["boundary"]), *_weighted(p["holes"], ring_area, ring_centroid))


@V.bound
def multi_centroid(m: Column) -> Column:
    a, x, y = _weighted(m, polygon_area, polygon_centroid)
    return V.raw(x / a, y / a)


@V.bound
def ring_box(r: Column) -> Column:
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return rectangle(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def multi_box(m: Column) -> Column:
    return ring_box(F.flatten(F.transform(m, lambda p: p["boundary"])))


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"))


@V.bound
def scale_rectangle(r: Column, f: V.Num) -> Column:
    """Each side moves out by the extent times f - 1; factors of zero and less change nothing."""
    k = F.when(V._c(f) <= 0, F.lit(0.0)).otherwise(V._c(f) - 1)
    dx, dy = (r["xmax"] - r["xmin"]) * k, (r["ymax"] - r["ymin"]) * k
    return rectangle(r["xmin"] - dx, r["ymin"] - dy, r["xmax"] + dx, r["ymax"] + dy)


@V.bound
def overlap(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def rectangle_contains(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmin"]) & (a["xmax"] >= b["xmax"]) & (a["ymin"] <= b["ymin"]) & (a["ymax"] >= b["ymax"])


@V.bound
def _crossings(r: Column, p: Column) -> Column:
    """Edges that a ray to the right of p meets; an edge owns its upper end only."""
    def meets(s: Column) -> Column:
        a, b = s["p"], s["q"]
        spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
        dy = F.when(b["y"] == a["y"], 1.0).otherwise(b["y"] - a["y"])
        return spans & (a["x"] + (p["y"] - a["y"]) * (b["x"] - a["x"]) / dy > p["x"])

    return F.size(F.filter(segments(r), meets))


@V.bound
def ring_location(r: Column, p: Column) -> Column:
    on = F.exists(segments(r), lambda s: N.contains(s, p))
    return F.when(on, BOUNDARY).when(_crossings(r, p) % 2 == 1, INSIDE).otherwise(OUTSIDE)


@V.bound
def polygon_location(g: Column, p: Column) -> Column:
    """Inside a hole is outside; the border of a hole is inside."""
    in_hole = F.exists(g["holes"], lambda h: ring_location(h, p) == INSIDE)
    return F.when(in_hole, OUTSIDE).otherwise(ring_location(g["boundary"], p))


def polygon_contains_point(g: Column, p: Column) -> Column:
    return polygon_location(g, p) != OUTSIDE


def multi_contains_point(m: Column, p: Column) -> Column:
    return F.exists(m, lambda g: polygon_contains_point(g, p))


def multi_outside(m: Column, p: Column) -> Column:
    return F.forall(m, lambda g: polygon_location(g, p) == OUTSIDE)


@V.bound
def ring_intersections(r: Column, s: Column) -> Column:
    """Distinct points that the ring's edges and a segment have in common."""
    found = F.transform(segments(r), lambda e: N.segment_intersection(e, s))
    rounded = F.transform(F.filter(found, lambda p: p.isNotNull()), lambda p: F.struct(F.round(p["x"], 8).alias("x"), F.round(p["y"], 8).alias("y")))
    return F.array_sort(F.array_distinct(rounded))


@V.bound
def polygon_intersections(g: Column, s: Column) -> Column:
    holes = F.flatten(F.transform(g["holes"], lambda h: ring_intersections(h, s)))
    return F.array_sort(F.array_distinct(F.concat(ring_intersections(g["boundary"], s), holes)))


@V.bound
def is_valid_ring(r: Column) -> Column:
    """At least three edges, none of length zero, and edges that meet only at shared ends."""
    return _chained(segments(r), F.size(r))


@V.bound
def _chained(segs: Column, n: Column) -> Column:
    def clash(i: Column, j: Column) -> Column:
        beside = (j == i + 1) | ((i == 0) & (j == n - 1))
        wrong = V.bound(lambda a, b, near: F.when(near, N.has_overlay(a, b)).otherwise(N.touches(a, b) | N.intersects(a, b)))
        return wrong(F.get(segs, i), F.get(segs, j), beside)

    pairs = lambda i: F.exists(F.sequence(F.least(i + 1, n - 1), n - 1), lambda j: (j > i) & clash(i, j))
    simple = ~F.exists(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), pairs)
    return (n >= 3) & F.forall(segs, N.is_valid) & simple


def is_simple(p: Column) -> Column:
    return F.size(p["holes"]) == 0


def to_simple(p: Column) -> Column:
    return polygon(p["boundary"])


@V.bound
def canonical_ring(r: Column) -> Column:
    """Eight decimals, from the least vertex on, towards its lesser neighbour: equal for equal rings."""
    q = F.transform(r, lambda p: F.struct(F.round(p["x"], 8).alias("x"), F.round(p["y"], 8).alias("y")))
    at = V.bound(lambda a, k: F.concat(F.slice(a, k, F.size(a)), F.slice(a, 1, k - 1)))
    turn = V.bound(lambda a: at(a, F.array_position(a, F.array_min(a)).cast("int")))
    least = V.bound(lambda a: F.when(F.size(a) == 0, a).otherwise(F.array_min(F.array(turn(a), turn(F.reverse(a))))))
    return least(q)


@V.bound
def canonical_polygon(p: Column) -> Column:
    return F.struct(canonical_ring(p["boundary"]).alias("boundary"), F.array_sort(F.transform(p["holes"], canonical_ring)).alias("holes"))


def canonical_multi(m: Column) -> Column:
    return F.array_sort(F.transform(m, canonical_polygon))


def geometry_id(canonical: Column) -> Column:
    """Identifier below 10^18: the same for the same geometry."""
    return F.pmod(F.xxhash64(canonical), F.lit(ID_MODULUS).cast("long"))


def ring_text(r: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(r, V.text), ","), F.lit("]"))


@V.bound
def polygon_text(p: Column) -> Column:
    holes = F.array_join(F.transform(p["holes"], ring_text), ",")
    return F.concat(F.lit("{"), ring_text(p["boundary"]), F.when(F.size(p["holes"]) > 0, F.concat(F.lit(","), holes)).otherwise(""), F.lit("}"))


def multi_text(m: Column) -> Column:
    return F.concat(F.lit("<"), F.array_join(F.transform(m, polygon_text), ","), F.lit(">"))


def promote(p: Column) -> Column:
    """A polygon as a multi-polygon of one part."""
    return F.array(p)


def add_part(m: Column, p: Column, valid: Column) -> Column:
    return F.when(valid, F.array_append(m, p)).otherwise(m)


def remove_part(m: Column, p: Column) -> Column:
    return F.filter(m, lambda x: canonical_polygon(x) != canonical_polygon(p))


TOLERANCE = EPSILON
