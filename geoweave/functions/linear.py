"""Segments, lines and rays as column expressions.

Segment and line: STRUCT<p, q>; ray: STRUCT<o, d>. An intersection that does not exist is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.functions import vectors as V
from geoweave.functions.constants import EPSILON, MAX_DOUBLE


def segment(p: Column, q: Column) -> Column:
    return F.struct(p.alias("p"), q.alias("q"))


def line(p: Column, q: Column) -> Column:
    same = F.raise_error(F.lit("a line needs two points"))
    return F.when(V.equals(p, q), same.cast("struct<p:struct<x:double,y:double>,q:struct<x:double,y:double>>")).otherwise(segment(p, q))


def line_of_slope(m: V.Num, t: V.Num) -> Column:
    return segment(V.point(0.0, t), V.point(1.0, V._c(m) + V._c(t)))


def vertical_line(x: V.Num) -> Column:
    return segment(V.point(x, 0.0), V.point(x, 1.0))


def horizontal_line(y: V.Num) -> Column:
    return segment(V.point(0.0, y), V.point(1.0, y))


def x_axis() -> Column:
    return horizontal_line(0.0)


def y_axis() -> Column:
    return vertical_line(0.0)


def ray(o: Column, d: Column) -> Column:
    return F.struct(o.alias("o"), d.alias("d"))


def ray_towards(o: Column, side: str) -> Column:
    x, y = {"up": (0, 1), "down": (0, -1), "left": (-1, 0), "right": (1, 0)}[side]
    return ray(o, V.point(x, y))


def ray_opposite(r: Column) -> Column:
    return ray(r["o"], V.negate(r["d"]))


def ray_line(r: Column) -> Column:
    return segment(r["o"], V.add(r["o"], r["d"]))


def direction(s: Column) -> Column:
    return V.subtract(s["q"], s["p"])


@V.bound
def is_vertical(ln: Column) -> Column:
    return V.close(ln["p"]["x"], ln["q"]["x"])


@V.bound
def slope(ln: Column) -> Column:
    dx = ln["q"]["x"] - ln["p"]["x"]
    return F.when(is_vertical(ln), F.lit(MAX_DOUBLE)).otherwise((ln["q"]["y"] - ln["p"]["y"]) / dx)


@V.bound
def y_intercept(ln: Column) -> Column:
    return F.when(is_vertical(ln), F.lit(None).cast("double")).otherwise(ln["p"]["y"] - slope(ln) * ln["p"]["x"])


def _along(base: Column, way: Column, p: Column) -> tuple[Column, Column]:
    """Whether p is on the line base + lambda * way, and lambda."""
    x, y = p["x"] - base["x"], p["y"] - base["y"]
    flat, steep = F.abs(way["x"]) < EPSILON, F.abs(way["y"]) < EPSILON
    lx, ly = x / F.when(flat, 1.0).otherwise(way["x"]), y / F.when(steep, 1.0).otherwise(way["y"])
    on = F.when(flat, F.abs(x) < EPSILON).when(steep, F.abs(y) < EPSILON).otherwise(V.close(lx, ly))
    return on, F.when(flat, ly).otherwise(lx)


@V.bound
def line_contains(ln: Column, p: Column) -> Column:
    return _along(ln["p"], direction(ln), p)[0]


@V.bound
def side_of(ln: Column, p: Column) -> Column:
    """Positive left of the line from p to q, negative right of it."""
    return V.cross(direction(ln), V.subtract(p, ln["p"]))


def is_left(ln: Column, p: Column) -> Column:
    return side_of(ln, p) > 0


def is_right(ln: Column, p: Column) -> Column:
    return side_of(ln, p) < 0


@V.bound
def lines_equal(a: Column, b: Column) -> Column:
    return line_contains(a, b["p"]) & line_contains(a, b["q"])


@V.bound
def ray_contains(r: Column, p: Column) -> Column:
    on, at = _along(r["o"], r["d"], p)
    return V.equals(r["o"], p) | (on & (at > 0))


@V.bound
def rays_equal(a: Column, b: Column) -> Column:
    return V.equals(a["o"], b["o"]) & V.equals(V.normalize(a["d"]), V.normalize(b["d"]))


@V.bound
def segment_length(s: Column) -> Column:
    return V.distance(s["p"], s["q"])


def is_valid(s: Column) -> Column:
    return segment_length(s) > 0


def flip(s: Column) -> Column:
    return segment(s["q"], s["p"])


@V.bound
def endpoint(s: Column, side: str) -> Column:
    """upper, lower, left or right endpoint; the other axis decides ties."""
    p, q = s["p"], s["q"]
    first = {
        "upper": ~V.before_yx(p, q), "lower": V.before_yx(p, q), "left": V.before_xy(p, q), "right": ~V.before_xy(p, q),
    }[side]
    return F.when(first, p).otherwise(q)


@V.bound
def contains(s: Column, p: Column) -> Column:
    on, at = _along(s["p"], direction(s), p)
    point_like = V.equals(s["p"], s["q"])
    return F.when(point_like, V.equals(s["p"], p)).otherwise(on & (at >= -EPSILON) & (at <= 1 + EPSILON))


def is_endpoint(s: Column, p: Column) -> Column:
    return V.equals(s["p"], p) | V.equals(s["q"], p)


def contains_segment(s: Column, t: Column) -> Column:
    return contains(s, t["p"]) & contains(s, t["q"])


@V.bound
def touches(s: Column, t: Column) -> Column:
    """An endpoint of one lies on the other."""
    return contains(s, t["p"]) | contains(s, t["q"]) | contains(t, s["p"]) | contains(t, s["q"])


@V.bound
def has_overlay(s: Column, t: Column) -> Column:
    """Parallel, and more than a point in common."""
    shared = F.array_distinct(
        F.filter(
            F.array(*[F.when(contains(a, p), p) for a, p in ((s, t["p"]), (s, t["q"]), (t, s["p"]), (t, s["q"]))]), lambda x: x.isNotNull()
        )
    )
    return V.is_parallel(direction(s), direction(t)) & (F.size(shared) > 1)


@V.bound
def canonical(s: Column) -> Column:
    return F.struct(F.least(s["p"], s["q"]).alias("p"), F.greatest(s["p"], s["q"]).alias("q"))


@V.bound
def segments_equal(a: Column, b: Column) -> Column:
    return (V.equals(a["p"], b["p"]) & V.equals(a["q"], b["q"])) | (V.equals(a["p"], b["q"]) & V.equals(a["q"], b["p"]))


@V.bound
def closest_on_segment(s: Column, p: Column) -> Column:
    return _at(s, direction(s), p)


@V.bound
def _at(s: Column, d: Column, p: Column) -> Column:
    size = V.dot(d, d)
    share = V.dot(V.subtract(p, s["p"]), d) / F.when(size == 0, 1.0).otherwise(size)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(size == 0, F.lit(0.0)).otherwise(share)))
    return V.raw(s["p"]["x"] + t * d["x"], s["p"]["y"] + t * d["y"])


@V.bound
def point_distance(s: Column, p: Column) -> Column:
    return _measured(closest_on_segment(s, p), p)["d"]


@V.bound
def segment_distance(s: Column, t: Column) -> Column:
    """Least of the four endpoint distances; segments that cross are not at distance zero."""
    return F.least(point_distance(s, t["p"]), point_distance(s, t["q"]), point_distance(t, s["p"]), point_distance(t, s["q"]))


@V.bound
def closest_points(s: Column, t: Column) -> Column:
    """STRUCT<d, a, b>: the pair of least distance between an endpoint and the other segment."""
    pairs = [(closest_on_segment(s, t["p"]), t["p"]), (closest_on_segment(s, t["q"]), t["q"]), (s["p"], closest_on_segment(t, s["p"])), (s["q"], closest_on_segment(t, s["q"]))]
    return F.array_min(F.array(*[_measured(a, b) for a, b in pairs]))


@V.bound
def _measured(a: Column, b: Column) -> Column:
    return F.struct(V.distance(a, b).alias("d"), a.alias("a"), b.alias("b"))


@V.bound
def are_parallel(a: Column, b: Column) -> Column:
    return V.is_parallel(direction(a), direction(b))


@V.bound
def line_intersection(a: Column, b: Column) -> Column:
    """Common point of two lines; null for parallel ones, equal ones included."""
    return _meet(a, direction(a), b, direction(b))


@V.bound
def _meet(a: Column, da: Column, b: Column, db: Column) -> Column:
    det = V.cross(da, db)
    share = V.cross(V.subtract(b["p"], a["p"]), db) / F.when(F.abs(det) < EPSILON, None).otherwise(det)
    return V.bound(lambda t, a, da: F.when(t.isNotNull(), V.raw(a["p"]["x"] + t * da["x"], a["p"]["y"] + t * da["y"])))(share, a, da)


@V.bound
def segment_intersection(a: Column, b: Column) -> Column:
    on_both = V.bound(lambda p, s, t: F.when(p.isNotNull() & contains(s, p) & contains(t, p), p))
    return on_both(line_intersection(a, b), a, b)


@V.bound
def ray_segment_intersection(r: Column, s: Column) -> Column:
    on_both = V.bound(lambda p, o, t: F.when(p.isNotNull() & ray_contains(o, p) & contains(t, p), p))
    return on_both(line_intersection(ray_line(r), s), r, s)


def intersects(a: Column, b: Column) -> Column:
    return segment_intersection(a, b).isNotNull()


def segment_text(s: Column) -> Column:
    return F.concat(V.text(s["p"]), F.lit("--"), V.text(s["q"]))
