"""Geometry expressions and kernels against hand-computed values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.functions import areal as A
from geoweave.functions import geodesy, kernels, predicates
from geoweave.functions import linear as N
from geoweave.functions import vectors as V


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def box(tl, br):
    return np.array([tl, (br[0], tl[1]), br, (tl[0], br[1])], float)


def rhombus(c, r):
    return np.array([(c[0], c[1] + r), (c[0] + r, c[1]), (c[0], c[1] - r), (c[0] - r, c[1])], float)


def ring(points):
    return F.array(*[V.point(float(x), float(y)) for x, y in points])


def test_geodesic_distance_golden(spark):
    a, b = V.point(13.4, 52.516666666666667), V.point(139.76666666666667, 35.7)
    r = one(spark, geodesy.wgs84_distance(a, b), geodesy.wgs84_distance(a, b, False), geodesy.wgs84_distance(a, a))
    assert r[0] == pytest.approx(8941202.50458698, abs=1e-4)
    assert r[1] == pytest.approx(8928954.1420394, abs=1e-4)
    assert np.isnan(r[2])


def test_projected_area_of_a_square_kilometre():
    square = np.array([(9.966929808562949, 49.78136164352572), (9.975970902326768, 49.78136164352572), (9.975970902326768, 49.790481800072), (9.966929808562949, 49.790481800072)])
    middle = np.radians(49.786)
    plain = (0.009041093763819 * np.cos(middle)) * 0.00912015654628 * (np.pi / 180 * geodesy.RADIUS) ** 2
    assert geodesy.projected_area([square]) == pytest.approx(plain, rel=2e-3)


def test_vectors_and_ranges(spark):
    r = one(spark, V.divide(V.point(2.0, 4.0), 0.0)["x"], V.normalize_range(F.lit(-1.0), 3.0), V.cantor_pair(F.lit(3), F.lit(5)), V.text(V.point(1.5, 2.0)), V.point(1e-9, 1.0)["x"])
    assert tuple(r) == (2.0, 2.0, 41, "(1.500000,2.000000)", 0.0)
    with pytest.raises(Exception, match="upper bound"):
        one(spark, V.normalize_range(F.lit(1.0), 0.0))


def test_segments(spark):
    s, t = N.segment(V.point(0.0, 0.0), V.point(2.0, 2.0)), N.segment(V.point(0.0, 2.0), V.point(2.0, 0.0))
    r = one(spark, N.segment_intersection(s, t)["x"], N.segment_distance(s, t), N.contains(s, V.point(3.0, 3.0)), N.line_intersection(s, s)["x"], N.segments_equal(s, N.flip(s)))
    assert r[0] == 1.0 and r[1] == pytest.approx(2**0.5) and r[2] is False and r[3] is None and r[4] is True


def test_ring_validity_and_location(spark):
    good, bow = ring([(0, 4), (2, 3), (2, 2), (4, 2), (2, 0), (-2, -1), (0, 1), (-3, 2)]), ring([(0, 0), (2, 2), (2, 0), (0, 2)])
    r = one(spark, A.is_valid_ring(good), A.is_valid_ring(bow), A.ring_location(good, V.point(0.0, 2.0)), A.ring_location(good, V.point(0.0, 4.0)), A.ring_location(good, V.point(9.0, 9.0)))
    assert tuple(r) == (True, False, "INSIDE", "BOUNDARY", "OUTSIDE")
    assert kernels.ring_valid(np.array([(0, 4), (2, 3), (2, 2), (4, 2), (2, 0), (-2, -1), (0, 1), (-3, 2)], float))
    assert not kernels.ring_valid(np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float))


def test_inside_filter_truth_table():
    b, t, r = [box((0, 4), (4, 0))], [np.array([(1, 1), (2, 2), (1, 2)], float)], [rhombus((4, 2), 2)]
    assert not predicates.inside_kernel(t, b)
    assert not predicates.inside_kernel(b, b)
    assert predicates.inside_kernel(r, b)


def test_polygon_predicates():
    outer, hole = box((0, 10), (10, 0)), box((2, 8), (8, 2))
    holed, inner = [outer, hole], [box((4, 6), (6, 4))]
    assert kernels.in_hole(holed, inner) and not kernels.polygon_contains(holed, inner)
    assert kernels.polygon_contains([outer], inner) and not kernels.polygon_contains(inner, [outer])
    assert kernels.polygon_distance(holed, inner) == pytest.approx(2.0)
    assert kernels.polygon_distance([outer], [box((13, 4), (15, 0))]) == pytest.approx(3.0)
    assert kernels.polygon_touches([outer], [box((10, 4), (15, 0))]) and kernels.polygon_distance([outer], [box((10, 4), (15, 0))]) == 0
    assert kernels.polygon_crosses([outer], [box((9, 4), (15, 0))])
    assert kernels.polygon_valid(holed) and not kernels.polygon_valid([hole, outer])
    assert not kernels.multi_valid([[outer], inner]) and kernels.multi_valid([[outer], [box((20, 30), (30, 20))]])


def test_closest_points_agree_with_sampling():
    rng = np.random.default_rng(3)
    for _ in range(10):
        a, b = kernels.convex_hull(rng.random((12, 2))), kernels.convex_hull(rng.random((12, 2)) + [2, 0.5])
        d, p, q = kernels.closest_points(a, b)
        fine = [x + (y - x) * t for r in (b,) for x, y in zip(r, np.roll(r, -1, axis=0)) for t in np.linspace(0, 1, 200)]
        brute = min(np.sqrt(kernels.nearest_on_edges(np.array(fine), *kernels.edges(a))[0].min()) for _ in range(1))
        assert d <= brute + 1e-12 and d == pytest.approx(brute, abs=1e-2) and np.hypot(*(p - q)) == pytest.approx(d)


def test_registries_reject_unknown_names():
    with pytest.raises(ValueError, match="unknown name"):
        predicates.unary_filter({"name": "NoFilter"})
    with pytest.raises(ValueError):
        geodesy.distance_function("")
