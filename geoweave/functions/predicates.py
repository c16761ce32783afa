"""Named filters and predicates, as configurations refer to them, and their combinations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from geoweave.functions import areal as A
from geoweave.functions import geodesy, kernels
from geoweave.functions import vectors as V


def all_of(*predicates: Callable[..., Column]) -> Callable[..., Column]:
    """Conjunction; true if there is no predicate."""
    return lambda *x: reduce(and_, [p(*x) for p in predicates], F.lit(True))


def any_of(*predicates: Callable[..., Column]) -> Callable[..., Column]:
    """Disjunction; false if there is no predicate."""
    return lambda *x: reduce(or_, [p(*x) for p in predicates], F.lit(False))


def always(*_: Column) -> Column:
    return F.lit(True)


def never(*_: Column) -> Column:
    return F.lit(False)


def identity(x: Column) -> Column:
    return x


def approx_area(polygon: Column) -> Column:
    """Square metres by the metres per degree along the first edge."""
    first = F.get(A.segments(polygon["boundary"]), F.lit(0))
    per_degree = geodesy.wgs84_distance(first["p"], first["q"]) / V.distance(first["p"], first["q"])
    return A.polygon_area(polygon) * per_degree * per_degree


def approx_area_filter(required: float) -> Callable[[Column], Column]:
    return lambda p: approx_area(p) >= required


def projected_area_filter(required: float) -> Callable[[Column], Column]:
    area = kernels.unary_udf(geodesy.projected_area, "polygon", DoubleType())
    return lambda p: area(p) >= required


def inside_kernel(p: list, q: list) -> bool:
    return not kernels.same_polygon(p, q) and not kernels.polygon_contains(q, p) and not kernels.in_hole(q, p)


def inside_polygon_filter() -> Callable[[Column, Column], Column]:
    """True if p is neither equal to q nor contained in it or in one of its holes."""
    return kernels.pair_udf(inside_kernel, "polygon", "polygon")


def distance_predicate(limit: float, crs: str = "projected") -> Callable[[Column], Column]:
    """On STRUCT<d, a, b> of closest points: equal points, or a metric distance within the limit."""
    f = geodesy.distance_function(crs)
    return lambda c: V.equals(c["a"], c["b"]) | F.coalesce(f(c["a"], c["b"]) <= limit, F.lit(False))


UNARY = {"ApproxAreaFilter": lambda c: approx_area_filter(float(c["requiredArea"])), "ProjectedAreaFilter": lambda c: projected_area_filter(float(c["requiredArea"]))}
BINARY = {"InsidePolygonFilter": lambda c: inside_polygon_filter()}
#: Configurations name the limit distance; maxDistanceMeters is read too.
NEIGHBOUR = {"DistanceBiPredicate": lambda c, crs: distance_predicate(float(c["distance"] if "distance" in c else c["maxDistanceMeters"]), crs)}


def unary_filter(config: dict) -> Callable[[Column], Column]:
    return _named(UNARY, config)(config)


def binary_filter(config: dict) -> Callable[[Column, Column], Column]:
    return _named(BINARY, config)(config)


def neighbour_predicate(config: dict, crs: str) -> Callable[[Column], Column]:
    return _named(NEIGHBOUR, config)(config, crs)


def _named(registry: dict, config: dict) -> Callable:
    if config.get("name") not in registry:
        raise ValueError(f"unknown name {config.get('name')!r}; known are {sorted(registry)}")
    return registry[config["name"]]
