"""Points, vectors and angles as column expressions over STRUCT<x: DOUBLE, y: DOUBLE>."""

from __future__ import annotations

from functools import wraps
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.functions.constants import EPSILON

Num = Column | float | int


def _c(v: Num) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def snap(v: Num) -> Column:
    """Components within the tolerance of zero are zero."""
    v = _c(v)
    return F.when(F.abs(v) < EPSILON, F.lit(0.0)).otherwise(v.cast("double"))


def point(x: Num, y: Num) -> Column:
    return F.struct(snap(x).alias("x"), snap(y).alias("y"))


def raw(x: Column, y: Column) -> Column:
    """A point from computed components; snapping is left to constructed points, and comparisons are tolerant."""
    return F.struct(x.alias("x"), y.alias("y"))


def bound(f):
    """Evaluate the column arguments of f once: a lambda binds them, so nested calls do not multiply the expression."""

    @wraps(f)
    def run(*args, **kwargs):
        cols = [a for a in args if isinstance(a, Column)]

        def body(v: Column) -> Column:
            at = iter(range(len(cols)))
            return f(*[v[f"c{next(at)}"] if isinstance(a, Column) else a for a in args], **kwargs)

        return F.get(F.transform(F.array(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)])), body), F.lit(0))

    return run


def add(a: Column, b: Column) -> Column:
    return raw(a["x"] + b["x"], a["y"] + b["y"])


def subtract(a: Column, b: Column) -> Column:
    return raw(a["x"] - b["x"], a["y"] - b["y"])


def negate(a: Column) -> Column:
    return raw(-a["x"], -a["y"])


def scale(a: Column, s: Num) -> Column:
    return raw(a["x"] * _c(s), a["y"] * _c(s))


def divide(a: Column, s: Num) -> Column:
    """Division by zero leaves the vector as it is."""
    d = F.when(_c(s) == 0, F.lit(1.0)).otherwise(_c(s))
    return raw(a["x"] / d, a["y"] / d)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"]


def cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - a["y"] * b["x"]


def is_parallel(a: Column, b: Column) -> Column:
    return F.abs(cross(a, b)) < EPSILON


def is_orthogonal(a: Column, b: Column) -> Column:
    return F.abs(dot(a, b)) < EPSILON


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.sqrt(dx * dx + dy * dy)


def orthogonal(a: Column) -> Column:
    return raw(a["y"], -a["x"])


@bound
def normalize(a: Column) -> Column:
    return divide(a, length(a))


def angle_to(a: Column, ref: Column, rotation: Num = 0.0) -> Column:
    """Angle of a seen from ref, turned by rotation, in [0, 2 pi)."""
    return F.pmod(F.atan2(a["y"] - ref["y"], a["x"] - ref["x"]) + _c(rotation), F.lit(2 * pi))


def close(a: Num, b: Num) -> Column:
    return F.abs(_c(a) - _c(b)) < EPSILON


def equals(a: Column, b: Column) -> Column:
    return close(a["x"], b["x"]) & close(a["y"], b["y"])


def text(a: Column) -> Column:
    return F.format_string("(%f,%f)", a["x"], a["y"])


def before_xy(a: Column, b: Column) -> Column:
    """Lexicographic order by x, then y; x decides only beyond the tolerance."""
    return F.when(close(a["x"], b["x"]), a["y"] < b["y"]).otherwise(a["x"] < b["x"])


def before_yx(a: Column, b: Column) -> Column:
    return F.when(close(a["y"], b["y"]), a["x"] < b["x"]).otherwise(a["y"] < b["y"])


def normalize_range(v: Num, upper: Num, lower: Num | None = None) -> Column:
    """Into [0, upper), or with lower: pmod(v + lower, upper - lower) + lower. An empty range is an error."""
    v, ub = _c(v), _c(upper)
    if lower is None:
        return F.when(ub <= 0, F.raise_error(F.lit("the upper bound must be positive")).cast("double")).otherwise(F.pmod(v, ub))
    lb = _c(lower)
    bad = F.raise_error(F.lit("the upper bound must be above the lower")).cast("double")
    return F.when(ub <= lb, bad).otherwise(F.pmod(v + lb, ub - lb) + lb)


def _angle(v: Num, full: float) -> Column:
    v = _c(v)
    return F.when(F.isnan(v), F.raise_error(F.lit("an angle must be a number")).cast("double")).otherwise(F.pmod(v, F.lit(full)))


def radians(v: Num) -> Column:
    return _angle(v, 2 * pi)


def degrees(v: Num) -> Column:
    return _angle(v, 360.0)


def to_degrees(rad: Column) -> Column:
    return degrees(rad * (180.0 / pi))


def to_radians(deg: Column) -> Column:
    return radians(deg * (pi / 180.0))


def angle_add(a: Column, b: Num, full: float = 2 * pi) -> Column:
    return _angle(a + _c(b), full)


def angle_subtract(a: Column, b: Num, full: float = 2 * pi) -> Column:
    return _angle(a - _c(b), full)


def cantor_pair(x: Column, y: Column) -> Column:
    s = x.cast("long") + y.cast("long")
    return F.floor((s * (s + 1)) / 2).cast("long") + y.cast("long")
