"""Metric distances and areas of points and rings in degrees (x: longitude, y: latitude)."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.functions import vectors as V

#: Fixed values of the WGS 84 ellipsoid.
RADIUS, FLATTENING = 6378137.0, 1.0 / 298.257223563


def wgs84_distance(a: Column, b: Column, exact: bool = True) -> Column:
    """Great-circle distance in metres with Lambert's correction for flattening; NaN for equal points."""
    rad = lambda d: d * (pi / 180.0)
    mean, half, turn = rad((a["y"] + b["y"]) / 2), rad((a["y"] - b["y"]) / 2), rad((a["x"] - b["x"]) / 2)
    sq = lambda f, v: F.pow(f(v), F.lit(2.0))
    s = sq(F.sin, half) * sq(F.cos, turn) + sq(F.cos, mean) * sq(F.sin, turn)
    c = sq(F.cos, half) * sq(F.cos, turn) + sq(F.sin, mean) * sq(F.sin, turn)
    w = F.atan(F.sqrt(s / c))
    plain = 2 * w * RADIUS
    if not exact:
        return F.when(s == 0, F.lit(float("nan"))).otherwise(plain)
    t = F.sqrt(s * c) / F.when(w == 0, None).otherwise(w)
    h1, h2 = (3 * t - 1) / (2 * c), (3 * t + 1) / (2 * F.when(s == 0, None).otherwise(s))
    corrected = plain * (1 + FLATTENING * h1 * sq(F.sin, mean) * sq(F.cos, half) - FLATTENING * h2 * sq(F.cos, mean) * sq(F.sin, half))
    return F.when(s == 0, F.lit(float("nan"))).otherwise(corrected)


def eckert_iv(points: np.ndarray, meridian: float) -> np.ndarray:
    """Equal-area projection in metres, by Newton's method on its auxiliary angle."""
    lam, phi = np.radians(points[:, 0] - meridian), np.radians(points[:, 1])
    goal = (2 + pi / 2) * np.sin(phi)
    theta = phi / 2
    for _ in range(50):
        f = theta + np.sin(theta) * np.cos(theta) + 2 * np.sin(theta) - goal
        slope = 2 * np.cos(theta) * (1 + np.cos(theta))
        step = f / np.where(np.abs(slope) < 1e-12, 1e-12, slope)
        theta = theta - step
        if np.abs(step).max() < 1e-14:
            break
    x = 2 / np.sqrt(pi * (4 + pi)) * lam * (1 + np.cos(theta))
    y = 2 * np.sqrt(pi / (4 + pi)) * np.sin(theta)
    return RADIUS * np.column_stack((x, y))


def projected_ring_area(ring: np.ndarray) -> float:
    p = eckert_iv(ring, float(ring[:, 0].mean()))
    q = np.roll(p, -1, axis=0)
    return float(abs((p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum()) / 2)


def projected_area(polygon: list[np.ndarray]) -> float:
    """Square metres; each ring is projected on the meridian of its own centroid."""
    return projected_ring_area(polygon[0]) - sum(map(projected_ring_area, polygon[1:]))


def distance_function(crs: str):
    """Distance of two points by the kind of reference system: projected or local, or geographic."""
    if crs in ("projected", "local"):
        return V.distance
    if crs == "geographic":
        return wgs84_distance
    raise ValueError("the layer has no spatial reference")
