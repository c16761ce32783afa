"""Well-known binary of points, rings (as line strings), polygons and multi-polygons, and Arrow UDFs over it."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from geoweave.functions import kernels

#: Type codes of the format.
POINT, LINE, POLYGON, MULTIPOLYGON = 1, 2, 3, 6


def _points(data: bytes, at: int, order: str) -> tuple[np.ndarray, int]:
    (n,) = struct.unpack_from(order + "I", data, at)
    return np.frombuffer(data, order + "f8", 2 * n, at + 4).reshape(-1, 2).astype(np.float64), at + 4 + 16 * n


def _open(ring: np.ndarray) -> np.ndarray:
    return ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring


def decode(data: bytes, at: int = 0):
    """(type code, value, end); rings are open. Other types are an error."""
    order = "<" if data[at] else ">"
    (kind,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if kind == POINT:
        return kind, np.frombuffer(data, order + "f8", 2, at).astype(np.float64), at + 16
    if kind == LINE:
        ring, at = _points(data, at, order)
        return kind, _open(ring), at
    if kind == POLYGON:
        (n,) = struct.unpack_from(order + "I", data, at)
        rings, at = [], at + 4
        for _ in range(n):
            ring, at = _points(data, at, order)
            rings.append(_open(ring))
        return kind, rings, at
    if kind == MULTIPOLYGON:
        (n,) = struct.unpack_from(order + "I", data, at)
        parts, at = [], at + 4
        for _ in range(n):
            _, rings, at = decode(data, at)
            parts.append(rings)
        return kind, parts, at
    raise ValueError(f"geometry type {kind} is not supported")


def _ring_bytes(ring: np.ndarray) -> bytes:
    closed = np.concatenate((ring, ring[:1]))
    return struct.pack("<I", len(closed)) + closed.astype("<f8").tobytes()


def encode_polygon(rings: list[np.ndarray]) -> bytes:
    return struct.pack("<BII", 1, POLYGON, len(rings)) + b"".join(map(_ring_bytes, rings))


def encode_multi(parts: list[list[np.ndarray]]) -> bytes:
    return struct.pack("<BII", 1, MULTIPOLYGON, len(parts)) + b"".join(map(encode_polygon, parts))


def encode_point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, POINT, x, y)


def encode_ring(ring: np.ndarray) -> bytes:
    return struct.pack("<BI", 1, LINE) + _ring_bytes(ring)


def clean_polygon(rings: list[np.ndarray]) -> list[np.ndarray] | None:
    """None if the boundary is not a valid ring; invalid holes are dropped."""
    if not rings or not kernels.ring_valid(rings[0]):
        return None
    return [rings[0], *(h for h in rings[1:] if kernels.ring_valid(h) and kernels.ring_contains(rings[0], h))]


def as_struct(rings: list[np.ndarray]) -> dict:
    ring = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    return {"boundary": ring(rings[0]), "holes": [ring(h) for h in rings[1:]]}


RING_ARROW = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
POLYGON_ARROW = pa.struct([("boundary", RING_ARROW), ("holes", pa.list_(RING_ARROW))])
POLYGON_DDL = "boundary array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"


def polygon_to_wkb(polygon: Column) -> Column:
    @F.arrow_udf(BinaryType())
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if v is None else encode_polygon([np.array(r).reshape(-1, 2) for r in v]) for v in a.to_pylist()], pa.binary())

    return run(kernels.flat_polygon(polygon))


def polygon_from_wkb(wkb: Column) -> Column:
    """Null for other types and for invalid boundaries."""

    @F.arrow_udf(StructType.fromDDL(POLYGON_DDL))
    def run(a: pa.Array) -> pa.Array:
        out = []
        for v in a.to_pylist():
            kind, value, _ = decode(v) if v is not None else (0, None, 0)
            rings = clean_polygon(value) if kind == POLYGON else None
            out.append(as_struct(rings) if rings else None)
        return pa.array(out, POLYGON_ARROW)

    return run(wkb)
