"""Exact polygon predicates and distances as numpy kernels behind Arrow UDFs.

Kernels see a ring as an (n, 2) array, a polygon as a list of rings (boundary first), a multi-polygon as a
list of polygons. Predicates rest on one idea: an edge is cut where it meets the other ring, and the
middle of each piece is located inside, on or outside of that ring. Callers should put a cheap
bounding-box test before any of these functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from geoweave.functions.constants import EPSILON

IN, ON, OUT = 1, 0, -1
#: Vertex-edge pairs that are compared at once; the same for pairs of edges in blocks of small rings.
BLOCK, PAIRS = 1 << 21, 1 << 16


def edges(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ring, np.roll(ring, -1, axis=-2)


def cross2(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]


def nearest_on_edges(points: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance of each point to each edge, and the foot points; each point may have edges of its own."""
    d = q - p
    size = (d * d).sum(axis=-1)
    t = ((points[:, None] - p) * d).sum(axis=2) / np.where(size == 0, 1, size)
    foot = p + np.clip(np.where(size == 0, 0, t), 0, 1)[..., None] * d
    return ((points[:, None] - foot) ** 2).sum(axis=2), foot


def locate(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """IN, ON or OUT for each point; each point may have a ring of its own (n, m, 2)."""
    p, q = edges(ring)
    x, y = points[:, None, 0], points[:, None, 1]
    spans = (p[..., 1] > y) != (q[..., 1] > y)
    dy = np.where(q[..., 1] == p[..., 1], 1, q[..., 1] - p[..., 1])
    inside = (spans & (p[..., 0] + (y - p[..., 1]) * (q[..., 0] - p[..., 0]) / dy > x)).sum(axis=1) % 2 == 1
    on = (nearest_on_edges(points, p, q)[0] < EPSILON**2).any(axis=1)
    return np.where(on, ON, np.where(inside, IN, OUT))


def piece_middles(p: np.ndarray, q: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Middles of the pieces into which the edges p-q are cut by the edges of the ring."""
    a, b = edges(ring)
    out = []
    for s, e in zip(p, q):
        d, f = e - s, b - a
        det = cross2(d, f)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = cross2(a - s, f) / det
            u = cross2(a - s, d) / det
        size = float(d @ d)
        cuts = t[(np.abs(det) > EPSILON) & (t > 0) & (t < 1) & (u > -EPSILON) & (u < 1 + EPSILON)]
        along = ((a - s) @ d) / size if size else np.zeros(0)  # vertices of the ring that lie on the edge
        touch = along[np.abs(cross2(a - s, d)) < EPSILON * max(size, 1)] if size else along
        at = np.unique(np.concatenate(([0.0, 1.0], cuts, touch[(touch > 0) & (touch < 1)])))
        out.append(s + ((at[:-1] + at[1:]) / 2)[:, None] * d)
    return np.concatenate(out) if out else np.zeros((0, 2))


def sides(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Where the pieces of the inner ring's edges are with respect to the outer ring."""
    return locate(piece_middles(*edges(inner), outer), outer)


def ring_crosses(a: np.ndarray, b: np.ndarray) -> bool:
    at = sides(a, b)
    return bool((at == IN).any() and (at == OUT).any())


def ring_contains(a: np.ndarray, b: np.ndarray) -> bool:
    return not (sides(b, a) == OUT).any()


def rings_contain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ring_contains() of many pairs at once: of each ring of a block (k, n, 2) and the one at its place in another (k, m, 2)."""
    out = np.ones(len(a), bool)
    step = max(1, PAIRS // max(1, a.shape[1] * b.shape[1]))
    for i in range(0, len(a), step):
        outer = a[i : i + step]
        row, middles = middles_in_block(b[i : i + step], outer)
        out[i + row[locate(middles, outer[row]) == OUT]] = False
    return out


def middles_in_block(inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """piece_middles() of the edges of each inner ring and its outer ring, and the places of the rings."""
    s, e = (x[:, :, None] for x in edges(inner))
    a, b = (x[:, None] for x in edges(outer))
    d, f, off = e - s, b - a, a - s
    det, size = cross2(d, f), (d * d).sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross2(off, f) / det, cross2(off, d) / det
        along = (off * d).sum(axis=-1) / size
    cut = (np.abs(det) > EPSILON) & (t > 0) & (t < 1) & (u > -EPSILON) & (u < 1 + EPSILON)
    touch = (size != 0) & (np.abs(cross2(off, d)) < EPSILON * np.maximum(size, 1)) & (along > 0) & (along < 1)
    ends = np.zeros((*det.shape[:2], 2)) + [0.0, 1.0]
    at = np.sort(np.concatenate((ends, np.where(cut, t, 0), np.where(touch, along, 0)), axis=2), axis=2)
    row, edge, piece = np.nonzero(at[:, :, 1:] > at[:, :, :-1])
    middle = (at[row, edge, piece] + at[row, edge, piece + 1]) / 2
    return row, s[row, edge, 0] + middle[:, None] * d[row, edge, 0]


def ring_touches(a: np.ndarray, b: np.ndarray) -> bool:
    if ring_crosses(a, b) or ring_contains(a, b) or ring_contains(b, a):
        return False
    return bool((locate(b, a) == ON).any() or (locate(a, b) == ON).any())


def segment_middles(seg: np.ndarray, ring: np.ndarray) -> np.ndarray:
    return locate(piece_middles(seg[:1], seg[1:], ring), ring)


def ring_intersects_segment(a: np.ndarray, seg: np.ndarray) -> bool:
    at = segment_middles(seg, a)
    return bool((at == IN).any() and (at == OUT).any())


def ring_contains_segment(a: np.ndarray, seg: np.ndarray) -> bool:
    return not (segment_middles(seg, a) == OUT).any() if (seg[0] != seg[1]).any() else bool(locate(seg[:1], a)[0] != OUT)


#: Pairs of vertex and edge above which rings are swept; vertices that are swept together.
MANY_PAIRS, SWEPT = 10_000, 48


def closest_points(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Least distance between the vertices of one ring and the edges of the other, and the two points; large rings are swept."""
    return (closest_points_swept if len(a) * len(b) > MANY_PAIRS else closest_points_of_all)(a, b)


def _closer(best: tuple, points: np.ndarray, p: np.ndarray, q: np.ndarray, flip: bool) -> tuple:
    d, foot = nearest_on_edges(points, p, q)
    k, m = np.unravel_index(np.argmin(d), d.shape)
    if d[k, m] >= best[0]:
        return best
    pair = (points[k], foot[k, m])
    return (d[k, m], *(pair[::-1] if flip else pair))


def closest_points_of_all(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Every vertex against every edge."""
    best = (np.inf, a[0], b[0])
    for flip, (u, v) in enumerate(((a, b), (b, a))):
        p, q = edges(v)
        step = max(1, BLOCK // len(v))
        for i in range(0, len(u), step):
            best = _closer(best, u[i : i + step], p, q, bool(flip))
    return float(np.sqrt(best[0])), best[1], best[2]


def closest_points_swept(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The same by a sweep along the axis on which the rings are longer: a run of vertices meets the edges within the best distance so far."""
    span = np.maximum(a.max(axis=0), b.max(axis=0)) - np.minimum(a.min(axis=0), b.min(axis=0))
    axis, best = int(span[1] > span[0]), (np.inf, a[0], b[0])
    for flip, (u, v) in enumerate(((a, b), (b, a))):
        p, q = edges(v)
        low, high = np.minimum(p, q), np.maximum(p, q)
        order = np.argsort(low[:, axis])
        p, q, low, high = p[order], q[order], low[order], high[order]
        reach = np.maximum.accumulate(high[:, axis])
        u = u[np.argsort(u[:, axis])]
        best = _closer(best, u[:: len(u) // 8 + 1], p, q, bool(flip))
        starts = np.arange(0, len(u), SWEPT)
        least, most = np.minimum.reduceat(u, starts), np.maximum.reduceat(u, starts)
        apart = np.maximum(np.maximum(least - v.max(axis=0), v.min(axis=0) - most), 0)
        for i in np.argsort((apart**2).sum(axis=1), kind="stable").tolist():  # the nearest runs first
            d = np.sqrt(best[0])
            s, e = np.searchsorted(reach, least[i, axis] - d), np.searchsorted(low[:, axis], most[i, axis] + d, "right")
            gap = np.maximum(np.maximum(low[s:e] - most[i], least[i] - high[s:e]), 0)
            near = s + np.flatnonzero((gap * gap).sum(axis=1) < best[0])
            if len(near):
                best = _closer(best, u[starts[i] : starts[i] + SWEPT], p[near], q[near], bool(flip))
    return float(np.sqrt(best[0])), best[1], best[2]


def polygon_contains_segment(a: list, seg: np.ndarray) -> bool:
    """The boundary contains the segment and no hole crosses it."""
    return ring_contains_segment(a[0], seg) and not any(ring_intersects_segment(h, seg) for h in a[1:])


def multi_contains_segment(a: list, seg: np.ndarray) -> bool:
    return any(polygon_contains_segment(p, seg) for p in a)


def same_ring(a: np.ndarray, b: np.ndarray) -> bool:
    key = lambda r: sorted(map(tuple, np.round(r, 8).tolist()))
    return len(a) == len(b) and key(a) == key(b) and ring_contains(a, b) and ring_contains(b, a)


def same_polygon(a: list, b: list) -> bool:
    return len(a) == len(b) and same_ring(a[0], b[0]) and all(any(same_ring(h, g) for g in b[1:]) for h in a[1:])


def in_hole(a: list, b: list) -> bool:
    return any(ring_contains(h, b[0]) for h in a[1:])


def polygon_contains(a: list, b: list) -> bool:
    if same_polygon(a, b):
        return True
    if in_hole(a, b) or not ring_contains(a[0], b[0]):
        return False
    return not any(ring_crosses(h, b[0]) or ring_contains(b[0], h) for h in a[1:])


def polygon_crosses(a: list, b: list) -> bool:
    return not in_hole(a, b) and any(ring_crosses(r, b[0]) for r in a)


def polygon_touches(a: list, b: list) -> bool:
    if polygon_crosses(a, b):
        return False
    return ring_touches(a[0], b[0]) or any(ring_contains(h, b[0]) and bool((locate(b[0], h) == ON).any()) for h in a[1:])


def polygon_distance(a: list, b: list) -> float:
    """-1 if a contains b or the boundaries do or cross, 0 if they touch, else the gap (in a hole, to the hole)."""
    if polygon_contains(a, b):
        return -1.0
    if polygon_touches(a, b):
        return 0.0
    for h in a[1:]:
        if ring_contains(h, b[0]):
            return closest_points(h, b[0])[0]
    if ring_contains(a[0], b[0]) or ring_contains(b[0], a[0]) or ring_crosses(a[0], b[0]):
        return -1.0
    return closest_points(a[0], b[0])[0]


def polygon_valid(a: list) -> bool:
    """Holes inside the boundary that do not cross each other; every ring valid."""
    if not all(ring_valid(r) for r in a):
        return False
    holes = a[1:]
    return all(ring_contains(a[0], h) for h in holes) and not any(ring_crosses(h, g) for i, h in enumerate(holes) for g in holes[:i])


def ring_valid(ring: np.ndarray) -> bool:
    return bool(rings_valid(ring[None])[0])


def rings_valid(rings: np.ndarray) -> np.ndarray:
    """Which rings of a block (k, n, 2) are valid."""
    n = rings.shape[1]
    out = np.zeros(len(rings), bool)
    if n < 3:
        return out
    i, j = np.triu_indices(n, 1)
    beside = (j == i + 1) | ((i == 0) & (j == n - 1))
    step = max(1, PAIRS // len(i))
    for at in range(0, len(rings), step):
        p, q = edges(rings[at : at + step])
        d = q - p
        pi, pj, qi, qj, di, dj = p[:, i], p[:, j], q[:, i], q[:, j], d[:, i], d[:, j]
        det = cross2(di, dj)
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = cross2(pj - pi, dj) / det, cross2(pj - pi, di) / det
        meet = (np.abs(det) > EPSILON) & (t >= -EPSILON) & (t <= 1 + EPSILON) & (u >= -EPSILON) & (u <= 1 + EPSILON)
        dist = np.minimum.reduce([_gap(pj, pi, di), _gap(qj, pi, di), _gap(pi, pj, dj), _gap(qi, pj, dj)])
        apart = meet | (dist < EPSILON)
        folded = (np.abs(det) < EPSILON) & ((di * dj).sum(axis=-1) < 0)
        out[at : at + step] = ~np.where(beside, folded, apart).any(axis=1) & ~(np.hypot(d[..., 0], d[..., 1]) == 0).any(axis=1)
    return out


def _gap(x: np.ndarray, p: np.ndarray, d: np.ndarray) -> np.ndarray:
    size = (d * d).sum(axis=-1)
    t = np.clip(((x - p) * d).sum(axis=-1) / np.where(size == 0, 1, size), 0, 1)
    return np.sqrt(((x - p - t[..., None] * d) ** 2).sum(axis=-1))


def multi_contains(a: list, b: list) -> bool:
    return any(polygon_contains(p, b) for p in a)


def multi_crosses(a: list, b: list) -> bool:
    return any(polygon_crosses(p, b) for p in a)


def multi_touches(a: list, b: list) -> bool:
    return not multi_contains(a, b) and not multi_crosses(a, b) and any(polygon_touches(p, b) for p in a)


def multi_distance(a: list, b: list) -> float:
    return min(polygon_distance(p, q) for p in a for q in b)


def multi_shape_distance(a: list, b: list) -> float:
    return min(closest_points(p[0], q[0])[0] for p in a for q in b)


def multi_valid(a: list) -> bool:
    """Valid parts of which no two are equal, cross or contain each other."""
    if not all(polygon_valid(p) for p in a):
        return False
    pairs = [(p, q) for i, p in enumerate(a) for q in a[:i]]
    return not any(same_polygon(p, q) or polygon_crosses(p, q) or polygon_contains(p, q) or polygon_contains(q, p) for p, q in pairs)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise from the least point (monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts
    chains = []
    for order in (pts, pts[::-1]):
        chain: list[np.ndarray] = []
        for p in order:
            while len(chain) > 1 and cross2(chain[-1] - chain[-2], p - chain[-1]) <= 0:
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return np.array(chains)


# --- columns -----------------------------------------------------------------------------------


def flat_ring(r: Column) -> Column:
    return F.flatten(F.transform(r, lambda p: F.array(p["x"], p["y"])))


def flat_polygon(p: Column) -> Column:
    return F.concat(F.array(flat_ring(p["boundary"])), F.transform(p["holes"], flat_ring))


def flat_multi(m: Column) -> Column:
    return F.transform(m, flat_polygon)


def _lists(a: pa.Array) -> tuple[list[int], pa.Array, list[bool]]:
    """Where the lists of an array begin and end in its values, the values, and which lists there are."""
    return a.offsets.to_numpy().tolist(), a.values, a.is_valid().to_pylist()


def _rings(a: pa.Array) -> list[np.ndarray | None]:
    offsets, values, there = _lists(a)
    flat = values.to_numpy(zero_copy_only=False)
    return [flat[i:j].reshape(-1, 2) if ok else None for i, j, ok in zip(offsets, offsets[1:], there)]


def _grouped(a: pa.Array, read: Callable) -> list[list | None]:
    offsets, values, there = _lists(a)
    inner = read(values)
    return [inner[i:j] if ok else None for i, j, ok in zip(offsets, offsets[1:], there)]


#: Shapes of a column as views of its numbers: no Python object is made for a coordinate.
_READ: dict[str, Callable] = {
    "segment": _rings, "ring": _rings, "polygon": lambda a: _grouped(a, _rings), "multi": lambda a: _grouped(a, lambda b: _grouped(b, _rings)),
}
_FLAT = {"segment": lambda s: F.array(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"]), "ring": flat_ring, "polygon": flat_polygon, "multi": flat_multi}


def shapes_of(a: pa.Array, kind: str) -> list:
    """The shapes of a flat column as arrays; None for null."""
    return _READ[kind](a)


#: Answers that a task remembers, and the bytes of shapes up to which it does.
MOST_KNOWN, MOST_BYTES = 1 << 16, 1 << 10


def _bytes_of(shape) -> bytes:
    """Equal for equal shapes only: the coordinates, and how many each ring has."""
    if isinstance(shape, np.ndarray):
        return len(shape).to_bytes(4, "little") + shape.tobytes()
    return len(shape).to_bytes(4, "little") + b"".join(map(_bytes_of, shape))


def told_once(kernel: Callable) -> Callable:
    """The kernel, asked once for equal small shapes as long as a bounded number of answers is remembered."""
    known: dict = {}

    def run(*shapes):
        key = tuple(map(_bytes_of, shapes))
        if sum(map(len, key)) > MOST_BYTES:
            return kernel(*shapes)
        if key not in known:
            if len(known) >= MOST_KNOWN:
                known.clear()
            known[key] = kernel(*shapes)
        return known[key]

    return run


def pair_udf(kernel: Callable, left: str, right: str, kind=None) -> Callable[[Column, Column], Column]:
    """A function of two geometry columns from a kernel over two arrays; null if either is null."""
    kind, kernel = kind or BooleanType(), told_once(kernel)

    @F.arrow_udf(kind)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = [None if x is None or y is None else kernel(x, y) for x, y in zip(_READ[left](a), _READ[right](b))]
        return pa.array(out, pa.float64() if isinstance(kind, DoubleType) else pa.bool_())

    return lambda a, b: run(_FLAT[left](a), _FLAT[right](b))


def unary_udf(kernel: Callable, left: str, kind=None) -> Callable[[Column], Column]:
    kind, kernel = kind or BooleanType(), told_once(kernel)

    @F.arrow_udf(kind)
    def run(a: pa.Array) -> pa.Array:
        out = [None if x is None else kernel(x) for x in _READ[left](a)]
        return pa.array(out, pa.float64() if isinstance(kind, DoubleType) else pa.bool_())

    return lambda a: run(_FLAT[left](a))


def _closest_kernel(kernel):
    def run(a, b):
        d, p, q = kernel(a, b)
        return {"d": d, "a": {"x": float(p[0]), "y": float(p[1])}, "b": {"x": float(q[0]), "y": float(q[1])}}

    return run


CLOSEST = "struct<d:double,a:struct<x:double,y:double>,b:struct<x:double,y:double>>"
_CLOSEST_ARROW = pa.struct([("d", pa.float64()), ("a", pa.struct([("x", pa.float64()), ("y", pa.float64())])), ("b", pa.struct([("x", pa.float64()), ("y", pa.float64())]))])


def closest_udf(left: str = "polygon", right: str = "polygon") -> Callable[[Column, Column], Column]:
    """STRUCT<d, a, b>: the closest points of two shapes (their boundaries)."""
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL("d double, a struct<x:double,y:double>, b struct<x:double,y:double>")
    parts = {"ring": lambda v: [v], "polygon": lambda v: v[:1], "multi": lambda v: [p[0] for p in v]}

    def kernel(x, y):
        return min((closest_points(p, q) for p in parts[left](x) for q in parts[right](y)), key=lambda c: c[0])

    pack = told_once(_closest_kernel(kernel))

    @F.arrow_udf(kind)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else pack(x, y) for x, y in zip(_READ[left](a), _READ[right](b))], _CLOSEST_ARROW)

    return lambda a, b: run(_FLAT[left](a), _FLAT[right](b))


def points_udf(kernel: Callable, left: str) -> Callable[[Column], Column]:
    """A ring column from a kernel that returns an (n, 2) array."""
    from pyspark.sql.types import ArrayType, StructType

    kind = ArrayType(StructType.fromDDL("x double, y double"))
    listed = told_once(lambda v: [{"x": float(x), "y": float(y)} for x, y in kernel(v)])

    @F.arrow_udf(kind)
    def run(a: pa.Array) -> pa.Array:
        out = [None if v is None else listed(v) for v in _READ[left](a)]
        return pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    return lambda a: run(_FLAT[left](a))
