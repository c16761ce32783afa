import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.functions import hulls, kernels
from geoweave.sources import files, geotiff


def pack_lzw(data: bytes) -> bytes:
    codes, table, held, width, acc, bits, out = [256], {}, b"", 9, 0, 0, bytearray()
    table = {bytes([i]): i for i in range(256)}
    sized = [(256, 9)]
    for c in data:
        one = held + bytes([c])
        if one in table:
            held = one
            continue
        sized.append((table[held], width))
        table[one] = len(table) + 2
        n = len(table) + 2
        width = 9 + (n > 511) + (n > 1023) + (n > 2047)
        held = bytes([c])
        if n >= 4094:
            sized.append((256, width))
            table, width = {bytes([i]): i for i in range(256)}, 9
    sized += [(table[held], width)] if held else []
    n = len(table) + 3
    sized.append((257, 9 + (n > 511) + (n > 1023) + (n > 2047)))
    for code, w in sized:
        acc, bits = acc << w | code, bits + w
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
    if bits:
        out.append(acc << 8 - bits & 255)
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100)) + b"\x80"


def tiff(array: np.ndarray, order="<", compression=1, tile=None, rows=7, predictor=1, scale=None) -> bytes:
    pack = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32773: pack_bits}[compression]
    a = np.atleast_3d(array)
    h, w, bands = a.shape
    blocks = []
    if tile:
        grown = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile, bands), a.dtype)
        grown[:h, :w] = a
        blocks = [grown[r : r + tile, c : c + tile] for r in range(0, h, tile) for c in range(0, w, tile)]
    else:
        blocks = [a[r : r + rows] for r in range(0, h, rows)]
    if predictor == 2:
        blocks = [np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1])) for b in blocks]
    packed = [pack(b.astype(a.dtype.newbyteorder(order)).tobytes()) for b in blocks]
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [a.dtype.itemsize * 8] * bands), (259, "H", [compression]), (277, "H", [bands]), (284, "H", [1]), (317, "H", [predictor]), (339, "H", [kind] * bands)]
    at, body = 8, b""
    offsets = [at + sum(map(len, packed[:k])) for k in range(len(packed))]
    body = b"".join(packed)
    names = (324, 325) if tile else (273, 279)
    tags += [(names[0], "I", offsets), (names[1], "I", list(map(len, packed)))] + ([(322, "I", [tile]), (323, "I", [tile])] if tile else [(278, "I", [rows])])
    if scale:
        tags += [(33550, "d", [scale[0], scale[1], 0.0]), (33922, "d", [0.0, 0.0, 0.0, scale[2], scale[3], 0.0])]
    ids, extra, entries = {"H": 3, "I": 4, "d": 12}, b"", b""
    start = 8 + len(body)
    tail = start + 2 + 12 * len(tags) + 4
    for tag, code, values in sorted(tags):
        raw = struct.pack(f"{order}{len(values)}{code}", *values)
        entries += struct.pack(f"{order}HHI", tag, ids[code], len(values))
        entries += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", tail + len(extra))
        extra += raw if len(raw) > 4 else b""
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, start)
    return head + body + struct.pack(f"{order}H", len(tags)) + entries + b"\0" * 4 + extra


@pytest.mark.parametrize("options", [{}, {"order": ">"}, {"compression": 8, "tile": 16, "predictor": 2, "order": ">"}, {"compression": 5}, {"compression": 5, "tile": 32, "predictor": 2}, {"compression": 32773}])
@pytest.mark.parametrize("kind", ["u1", "i2", "f4", "u4"])
def test_blocks_of_images(options, kind):
    if options.get("predictor") == 2 and kind == "f4":
        kind = "i4"
    a = np.random.default_rng(3).integers(0, 100, (45, 61, 2)).astype(kind)
    out = np.full(a.shape[:2], -1, np.int64)
    for r, c, block in geotiff.read_blocks(tiff(a, **options)):
        out[r : r + block.shape[0], c : c + block.shape[1]] = block
    assert (out == a[:, :, 0]).all()


def test_long_lzw_stream():
    data = np.random.default_rng(5).integers(0, 7, 60_000).astype(np.uint8).tobytes()
    assert geotiff.unpack_lzw(pack_lzw(data)) == data


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        geotiff.read_tags(b"PK\x03\x04 not an image")


def test_image_to_shapefile(spark, tmp_path):
    a = np.zeros((6, 8), np.uint8)
    a[1:5, 1:5] = 3
    a[2:4, 2:4] = 0  # a hole
    a[5, 5] = 3  # hangs on by a corner
    a[0, 7] = 9
    path = str(tmp_path / "image.tif")
    assert geotiff.open_as_shapefile(spark, path) == str(tmp_path / "image.shp") and not (tmp_path / "image.shp").exists()
    open(path, "wb").write(tiff(a, scale=(0.5, 0.5, 10.0, 50.0)))
    assert geotiff.read_cells(spark, path).count() == 14 and geotiff.read_cells(spark, path, mask_zero=False).count() == 48
    target = geotiff.open_as_shapefile(spark, path)
    got = spark.read.format("shapefile").load(target).collect()
    area = lambda r: abs(hulls._twice_area(np.array([(p["x"], p["y"]) for p in r]))) / 2
    assert sorted((r.pixel_val, area(r.geom["boundary"]), [area(h) for h in r.geom["holes"]]) for r in got) == [(3, 0.25, []), (3, 4.0, [1.0]), (9, 0.25, [])]
    corner = next(r for r in got if r.pixel_val == 9).geom["boundary"]
    assert {(p["x"], p["y"]) for p in corner} == {(13.5, 50.0), (14.0, 50.0), (14.0, 49.5), (13.5, 49.5)}
    assert geotiff.open_as_shapefile(spark, target) == target
    with pytest.raises(ValueError):
        geotiff.open_as_shapefile(spark, str(tmp_path / "x.gpkg"))


@pytest.mark.parametrize("make", [lambda r, n: r.uniform(0, 100, (n, 2)), lambda r, n: r.integers(0, 9, (n, 2)).astype(float), lambda r, n: r.normal(0, 1, (n, 2)) * [50, 0.5] + [1e5, 5e5]])
def test_triangles_cover_the_hull_and_circles_are_empty(make):
    pts = np.unique(make(np.random.default_rng(1), 60), axis=0)
    t = hulls.delaunay(pts)
    corners = pts[t]
    area = kernels.cross2(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]) / 2
    assert abs(area.sum() * 2 / hulls._twice_area(kernels.convex_hull(pts)) - 1) < 1e-6 and set(t.ravel().tolist()) == set(range(len(pts)))
    span = np.ptp(pts, axis=0).max()
    for tri in t[area > 1e-6 * span * span]:
        a, b, c = ((pts[i] - pts) / span for i in tri)
        inside = (a * a).sum(1) * kernels.cross2(b, c) - (b * b).sum(1) * kernels.cross2(a, c) + (c * c).sum(1) * kernels.cross2(a, b)
        assert inside.max() < 1e-6


def test_concave_hulls_shrink_and_keep_all_points():
    rng = np.random.default_rng(2)
    angle = rng.uniform(0.3, 2 * np.pi - 0.3, 400)  # an open ring of points
    pts = np.stack((np.cos(angle), np.sin(angle)), 1) * rng.uniform(0.8, 1, (400, 1))
    last = np.inf
    for ratio in (1.0, 0.6, 0.3, 0.1, 0.0):
        rings = hulls.concave_hull(pts, ratio, holes=False)
        area = hulls._twice_area(rings[0])
        assert len(rings) == 1 and kernels.ring_valid(rings[0]) and 0 < area <= last + 1e-9
        assert (kernels.locate(pts, rings[0]) != kernels.OUT).all()
        last = area
    assert abs(hulls._twice_area(hulls.concave_hull(pts, 1.0)[0]) / hulls._twice_area(kernels.convex_hull(pts)) - 1) < 1e-6
    full = np.stack((np.cos(a := np.linspace(0, 2 * np.pi, 300, endpoint=False)), np.sin(a)), 1)
    ring = np.concatenate((full, full * 0.8 + 1e-3 * rng.random((300, 2))))
    outer, hole = hulls.concave_hull(ring, 0.3)
    assert hulls._twice_area(outer) > 0 > hulls._twice_area(hole) and kernels.ring_contains(outer, hole)
    line = hulls.concave_hull(np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]]), 0.5)
    assert len(line) == 1 and len(line[0]) < 3
    assert len(hulls.characteristic_shape(pts, 0.2)) > len(kernels.convex_hull(pts))


def test_outlines_of_merged_settlements(spark, tmp_path):
    from geoweave.plans import workflow

    box = lambda x, y, s: {"boundary": [{"x": x, "y": y}, {"x": x, "y": y + s}, {"x": x + s, "y": y + s}, {"x": x + s, "y": y}], "holes": []}
    ring = "array<struct<x:double,y:double>>"
    layer = spark.createDataFrame([(7, [box(0.0, 0.0, 1.0), box(2.0, 0.0, 1.0), box(0.0, 2.0, 1.0)]), (8, [box(9.0, 9.0, 2.0)])], f"FEATURE_ID int, geom array<struct<boundary:{ring},holes:array<{ring}>>>")
    files.overwrite(layer, str(tmp_path / "clusters"))
    out = workflow.outline_files(spark, str(tmp_path / "clusters"))
    assert out.endswith("clusters_concave_hull")
    got = {r.FEATURE_ID: r.geom["boundary"] for r in spark.read.format("shapefile").load(out).collect()}
    area = {k: abs(hulls._twice_area(np.array([(p["x"], p["y"]) for p in v]))) / 2 for k, v in got.items()}
    assert area[8] == 4.0 and 3.0 < area[7] <= 7.0
    nothing = layer.select(F.lit(None).cast(layer.schema["geom"].dataType).alias("geom"))
    assert workflow.settlement_outlines(nothing).first().geom is None
