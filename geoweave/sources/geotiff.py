"""GeoTIFF images as cells: the first band of strips or tiles, plain, deflated, LZW or PackBits.

A file is decoded by one task, block by block, and leaves it as rows of (row, col, val); files go through Spark's
reader, so any store that Spark reads will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from geoweave.functions.kernels import flat_ring
from geoweave.sources import files
from geoweave.sources.raster import polygonise
from geoweave.sources.shapefile import group_rings
from geoweave.sources.wkb import POLYGON_ARROW, POLYGON_DDL, as_struct

#: Fixed values of the format: sizes of value types, tags, compressions, codes of LZW.
TYPE_CODES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR = 256, 257, 258, 259, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIE, MATRIX = 317, 322, 323, 324, 325, 339, 33550, 33922, 34264
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257


def read_tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image, of classic and of big files."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = struct.unpack_from(f"{order}H", data, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack_from(f"{order}Q" if big else f"{order}I", data, 8 if big else 4)[0]
    n = struct.unpack_from(f"{order}Q" if big else f"{order}H", data, at)[0]
    at += 8 if big else 2
    tags = {}
    for k in range(n):
        e = at + k * (20 if big else 12)
        tag, kind = struct.unpack_from(f"{order}HH", data, e)
        count = struct.unpack_from(f"{order}Q" if big else f"{order}I", data, e + 4)[0]
        code, value = TYPE_CODES.get(kind), e + (12 if big else 8)
        if code:
            if struct.calcsize(code) * count > (8 if big else 4):
                value = struct.unpack_from(f"{order}Q" if big else f"{order}I", data, value)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, value)
    return order, tags


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early."""
    out, table, last, held, bits, width = bytearray(), [], b"", 0, 0, 9
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == END:
            break
        if code == CLEAR:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if code > len(table) or not table:
            raise ValueError("broken LZW data")
        got = table[code] if code < len(table) else last + last[:1]
        out += got
        if last:
            table.append(last + got[:1])
        last = got
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n if n > 128 else 0)
            i += 2 if n > 128 else 1
    return bytes(out)


UNPACK = {PLAIN: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


def read_blocks(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, first column and values of each block of the first band."""
    order, tags = read_tags(data)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, bits = one(WIDTH), one(HEIGHT), one(BITS, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
    if bits not in (8, 16, 32, 64) or kind is None or one(COMPRESSION, PLAIN) not in UNPACK or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"not supported: {bits} bits, format {one(FORMAT, 1)}, compression {one(COMPRESSION, PLAIN)}, predictor {one(PREDICTOR, 1)}")
    bands = one(SAMPLES, 1) if one(PLANAR, 1) == 1 else 1
    tiled = TILES in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    across, down = -(-width // w), -(-height // h)
    for k, (at, size) in enumerate(zip(tags[TILES if tiled else STRIPS][: across * down], tags[TILE_SIZES if tiled else STRIP_SIZES])):
        r, c = k // across * h, k % across * w
        rows = h if tiled else min(h, height - r)
        raw = UNPACK[one(COMPRESSION, PLAIN)](data[at : at + size])
        block = np.frombuffer(raw, np.dtype(f"{order}{kind}{bits // 8}"), rows * w * bands).reshape(rows, w, bands)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
        yield r, c, block[: height - r, : width - c, 0]


def read_transform(data: bytes) -> tuple[float, ...]:
    """(x0, x by column, x by row, y0, y by column, y by row); cells themselves where nothing is said."""
    tags = read_tags(data)[1]
    if MATRIX in tags:
        m = tags[MATRIX]
        return m[3], m[0], m[1], m[7], m[4], m[5]
    if SCALE in tags and TIE in tags:
        (sx, sy), (i, j, _, x, y) = tags[SCALE][:2], tags[TIE][:5]
        return x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy
    return 0.0, 1.0, 0.0, 0.0, 0.0, -1.0


def read_cells(spark: SparkSession, path: str, mask_zero: bool = True) -> DataFrame:
    """(path, row, col, val) of one image or a folder of them; val is the first band, fractions dropped, no-number cells left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b["path"].to_pylist(), b["content"]):
                for r, c, block in read_blocks(data.as_buffer().to_pybytes()):
                    used = np.isfinite(block) if block.dtype.kind == "f" else np.ones(block.shape, bool)
                    val = np.where(used, block, 0).astype(np.int64)
                    rows, cols = np.nonzero(used & (val != 0) if mask_zero else used)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows), pa.string()), pa.array(rows + r, pa.int32()), pa.array(cols + c, pa.int32()), pa.array(val[rows, cols])], names=["path", "row", "col", "val"]
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row int, col int, val long")


def _transforms(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [read_transform(x.as_buffer().to_pybytes()) for x in b["content"]]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.float64()))], names=["at"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "at array<double>")


def read_polygons(spark: SparkSession, path: str, mask_zero: bool = True) -> DataFrame:
    """(pixel_val, geom) of one image: 8-connected cells of equal value as polygons in the image's coordinates.

    What hangs together by a corner only is a polygon for each side of the corner, so that all are simple.
    """
    x0, xc, xr, y0, yc, yr = _transforms(spark, path).first()[0]

    def place(ring: np.ndarray) -> np.ndarray:
        x, y = ring.T
        return np.stack((x * xc + y * xr + x0, x * yc + y * yr + y0), axis=1)

    @F.arrow_udf(ArrayType(StructType.fromDDL(POLYGON_DDL)))
    def shapes(a: pa.Array) -> pa.Array:
        down = np.array([1.0, -1.0])  # rows go down, rings are told apart by their turn with y going up
        rings = ([np.array(r).reshape(-1, 2) * down for r in v] for v in a.to_pylist())
        return pa.array([[as_struct([place(r * down) for r in g]) for g in group_rings(v)] for v in rings], pa.list_(POLYGON_ARROW))

    traced = polygonise(read_cells(spark, path, mask_zero), mask_zero)
    return traced.select("pixel_val", F.explode(shapes(F.transform("rings", flat_ring))).alias("geom"))


def convert(spark: SparkSession, path: str, mask_zero: bool = True) -> str:
    """Write the polygons of an image to the shapefile beside it; returns where."""
    target = files.as_shapefile(path)
    files.overwrite(read_polygons(spark, path, mask_zero), target)
    return target


def open_as_shapefile(spark: SparkSession, path: str, mask_zero: bool = True) -> str:
    """A shapefile as it is, an image converted, the place beside it for an image that does not exist."""
    target = files.as_shapefile(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return convert(spark, path, mask_zero) if exists and target != path else target
