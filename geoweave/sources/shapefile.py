"""Shapefiles as a Spark data source: spark.read.format("shapefile").load(path), df.write.format("shapefile").

A layer is a bundle (.shp, .shx, .dbf, .prj) or a folder of bundles, on any file system that pyarrow opens by its URI (file, hdfs, s3, gs); paths
without a scheme are local. Reading deals each bundle out by ranges of records (`records` is the least that a task gets), which the .shx places, so a large file is read by many tasks, and
each reads its own bytes only; the records of a run of bytes are decoded, checked and grouped together, into one Arrow batch. Features whose geometry is missing or invalid are skipped; single polygons are read as multi-polygons of one part
where the option `geometry` is `multi`. With the option `boxes` a row has its box too (xmin, ymin, xmax, ymax): filters on these are pushed to the records'
boxes, so what is outside is not decoded.

Writing stages bundles of bounded size under a hidden folder of the target, and the driver moves them in place when all tasks are done; what a
layer had before goes then, if it is overwritten, and a failed job leaves it as it was. Names of fields are cut to 10 bytes and made unlike, texts to 254 bytes,
never inside a character. An empty layer is a bundle without records.
"""

from __future__ import annotations

import datetime
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from geoweave.functions import kernels
from geoweave.sources.wkb import RING_ARROW

#: Fixed values of the format: magic number, version, polygon shape type, WGS 84 description.
FILE_CODE, VERSION, POLYGON_TYPE = 9994, 1000, 5
WGS84_PRJ = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
_RING = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
POLYGON_TYPE_SQL = StructType([StructField("boundary", _RING), StructField("holes", ArrayType(_RING))])


@dataclass
class Field:
    name: str
    kind: str
    size: int
    decimals: int

    @property
    def type(self) -> DataType:
        if self.kind == "N" and not self.decimals:
            return IntegerType() if self.size < 10 else LongType()
        return DoubleType() if self.kind in "NF" else StringType()

    def value(self, raw: bytes):
        text = raw.decode("utf-8", "replace").strip("\0 ")
        if self.kind in "NF":  # a missing number reads as zero
            for read in (int, lambda x: int(float(x))) if self.kind == "N" and not self.decimals else (float,):
                try:
                    return read(text or 0)
                except ValueError:
                    pass
            return 0
        return text

    def column(self, cells: np.ndarray) -> pa.Array:
        """The values of many records, of which cells has the bytes (records, size)."""
        raw = np.ascontiguousarray(cells).view(f"S{self.size}")[:, 0] if self.size else np.full(len(cells), b"", "S1")
        if self.kind in "NF":
            try:
                numbers = np.where(np.isin(cells, (0, 32)).all(axis=1), b"0", raw).astype(np.float64 if self.type == DoubleType() else np.int64)
                return pa.array(numbers).cast(to_arrow_type(self.type))
            except (ValueError, OverflowError):  # some are no numbers
                pass
        return pa.array([self.value(x) for x in raw.tolist()], to_arrow_type(self.type))


#: Records of one input partition, bytes that a task reads at once, and bytes of one bundle that a task writes.
RECORDS, CHUNK, BUNDLE_BYTES = 1 << 15, 8 << 20, 64 << 20
#: A layer is read by about so many tasks at most, as long as none gets more than RECORDS: each starts a Python worker.
TASKS = 256


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path on it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def read_bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    store, at = resolve(path)
    with store.open_input_file(at) as f:
        return f.read_at(f.size() - start if size is None else size, start)


def size_of(path: str) -> int:
    """Bytes of a file, -1 if there is none."""
    store, at = resolve(path)
    info = store.get_file_info(at)
    return info.size if info.type == fs.FileType.File else -1


@dataclass
class Table:
    """The layout of a .dbf file: its fields (numbers and texts only), where they are in a record, and where records are."""

    fields: list[Field]
    offsets: list[int]
    count: int
    head: int
    size: int

    @staticmethod
    def of(path: str) -> Table:
        n, head, size = struct.unpack_from("<IHH", read_bytes(path, 0, 32), 4)
        data, fields, at = read_bytes(path, 0, head), [], 32
        while data[at] != 0x0D:
            name = data[at : at + 11].split(b"\0")[0].decode("utf-8", "replace")
            fields.append(Field(name, chr(data[at + 11]), data[at + 16], data[at + 17]))
            at += 32
        offsets = np.concatenate(([1], 1 + np.cumsum([f.size for f in fields]))).astype(int)
        keep = [i for i, f in enumerate(fields) if f.kind in "NFC"]
        return Table([fields[k] for k in keep], [int(offsets[k]) for k in keep], n, head, size)

    def rows(self, path: str, first: int, end: int) -> np.ndarray:
        """The bytes of records first to end, a row each."""
        data = read_bytes(path, self.head + first * self.size, (end - first) * self.size)
        n = len(data) // self.size
        return np.frombuffer(data, np.uint8, n * self.size).reshape(n, self.size)

    def column(self, rows: np.ndarray, name: str) -> pa.Array | None:
        """The values of a field, of the last one if several have the name."""
        k = max((i for i, f in enumerate(self.fields) if f.name == name), default=None)
        return None if k is None else self.fields[k].column(rows[:, self.offsets[k] : self.offsets[k] + self.fields[k].size])


def signed(ring: np.ndarray):
    """Area of a ring, below zero if it is clockwise; of each ring of a block (k, n, 2)."""
    q = np.roll(ring, -1, axis=-2)
    return (ring[..., 0] * q[..., 1] - ring[..., 1] * q[..., 0]).sum(axis=-1) / 2


def group_rings(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Clockwise rings are boundaries; each other ring is a hole of the boundary that contains it."""
    outer = [[r] for r in rings if signed(r) <= 0] or [[r] for r in rings[:1]]
    for h in (r for r in rings if signed(r) > 0 and not any(r is o[0] for o in outer)):
        home = next((o for o in outer if kernels.ring_contains(o[0], h)), None)
        if home is not None:
            home.append(h)
    return outer


def alike(*keys: np.ndarray) -> Iterator[np.ndarray]:
    """Places with equal keys, those of each key together."""
    order = np.lexsort(keys)
    cut = np.flatnonzero(np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)) + 1
    yield from (np.split(order, cut) if len(order) else [])


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The integers of ranges of n from first on, one range after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def offsets(n: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())


HEAD = np.dtype([("type", "<i4"), ("box", "<f8", 4), ("parts", "<i4"), ("points", "<i4")])


def heads_of(data: bytes, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fixed parts of polygons among records whose bodies are at those places, and which these are; null shapes and other types are left out."""
    fit = np.flatnonzero(size >= HEAD.itemsize)
    heads = np.frombuffer(b"".join([data[i : i + HEAD.itemsize] for i in at[fit].tolist()]), HEAD)
    which = heads["type"] % 10 == POLYGON_TYPE
    return heads[which], fit[which]


class Rings:
    """The rings of many records: xy has all points, ring i the n[i] points from first[i] on (open), and is of record of[i].

    The records' clockwise rings are boundaries; each other ring is a hole of the first boundary that contains it. Rings of
    equal length are looked at together.
    """

    def __init__(self, data: bytes, at: np.ndarray, heads: np.ndarray):
        parts, points = (heads[c].astype(np.int64) for c in ("parts", "points"))
        lists = at + HEAD.itemsize
        starts = np.frombuffer(b"".join([data[i : i + 4 * k] for i, k in zip(lists.tolist(), parts.tolist())]), "<i4").astype(np.int64)
        self.xy = np.frombuffer(b"".join([data[i : i + 16 * k] for i, k in zip((lists + 4 * parts).tolist(), points.tolist())]), "<f8").reshape(-1, 2)
        self.records, self.of = len(heads), np.repeat(np.arange(len(heads)), parts)
        self.head = (np.cumsum(parts) - parts)[parts > 0]  # the first ring of each record
        ends = np.append(starts[1:], 0)[: len(starts)]
        ends[np.cumsum(parts)[parts > 0] - 1] = points[parts > 0]
        base, most = (np.cumsum(points) - points)[self.of], points[self.of]
        self.first = base + np.clip(starts, 0, most)
        self.n = np.maximum(base + np.clip(ends, 0, most) - self.first, 0)
        some = np.flatnonzero(self.n > 1)
        self.n[some] -= (self.xy[self.first[some]] == self.xy[self.first[some] + self.n[some] - 1]).all(axis=1)

    def block(self, which: np.ndarray) -> np.ndarray:
        """Rings of one length."""
        return self.xy[self.first[which][:, None] + np.arange(self.n[which[0]])]

    def home_of(self, holes: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """For each of the holes the first boundary of its record that contains it, -1 if none does."""
        per = np.bincount(self.of[outer], minlength=self.records)
        begin, home, left, k = np.cumsum(per) - per, np.full(len(holes), -1), np.arange(len(holes)), 0
        while len(left := left[per[self.of[holes[left]]] > k]):
            asked = outer[begin[self.of[holes[left]]] + k]
            inside = np.zeros(len(left), bool)
            for i in alike(self.n[asked], self.n[holes[left]]):
                inside[i] = kernels.rings_contain(self.block(asked[i]), self.block(holes[left[i]]))
            home[left[inside]] = asked[inside]
            left, k = left[~inside], k + 1
        return home

    def polygons(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Boundaries of valid polygons by record, how many valid holes each has, and these one after the other."""
        area, valid = np.zeros(len(self.n)), np.zeros(len(self.n), bool)
        for i in alike(self.n):
            block = self.block(i)
            area[i], valid[i] = signed(block), kernels.rings_valid(block)
        outer = area <= 0
        none = np.bincount(self.of[outer], minlength=self.records) == 0
        outer[self.head[none[self.of[self.head]]]] = True
        holes, outer = np.flatnonzero((area > 0) & ~outer & valid), np.flatnonzero(outer)
        home = self.home_of(holes, outer)
        kept = np.flatnonzero((home >= 0) & valid[home])
        kept = kept[np.argsort(home[kept], kind="stable")]
        held = np.bincount(home[kept], minlength=len(self.n))
        outer = outer[valid[outer]]
        return outer, held[outer], holes[kept]

    def lists(self, which: np.ndarray) -> pa.Array:
        """Rings as lists of points."""
        x, y = np.ascontiguousarray(self.xy[ranges(self.first[which], self.n[which])].T)
        return pa.ListArray.from_arrays(offsets(self.n[which]), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], fields=list(RING_ARROW.value_type)))

    def geometry(self, multi: bool) -> tuple[np.ndarray, pa.Array]:
        """Records with polygons (with a single one, unless multi), and their geometry."""
        outer, held, holes = self.polygons()
        per = np.bincount(self.of[outer], minlength=self.records)
        keep = per > 0 if multi else per == 1
        mine = keep[self.of[outer]]
        holes, outer, held = holes[np.repeat(mine, held)], outer[mine], held[mine]
        shapes = pa.StructArray.from_arrays([self.lists(outer), pa.ListArray.from_arrays(offsets(held), self.lists(holes))], ["boundary", "holes"])
        return np.flatnonzero(keep), pa.ListArray.from_arrays(offsets(per[keep]), shapes) if multi else shapes


def index_of(path: str, first: int, end: int) -> np.ndarray:
    """Start and size in bytes of the records first to end of a .shp file, from its .shx; without one the file is walked through."""
    shx = path[:-4] + ".shx"
    if size_of(shx) >= 0:
        return np.frombuffer(read_bytes(shx, 100 + 8 * first, 8 * (end - first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
    data, at, found = read_bytes(path), 100, []
    while at + 8 <= len(data):
        size = 2 * struct.unpack_from(">ii", data, at)[1]
        found.append((at, size))
        at += 8 + size
    return np.array(found[first:end], np.int64).reshape(-1, 2)


def read_runs(path: str, first: int, end: int, most: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Records first to end in runs of about CHUNK bytes and of `most` records at most: number of the first one, bytes, and where bodies are in these and their sizes."""
    index, i = index_of(path, first, end), 0
    starts, ends = index[:, 0].tolist(), (index.sum(axis=1) + 8).tolist()
    while i < len(index):
        start, j = starts[i], i + 1
        while j < min(len(index), i + most) and start <= starts[j] and ends[j] - start <= CHUNK:
            j += 1
        data = read_bytes(path, start, max(ends[i:j]) - start)
        at, size = index[i:j, 0] + 8 - start, index[i:j, 1]
        if (at + size).max() > len(data):
            raise ValueError(f"{path} ends within a record")
        yield first + i, data, at, size
        i = j


def field_names(names: list[str]) -> list[str]:
    """Names of at most ten bytes, cut between characters; those that would be alike get numbers."""
    out: list[str] = []
    for name in names:
        short = name.encode()[:10].decode("utf-8", "ignore")
        for k in range(1, 1000):
            if short not in out:
                break
            end = f"_{k}"
            short = name.encode()[: 10 - len(end)].decode("utf-8", "ignore") + end
        out.append(short)
    return out


def points_of(a: pa.Array) -> np.ndarray:
    """The points of lists of points, one list after the other."""
    flat = a.flatten()
    x, y = flat.field("x"), flat.field("y")
    if a.null_count or flat.null_count or x.null_count or y.null_count:
        raise ValueError("a ring or a coordinate is null")
    return np.stack((x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)), axis=1)


def lengths(a: pa.Array) -> np.ndarray:
    return a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


class Outlines:
    """The rings of a column of polygons or multi-polygons, closed and turned as the format wants them: boundaries clockwise, holes not.

    Ring i has n[i] points from first[i] of xy on; record k has the rings from rings[k] to rings[k + 1].
    """

    def __init__(self, geom: pa.Array):
        multi = pa.types.is_list(geom.type) or pa.types.is_large_list(geom.type)
        parts, shapes = (lengths(geom), geom.flatten()) if multi else (np.ones(len(geom), np.int64), geom)
        boundary, holes = shapes.field("boundary"), shapes.field("holes")
        if shapes.null_count or holes.null_count or not parts.all():
            raise ValueError("a polygon or its list of holes is null, or a multi-polygon has no part")
        inner, held = holes.flatten(), lengths(holes)
        n = np.concatenate((lengths(boundary), lengths(inner)))
        given = np.concatenate((points_of(boundary), points_of(inner)))
        if not n.all():
            raise ValueError("a ring has no points")
        # the rings in the order of the file: each boundary and then its holes
        order = np.empty(len(n), np.int64)
        place = np.arange(len(held)) + np.cumsum(held) - held
        outer = np.zeros(len(n), bool)
        outer[place] = True
        order[place], order[~outer] = np.arange(len(held)), np.arange(len(held), len(n))
        first, n = (np.cumsum(n) - n)[order], n[order]
        turn = np.zeros(len(n), bool)
        for i in alike(n):
            turn[i] = (signed(given[first[i][:, None] + np.arange(n[i[0]])]) <= 0) != outer[i]
        self.n = n + 1
        self.first = np.cumsum(self.n) - self.n
        at = ranges(np.zeros(len(n), np.int64), self.n) % np.repeat(n, self.n)
        self.xy = given[np.repeat(first, self.n) + np.where(np.repeat(turn, self.n), np.repeat(n, self.n) - 1 - at, at)]
        self.rings = np.concatenate(([0], np.cumsum(1 + held)))[np.concatenate(([0], np.cumsum(parts)))]
        self.points = np.add.reduceat(self.n, self.rings[:-1]) if len(geom) else np.zeros(0, np.int64)

    def records(self, i: int, j: int, number: int) -> tuple[list[bytes], np.ndarray]:
        """The records i to j, of which the first gets the number, and their boxes."""
        lo, hi = self.rings[i], self.rings[j]
        n, at = self.n[lo:hi], self.rings[i:j] - lo
        xy = self.xy[self.first[lo] : self.first[lo] + n.sum()]
        ring = np.cumsum(n) - n
        begin, heads = ring[at], np.zeros(j - i, HEAD)
        heads["type"], heads["parts"], heads["points"] = POLYGON_TYPE, np.diff(self.rings[i : j + 1]), self.points[i:j]
        heads["box"] = np.concatenate((np.minimum.reduceat(xy, begin), np.maximum.reduceat(xy, begin)), axis=1)
        sizes = HEAD.itemsize + 4 * heads["parts"].astype(np.int64) + 16 * self.points[i:j]
        tops = np.stack((np.arange(number, number + j - i), sizes // 2), axis=1).astype(">i4").tobytes()
        starts, points, fixed = (ring - np.repeat(begin, heads["parts"])).astype("<i4").tobytes(), xy.astype("<f8").tobytes(), heads.tobytes()
        out, h = [], HEAD.itemsize
        for k, (r, parts, p, count) in enumerate(zip(at.tolist(), heads["parts"].tolist(), begin.tolist(), heads["points"].tolist())):
            out.append(tops[8 * k : 8 * k + 8] + fixed[h * k : h * k + h] + starts[4 * r : 4 * (r + parts)] + points[16 * p : 16 * (p + count)])
        return out, heads["box"]


class Bundle:
    """Records that are written as one bundle: .shp, .shx, .dbf and .prj."""

    def __init__(self, fields: list[StructField]):
        self.fields, self.specs = fields, []
        for f, name in zip(fields, field_names([f.name for f in fields])):
            if isinstance(f.dataType, (DoubleType, FloatType)):
                self.specs.append((name, "N", 32, 17))
            elif isinstance(f.dataType, (IntegerType, ShortType)):
                self.specs.append((name, "N", 9, 0))
            elif isinstance(f.dataType, LongType):
                self.specs.append((name, "N", 20, 0))
            else:
                self.specs.append((name, "C", 254, 0))
        self.records: list[bytes] = []
        self.lines: list[bytes] = []
        self.boxes: list[np.ndarray] = []

    def add(self, shapes: Outlines, i: int, j: int, columns: list[list]) -> None:
        """The records i to j of shapes, and their values by field."""
        records, boxes = shapes.records(i, j, len(self.records) + 1)
        self.records += records
        self.boxes.append(boxes)
        cells = [np.full((j - i, 1), 32, np.uint8)]
        for values, (_, kind, width, dec) in zip(columns, self.specs):
            texts = (text_of(v, dec).encode()[:width] for v in values)
            if kind == "N":
                joined = b"".join([x.rjust(width) for x in texts])
            else:
                joined = b"".join([x.decode("utf-8", "ignore").encode().ljust(width) for x in texts])
            cells.append(np.frombuffer(joined, np.uint8).reshape(j - i, width))
        self.lines.append(np.hstack(cells).tobytes())

    def save(self, stem: str, prj: str = WGS84_PRJ) -> None:
        """Write the bundle; an existing one is replaced."""
        words = np.array([len(r) // 2 for r in self.records], np.int64)
        places = 50 + np.cumsum(words) - words
        b = np.concatenate(self.boxes) if self.boxes else np.zeros((1, 4))
        bounds = (*b[:, :2].min(axis=0), *b[:, 2:].max(axis=0))
        head = lambda words: struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", VERSION, POLYGON_TYPE, *bounds, 0, 0, 0, 0)
        index = np.stack((places, words - 4), axis=1).astype(">i4").tobytes()
        dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(self.records), 33 + 32 * len(self.specs), 1 + sum(s[2] for s in self.specs))
        for name, kind, width, dec in self.specs:
            dbf += name.encode().ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([width, dec]) + bytes(14)
        for ext, data in (
            (".shp", head(50 + int(words.sum())) + b"".join(self.records)), (".shx", head(50 + 4 * len(words)) + index),
            (".dbf", dbf + b"\r" + b"".join(self.lines) + b"\x1a"), (".prj", prj.encode()),
        ):
            store, at = resolve(stem + ext)
            with store.open_output_stream(at) as f:
                f.write(data)


def text_of(value, decimals: int) -> str:
    if value is None:
        return ""
    if isinstance(value, datetime.datetime) and value.tzinfo:
        value = value.astimezone().replace(tzinfo=None)
    return f"{value:.{decimals}f}" if decimals else str(value)


def list_files(path: str) -> list[str]:
    """The .shp files of a layer, hidden ones left out, as paths like the given one."""
    store, at = resolve(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    found = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(at)) if x.base_name.endswith(".shp")) if info.type == fs.FileType.Directory else []
    if not found:
        raise FileNotFoundError(f"no shapefile at {path}")
    return [f"{path.rstrip('/')}/{x}" for x in found if x[0] not in "._"]


BOX = ["xmin", "ymin", "xmax", "ymax"]


class _Range(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.multi, self.boxed = schema, options.get("geometry") == "multi", options.get("boxes", "false").lower() == "true"
        self.files, self.records = list_files(options["path"]), int(options.get("records", RECORDS))
        self.limits: list[tuple[int, float, bool, bool]] = []

    def partitions(self):
        for f in self.files:
            if read_bytes(f, 0, 4) != struct.pack(">i", FILE_CODE):
                raise ValueError(f"{f} is not a shapefile")
        counts = [Table.of(f[:-4] + ".dbf").count for f in self.files]
        out, records = [], max(self.records, min(RECORDS, -(-sum(counts) // TASKS)))
        for f, n in zip(self.files, counts):
            step = records if size_of(f[:-4] + ".shx") >= 0 else max(n, 1)  # without an index a file is walked through by one task
            out += [_Range(f, i, min(n, i + step)) for i in range(0, n, step)]
        return out or [_Range(self.files[0], 0, 0)]

    def _passing(self, boxes: np.ndarray) -> np.ndarray:
        out = np.ones(len(boxes), bool)
        for side, value, above, equal in self.limits:
            v = boxes[:, side]
            out &= (v > value if above else v < value) | (equal & (v == value))
        return out

    def read(self, partition):
        """Rows, as a caller of its own would have them; Spark gets whole batches (see _Batches)."""
        for b in self.batches(partition):
            yield from zip(*(c.to_pylist() for c in b.columns))

    def batches(self, partition) -> Iterator[pa.RecordBatch]:
        path, table = partition.path[:-4] + ".dbf", Table.of(partition.path[:-4] + ".dbf")
        for first, data, at, size in read_runs(partition.path, partition.first, partition.end, max(1, CHUNK // table.size)):
            rows = table.rows(path, first, first + len(at))
            heads, which = heads_of(data, at[: len(rows)], size[: len(rows)])
            if (HEAD.itemsize + 4 * heads["parts"].astype(np.int64) + 16 * heads["points"].astype(np.int64) > size[which]).any():
                raise ValueError(f"{partition.path} has a record that is longer than its place")
            passing = self._passing(heads["box"])
            heads, which = heads[passing], which[passing]
            kept, geom = Rings(data, at[which], heads).geometry(self.multi)
            rows, heads, columns = rows[which[kept]], heads[kept], []
            for f in self.schema.fields:
                if f.name == "geom":
                    columns.append(geom)
                elif self.boxed and f.name in BOX:
                    columns.append(pa.array(np.ascontiguousarray(heads["box"][:, BOX.index(f.name)])))
                else:
                    values, kind = table.column(rows, f.name), to_arrow_type(f.dataType)
                    columns.append(pa.nulls(len(rows), kind) if values is None else values if values.type == kind else values.cast(kind))
            if len(rows):
                yield pa.RecordBatch.from_arrays(columns, self.schema.names)


class _BoxReader(_Reader):
    def pushFilters(self, filters: list[Filter]):
        """Bounds of the box's sides stay here, all else is Spark's."""
        for f in filters:
            side = BOX.index(f.attribute[0]) if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute[0] in BOX else None
            if side is None:
                yield f
            else:
                self.limits.append((side, float(f.value), isinstance(f, (GreaterThan, GreaterThanOrEqual)), isinstance(f, (GreaterThanOrEqual, LessThanOrEqual))))


class _Batches:
    """A reader whose batches go on to Spark as they are, without rows between."""

    def read(self, partition):
        return self.batches(partition)


class _BatchReader(_Batches, _Reader):
    pass


class _BatchBoxReader(_Batches, _BoxReader):
    pass


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


PARTS = (".shp", ".shx", ".dbf", ".prj")


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.path, self.overwrite = schema, options["path"].rstrip("/"), overwrite
        self.prj, self.limit = options.get("prj", WGS84_PRJ), int(options.get("bundleBytes", BUNDLE_BYTES))
        self.job = uuid.uuid4().hex
        self.staging = f"{self.path}/_staging-{self.job}"
        store, at = resolve(self.staging)
        store.create_dir(at, recursive=True)

    def write(self, iterator):
        from pyspark import TaskContext

        fields = [f for f in self.schema.fields if f.name != "geom"]
        task, bundle, size, names = TaskContext.get(), Bundle(fields), 0, []
        stem = f"part-{task.partitionId():05d}-{self.job[:8]}-{task.taskAttemptId()}"

        def flush():
            names.append(f"{stem}-{len(names):04d}")
            bundle.save(f"{self.staging}/{names[-1]}", self.prj)

        for b in iterator:
            b = b.filter(b["geom"].is_valid())
            shapes = Outlines(b["geom"])
            columns, i = [b[f.name].to_pylist() for f in fields], 0
            sizes = np.cumsum(16 * (shapes.points - np.diff(shapes.rings)) + 64 * len(fields))
            while i < b.num_rows:
                before = int(sizes[i - 1]) if i else 0
                j = min(b.num_rows, int(np.searchsorted(sizes, before + self.limit - size)) + 1)  # up to the record that fills the bundle
                bundle.add(shapes, i, j, [c[i:j] for c in columns])
                size += int(sizes[j - 1]) - before
                if size >= self.limit:
                    flush()
                    bundle, size = Bundle(fields), 0
                i = j
        if bundle.records:
            flush()
        return _Written(names)

    def commit(self, messages):
        """Old bundles go, if so wanted, and those of the tasks that succeeded come."""
        store, folder = resolve(self.path)
        staging = resolve(self.staging)[1]
        names = [n for m in messages if m is not None for n in m.names]
        if not names:
            names = [f"part-00000-{self.job[:8]}-0-0000"]
            Bundle([f for f in self.schema.fields if f.name != "geom"]).save(f"{self.staging}/{names[0]}", self.prj)
        old = [x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.File and x.path.endswith(PARTS)] if self.overwrite else []
        for n in names:  # the .shp makes a bundle visible, so it comes last
            for ext in (*PARTS[1:], PARTS[0]):
                store.move(f"{staging}/{n}{ext}", f"{folder}/{n}{ext}")
        for x in sorted(old, key=lambda x: not x.endswith(".shp")):
            store.delete_file(x)
        store.delete_dir(staging)

    def abort(self, messages):
        store, at = resolve(self.staging)
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        """Fields of the first file, the box on demand, and geom."""
        fields = Table.of(list_files(self.options["path"])[0][:-4] + ".dbf").fields
        geom = ArrayType(POLYGON_TYPE_SQL) if self.options.get("geometry") == "multi" else POLYGON_TYPE_SQL
        box = [StructField(c, DoubleType()) for c in BOX] if self.options.get("boxes", "false").lower() == "true" else []
        return StructType([StructField(f.name, f.type) for f in fields] + box + [StructField("geom", geom)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_BatchBoxReader if self.options.get("boxes", "false").lower() == "true" else _BatchReader)(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShapefileSource)
