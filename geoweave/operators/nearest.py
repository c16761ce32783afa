"""Nearest points by the leaves of a k-d tree: as fast where points are clumped as where they are even.

A bounded sample decides the splits, so a leaf holds about as many points in a crowd as in a desert. An asking point is compared with
its own leaf first; the distance of its k-th neighbour there tells which other leaves can hold nearer ones, and only these are asked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StructField, StructType

from geoweave.operators.storage import cut

#: Points of a leaf, in the middle; leaves at most; sampled points for each leaf; distances that are computed at once.
LEAF, MOST_LEAVES, SAMPLED, BLOCK = 512, 1 << 16, 32, 1 << 20
#: Asking points that one task compares with a leaf.
ASKS = 1 << 15


@dataclass
class Tree:
    """Node i has the children 2 i + 1 and 2 i + 2 and splits at `at` along x (0) or y (1); leaves have axis -1. boxes hold what is below a node."""

    axis: np.ndarray
    at: np.ndarray
    boxes: np.ndarray | None = None

    @staticmethod
    def of_sample(points: np.ndarray, leaves: int) -> Tree:
        depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        axis, at = np.full(2 ** (depth + 1) - 1, -1, np.int8), np.zeros(2 ** (depth + 1) - 1)
        todo = [(0, points)]
        while todo:
            node, held = todo.pop()
            if 2 * node + 2 >= len(axis) or len(held) < 2:
                continue
            side = int(np.ptp(held[:, 1]) > np.ptp(held[:, 0]))
            middle = np.median(held[:, side])
            low = held[:, side] <= middle
            if low.all():
                low = held[:, side] < middle
                middle = held[low, side].max() if low.any() else middle
            if low.all() or not low.any():
                continue
            axis[node], at[node] = side, middle
            todo += [(2 * node + 1, held[low]), (2 * node + 2, held[~low])]
        return Tree(axis, at)

    def leaf_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        node, both = np.zeros(len(x), np.int64), np.stack((x, y))
        while True:
            live = np.flatnonzero(self.axis[node] >= 0)
            if not len(live):
                return node
            n = node[live]
            node[live] = 2 * n + 1 + (both[self.axis[n], live] > self.at[n])

    def with_boxes(self, leaves: np.ndarray, boxes: np.ndarray) -> Tree:
        """boxes: x0, y0, x1, y1 of what the leaves hold; leaves without points are reached by nobody."""
        out = np.tile(np.array([np.inf, np.inf, -np.inf, -np.inf]), (len(self.axis), 1))
        out[leaves] = boxes
        for node in range(len(out) - 1, 0, -1):
            up = (node - 1) // 2
            out[up, :2], out[up, 2:] = np.minimum(out[up, :2], out[node, :2]), np.maximum(out[up, 2:], out[node, 2:])
        return Tree(self.axis, self.at, out)

    def reached(self, x: np.ndarray, y: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the asking point, leaf) of all leaves that may hold points within a radius."""
        todo, who, where = [(0, np.arange(len(x)))], [], []
        while todo:
            node, held = todo.pop()
            x0, y0, x1, y1 = self.boxes[node]
            dx, dy = np.maximum(np.maximum(x0 - x[held], x[held] - x1), 0), np.maximum(np.maximum(y0 - y[held], y[held] - y1), 0)
            held = held[np.sqrt(dx * dx + dy * dy) <= radius[held]] if x0 <= x1 else held[:0]
            if not len(held):
                continue
            if self.axis[node] < 0:
                who.append(held)
                where.append(np.full(len(held), node))
            else:
                todo += [(2 * node + 1, held), (2 * node + 2, held)]
        none = np.zeros(0, np.int64)
        return (np.concatenate(who), np.concatenate(where)) if who else (none, none)


def k_best(qx: np.ndarray, qy: np.ndarray, limit: np.ndarray, px: np.ndarray, py: np.ndarray, ids: np.ndarray, k: int, near: float):
    """(place of the asking point, id, distance) of its k nearest points within a limit, ties by id; points closer than `near` on both axes, and equal ones, are itself."""
    rows, found, away = [], [], []
    step = max(1, BLOCK // max(1, len(px)))
    for i in range(0, len(qx), step):
        dx, dy = qx[i : i + step, None] - px, qy[i : i + step, None] - py
        d = np.sqrt(dx * dx + dy * dy)
        d[((np.abs(dx) < near) & (np.abs(dy) < near)) | (d == 0)] = np.inf
        d[d > limit[i : i + step, None]] = np.inf
        some = min(k, len(px))
        edge = np.partition(d, some - 1, axis=1)[:, some - 1]
        r, c = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
        order = np.lexsort((ids[c], d[r, c], r))
        r, c = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, c = r[place < k], c[place < k]
        rows.append(r + i)
        found.append(ids[c])
        away.append(d[r, c])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(away)


def _schemas(qid: DataType, id_: DataType) -> tuple[StructType, StructType]:
    """What the first comparison tells of an asking point, and what the later ones find."""
    d, many = DoubleType(), ArrayType
    first = [("qid", qid), ("x", d), ("y", d), ("limit", d), ("found", many(id_)), ("away", many(d)), ("leaves", many(IntegerType()))]
    return StructType([StructField(*f) for f in first]), StructType([StructField("qid", qid), StructField("id", id_), StructField("distance", d)])


def _arrays(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t[c].to_numpy() for c in names]


def _own_leaf(tree: Tree, k: int, near: float, schema: pa.Schema):
    def run(asks: pa.Table, points: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return schema.empty_table()
        x, y = _arrays(asks, "x", "y")
        px, py, ids = _arrays(points, "x", "y", "id")
        n = len(x)
        r, found, away = k_best(x, y, np.full(n, np.inf), px, py, ids, k, near) if len(px) else (np.zeros(0, np.int64), ids[:0], np.zeros(0))
        size = np.bincount(r, minlength=n)
        ends = np.cumsum(size)
        limit = np.full(n, np.inf)
        full = size == k
        limit[full] = away[ends[full] - 1]
        who, leaves = tree.reached(x, y, limit)
        own = asks["leaf"][0].as_py()
        who, leaves = who[leaves != own], leaves[leaves != own]
        order = np.argsort(who, kind="stable")
        offsets = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=n)))).astype(np.int32)
        lists = np.concatenate(([0], ends)).astype(np.int32)
        columns = [asks["qid"].combine_chunks(), pa.array(x), pa.array(y), pa.array(limit), pa.ListArray.from_arrays(lists, pa.array(found, schema.field("found").type.value_type)), pa.ListArray.from_arrays(lists, pa.array(away, pa.float64()))]
        columns.append(pa.ListArray.from_arrays(offsets, pa.array(leaves[order].astype(np.int32))))
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _other_leaf(k: int, near: float, schema: pa.Schema):
    def run(asks: pa.Table, points: pa.Table) -> pa.Table:
        x, y, limit = _arrays(asks, "x", "y", "limit")
        px, py, ids = _arrays(points, "x", "y", "id")
        r, found, away = k_best(x, y, limit, px, py, ids, k, near) if len(x) and len(px) else (np.zeros(0, np.int64), ids[:0], np.zeros(0))
        columns = [asks["qid"].combine_chunks().take(pa.array(r, pa.int64())), pa.array(found, schema.field("id").type), pa.array(away, pa.float64())]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _dealt(asks: DataFrame, points: DataFrame, run, schema: StructType) -> DataFrame:
    """Asks and points of a leaf together; the asks of a leaf that very many reach are dealt to several tasks, each with the leaf's points."""
    parts = {r.leaf: -(-r.n // ASKS) for r in asks.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > ASKS).collect()}  # leaves are bounded
    of = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]) if parts else None
    many = F.coalesce(F.try_element_at(of, F.col("leaf")), F.lit(1)) if parts else F.lit(1)
    left = asks.withColumn("part", F.pmod(F.xxhash64("qid"), many.cast("long")).cast("int"))
    right = points.withColumn("part", F.explode(F.sequence(F.lit(0), many - 1)))
    return left.groupBy("leaf", "part").cogroup(right.groupBy("leaf", "part")).applyInArrow(run, schema)


def nearest(asks: DataFrame, points: DataFrame, k: int, near: float = 0.0, leaf: int = LEAF) -> DataFrame:
    """(qid, id, distance, rank): the k nearest of points (id, x, y) for each of asks (qid, x, y), ties by id; ids are numbers or texts.

    Points in the very place of an asking one, or nearer than `near` on both axes, are not its neighbours. Rows with a null coordinate or id ask and answer nothing; where there are
    fewer than k other points, all are given; without points or asks the result is empty. The leaves' splits come from a sample
    of SAMPLED points a leaf; there are MOST_LEAVES at most, beyond which leaves grow and are compared in blocks.
    """
    good = lambda df, c: df.select(c, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    points, asks = good(points, "id"), good(asks, "qid")
    first_schema, later_schema = _schemas(asks.schema["qid"].dataType, points.schema["id"].dataType)
    n = points.count()
    leaves = min(MOST_LEAVES, max(1, n // leaf))
    sample = points.select("x", "y").sample(min(1.0, SAMPLED * leaves / max(1, n)), seed=3).toPandas().to_numpy(dtype=float).reshape(-1, 2)
    tree = Tree.of_sample(sample, leaves)

    @F.pandas_udf("int")
    def leaf_of(x, y):
        return pd.Series(tree.leaf_of(x.to_numpy(), y.to_numpy()).astype(np.int32))

    points = cut(points.withColumn("leaf", leaf_of("x", "y")), "leaves")
    extent = points.groupBy("leaf").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).toPandas().to_numpy(dtype=float).reshape(-1, 5)
    tree = tree.with_boxes(extent[:, 0].astype(int), extent[:, 1:])
    first = cut(_dealt(asks.withColumn("leaf", leaf_of("x", "y")), points, _own_leaf(tree, k, near, to_arrow_schema(first_schema)), first_schema), "first")
    later = first.select("qid", "x", "y", "limit", F.explode("leaves").alias("leaf"))
    later = _dealt(later, points, _other_leaf(k, near, to_arrow_schema(later_schema)), later_schema)
    own = first.select("qid", F.explode(F.arrays_zip("found", "away")).alias("z")).select("qid", F.col("z.found").alias("id"), F.col("z.away").alias("distance"))
    return _top(own.unionByName(later), k)


def _top(rows: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)
