"""Deterministic geometry layers derived from the driver's tables, which hold none of their own.

Coordinates are small integers cast to double, so sums and products are exact in any engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions import areal as A
from geoweave.functions import vectors as V
from geoweave.operators.storage import cut


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """The rows in two tasks for each core: a table's file may be one group of rows, which is one task, and each row is much work."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *key)


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles: id, box, area."""
    p = dealt(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").selectExpr(
        "p_partkey AS id", "cast((p_partkey*7919)%1000 AS double) AS x0", "cast((p_partkey*104729)%1000 AS double) AS y0",
        "cast(1+p_size%10 AS double) AS w", "cast(1+p_partkey%5 AS double) AS h",
    )
    box = A.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    return p.withColumn("box", box).withColumn("area", F.col("w") * F.col("h"))


PARCELS = """parcels AS (
  SELECT id, x0, y0, w, h, x0 AS xmin, y0 AS ymin, x0+w AS xmax, y0+h AS ymax, w*h AS area FROM (
    SELECT p_partkey AS id, cast((p_partkey*7919)%1000 AS double) AS x0, cast((p_partkey*104729)%1000 AS double) AS y0,
           cast(1+p_size%10 AS double) AS w, cast(1+p_partkey%5 AS double) AS h FROM part))"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: id, x, y, weight."""
    s = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_suppkey AS id", "s_acctbal AS weight")
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "10000000 + c_custkey AS id", "c_acctbal AS weight")
    return dealt(s.union(c), "id").selectExpr("id", "cast((k*37)%503 AS double) AS x", "cast((k*91)%509 AS double) AS y", "weight")


SITES = """sites AS (
  SELECT id, cast((k*37)%503 AS double) AS x, cast((k*91)%509 AS double) AS y, weight FROM (
    SELECT s_suppkey AS k, s_suppkey AS id, s_acctbal AS weight FROM supplier
    UNION ALL SELECT c_custkey, 10000000 + c_custkey, c_acctbal FROM customer))"""


def told_by_kind(rows: DataFrame, of: list[str], tell: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns that tell(kinds) adds to the columns `of`: what only these decide is told once for rows that are equal in them.

    kinds has a row for each; nulls are equal here. All kinds are told, in two tasks for each core, and each row gets what its kind has.
    """
    kinds = dealt(rows.select(*of).distinct(), *of)
    told = cut(tell(kinds), "kinds")
    same = reduce(and_, [rows[c].eqNullSafe(told[c]) for c in of])
    return rows.join(told, same).select(*[rows[c] for c in rows.columns], *[told[c] for c in told.columns if c not in of])


def lot_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decides a lot's shape: id, kind, x, y, s."""
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_partkey%4 AS kind", "cast((p_partkey*7919)%1000 AS double) AS x", "cast((p_partkey*104729)%1000 AS double) AS y",
        "cast(4+4*(p_size%4) AS double) AS s",
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons by p_partkey % 4: box, triangle, rhombus, box with a box hole. Sides are 4 to 16."""
    return shaped(dealt(lot_frames(spark, sf_dir), "id"))


#: The columns of lot_frames() that decide the shape.
FRAME = ["kind", "x", "y", "s"]


def shaped(p: DataFrame) -> DataFrame:
    """Frames of lots with their polygons."""
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    at = lambda dx, dy: V.point(x + dx * s, y + dy * s)
    box = F.array(at(0, 1), at(1, 1), at(1, 0), at(0, 0))
    rings = F.when(F.col("kind") == 1, F.array(at(0, 0), at(1, 0), at(0, 1))).when(F.col("kind") == 2, F.array(at(0.5, 1), at(1, 0.5), at(0.5, 0), at(0, 0.5))).otherwise(box)
    hole = F.array(at(0.25, 0.75), at(0.75, 0.75), at(0.75, 0.25), at(0.25, 0.25))
    holes = F.when(F.col("kind") == 3, F.array(hole)).otherwise(F.array().cast(f"array<{A.RING}>"))
    return p.withColumn("geom", F.struct(rings.alias("boundary"), holes.alias("holes")))


LOTS = """lots AS (
  SELECT id, kind, x, y, s,
    CASE kind WHEN 1 THEN [{'x':x,'y':y},{'x':x+s,'y':y},{'x':x,'y':y+s}]
      WHEN 2 THEN [{'x':x+0.5*s,'y':y+s},{'x':x+s,'y':y+0.5*s},{'x':x+0.5*s,'y':y},{'x':x,'y':y+0.5*s}]
      ELSE [{'x':x,'y':y+s},{'x':x+s,'y':y+s},{'x':x+s,'y':y},{'x':x,'y':y}] END AS ring,
    CASE kind WHEN 3 THEN [{'x':x+0.25*s,'y':y+0.75*s},{'x':x+0.75*s,'y':y+0.75*s},{'x':x+0.75*s,'y':y+0.25*s},{'x':x+0.25*s,'y':y+0.25*s}] ELSE NULL END AS hole
  FROM (SELECT p_partkey AS id, p_partkey%4 AS kind, cast((p_partkey*7919)%1000 AS double) AS x,
          cast((p_partkey*104729)%1000 AS double) AS y, cast(4+4*(p_size%4) AS double) AS s FROM part))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two real-valued vectors a, b for each embedding."""
    e = read(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select(F.col("vec_id").alias("id"), V.point(at(0), at(1)).alias("a"), V.point(at(2), at(3)).alias("b"))


VECTORS = """vecs AS (
  SELECT vec_id AS id, embedding[1]::double AS ax, embedding[2]::double AS ay, embedding[3]::double AS bx, embedding[4]::double AS by_ FROM embeddings)"""


def supply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts and suppliers (as negative ids), one for each order line."""
    return read(spark, sf_dir, "lineitem").select((-F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of all order lines, each once."""
    return supply_lines(spark, sf_dir).distinct()


SUPPLY = "supply AS (SELECT DISTINCT -l_suppkey AS src, l_partkey AS dst FROM lineitem)"
