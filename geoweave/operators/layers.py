"""Layers: DataFrames with a geometry column; fields are columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, StringType

GEOM = "geom"
MAX_FIELD_NAME = 10
FIELD_TYPES: dict[str, DataType] = {"integer": IntegerType(), "double": DoubleType(), "text": StringType(), "size": LongType()}


def geometries(layer: DataFrame) -> DataFrame:
    return layer.select(GEOM)


def add_field(layer: DataFrame, name: str, kind: str) -> DataFrame:
    """A field without values. Names have at most ten characters and are unique."""
    if len(name) > MAX_FIELD_NAME:
        raise ValueError(f"field name {name!r} has more than {MAX_FIELD_NAME} characters")
    if name in layer.columns:
        raise ValueError(f"field {name!r} exists")
    return layer.withColumn(name, F.lit(None).cast(FIELD_TYPES[kind]))


def has_field(layer: DataFrame, name: str, kind: str | None = None) -> bool:
    return name in layer.columns and (kind is None or layer.schema[name].dataType == FIELD_TYPES[kind])


def remove_field(layer: DataFrame, name: str) -> DataFrame:
    return layer.drop(name) if name != GEOM else layer


def clear_fields(layer: DataFrame) -> DataFrame:
    return layer.select(GEOM)


def copy_fields(layer: DataFrame, other: DataFrame) -> DataFrame:
    """Add the fields of another layer that this one lacks, without values."""
    return layer.withColumns({f.name: F.lit(None).cast(f.dataType) for f in other.schema if f.name not in layer.columns})


def add_attribute(layer: DataFrame, name: str, value: Column) -> DataFrame:
    """Set a value only where there is none."""
    return layer.withColumn(name, F.coalesce(F.col(name), value))


def set_attribute(layer: DataFrame, name: str, value: Column) -> DataFrame:
    return layer.withColumn(name, value)


def remove_attribute(layer: DataFrame, name: str) -> DataFrame:
    return layer.withColumn(name, F.lit(None).cast(layer.schema[name].dataType))


def merge(*layers: DataFrame) -> DataFrame:
    """All features of all layers with the union of their fields."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def contains_geometry(layer: DataFrame, others: DataFrame, key: Column) -> DataFrame:
    """Rows of layer whose canonical geometry key is in others."""
    return layer.withColumn("__key", key).join(others.select(key.alias("__key")).distinct(), "__key", "left_semi").drop("__key")


def remove_geometry(layer: DataFrame, others: DataFrame, key: Column) -> DataFrame:
    return layer.withColumn("__key", key).join(others.select(key.alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def common_box(layer: DataFrame, box: str = "box") -> DataFrame:
    """One row with the box of all boxes; an empty layer is an error when it is read."""
    b = F.col(box)
    agg = layer.agg(F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"), F.count(box).alias("n"))
    return agg.withColumn("n", F.when(F.col("n") == 0, F.raise_error(F.lit("the layer is empty")).cast("long")).otherwise(F.col("n"))).select("xmin", "ymin", "xmax", "ymax", "n")


def split(layer: DataFrame, splits: int, x: Column, y: Column, box: DataFrame) -> DataFrame:
    """layer with tx, ty: tiles of a grid of splits + 1 by splits + 1 over the box; the far edges belong to the last tiles."""
    n = splits + 1
    tile = lambda v, lo, hi: F.least(F.lit(n - 1), F.floor((v - F.col(lo)) / F.when(F.col(hi) == F.col(lo), 1.0).otherwise(F.col(hi) - F.col(lo)) * n)).cast("int")
    wide = layer.join(F.broadcast(box.select("xmin", "ymin", "xmax", "ymax")))
    return wide.withColumn("tx", tile(x, "xmin", "xmax")).withColumn("ty", tile(y, "ymin", "ymax")).drop("xmin", "ymin", "xmax", "ymax")


def empty_copy(layer: DataFrame) -> DataFrame:
    return layer.sparkSession.createDataFrame([], layer.schema)


def with_crs(layer: DataFrame, crs: str) -> DataFrame:
    return layer.withMetadata(GEOM, {"crs": crs})


def crs_of(layer: DataFrame) -> str:
    return layer.schema[GEOM].metadata.get("crs", "")
