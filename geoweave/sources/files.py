"""GIS files: types by extension, listing, bundles, and versioned output paths."""

from __future__ import annotations

import os
import re
import shutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types by extension, and the parts of a shapefile bundle.
EXTENSIONS = {".shp": "SHP", ".tif": "TIFF", ".tiff": "TIFF", ".gpkg": "GPKG"}
BUNDLE = (".shp", ".shx", ".dbf", ".prj")
OPTIONAL = (".cpg", ".qmd", ".qix", ".sbn", ".sbx", ".idm", ".ind")


def file_type(path: Column) -> Column:
    """Type by the extension, which is case sensitive; null for other files."""
    out = F.lit(None).cast("string")
    for ext, kind in EXTENSIONS.items():
        out = F.when(path.endswith(ext), kind).otherwise(out)
    return out


def list_gis_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, type) of the GIS files of a folder (not of its subfolders), or of one file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path")
    return files.withColumn("type", file_type(F.col("path"))).where("type is not null")


def as_shapefile(path: str) -> str:
    """The shapefile that stands for a file: itself, or the one beside an image."""
    stem, ext = os.path.splitext(path)
    if ext not in EXTENSIONS or ext == ".gpkg":
        raise ValueError(f"{path} is not a supported file")
    return stem + ".shp"


def change_name(path: str, name: str) -> str:
    return os.path.join(os.path.dirname(path), name + os.path.splitext(path)[1])


def append_to_name(path: str, suffix: str) -> str:
    stem, ext = os.path.splitext(path)
    return stem + suffix + ext


def next_version(path: str) -> str:
    """path itself if it is free, else with _1 appended or a _N at its end raised, until it is."""
    while os.path.exists(path):
        stem, ext = os.path.splitext(path)
        m = re.fullmatch(r"(.*)_(\d+)", stem)
        path = f"{m[1]}_{int(m[2]) + 1}{ext}" if m else f"{stem}_1{ext}"
    return path


def parts_of(path: str) -> list[str]:
    stem = os.path.splitext(path)[0]
    return [stem + e for e in (*BUNDLE, *OPTIONAL) if os.path.exists(stem + e)]


def is_complete(path: str) -> bool:
    stem = os.path.splitext(path)[0]
    return all(os.path.exists(stem + e) for e in BUNDLE)


def remove(path: str) -> int:
    found = parts_of(path) if path.endswith(".shp") else [path] * os.path.exists(path)
    for f in found:
        os.remove(f)
    return len(found)


def copy(path: str, target: str) -> None:
    stem = os.path.splitext(target)[0]
    for f in parts_of(path) if path.endswith(".shp") else [path]:
        shutil.copyfile(f, stem + os.path.splitext(f)[1])


def move(path: str, target: str) -> None:
    copy(path, target)
    remove(path)


def try_read(spark: SparkSession, path: str, **options) -> tuple[DataFrame | None, str | None]:
    """(layer, None), or (None, reason)."""
    from geoweave.sources import shapefile

    try:
        shapefile.register(spark)
        return spark.read.format("shapefile").options(**options).load(path), None
    except Exception as e:  # the reason is the value
        return None, str(e).splitlines()[0]


def overwrite(layer: DataFrame, path: str) -> None:
    from geoweave.sources import shapefile

    shapefile.register(layer.sparkSession)
    layer.write.format("shapefile").mode("overwrite").save(path)


def write(layer: DataFrame, path: str) -> str:
    """Write to path, or to its next free version; returns where."""
    at = next_version(path)
    from geoweave.sources import shapefile

    shapefile.register(layer.sparkSession)
    layer.write.format("shapefile").mode("append").save(at)
    return at


def results_of(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Layers (bundles, or folders of them) in a folder whose names start with prefix, in order of name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}*")
    found = [str(x.getPath()) for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []]
    return sorted(x for x in found if x.endswith(".shp") or "." not in x.rsplit("/", 1)[-1])
