"""The shapefile source: splits, pushed boxes, commit, abort, long names and texts."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.functions import areal as A
from geoweave.functions import kernels
from geoweave.sources import files, shapefile


def squares(spark, n, parts=3):
    x = F.col("id").cast("double")
    ring = A.box_ring(x, x, x + 1, x + 2)
    return spark.range(n).repartition(parts, "id").select("id", F.concat(F.lit("n"), "id").alias("name"), A.polygon(ring).alias("geom"))


@pytest.fixture
def source(spark):
    shapefile.register(spark)
    return lambda path, **options: spark.read.format("shapefile").options(**options).load(path)


def test_a_file_is_read_by_many_tasks(spark, source, tmp_path):
    path = f"file://{tmp_path}/layer"
    squares(spark, 1000, 1).write.format("shapefile").mode("overwrite").save(path)
    assert len(glob.glob(f"{tmp_path}/layer/*.shp")) == 1
    back = source(path, records=64)
    assert back.rdd.getNumPartitions() == 16
    got = back.select("id", "name", A.polygon_area(F.col("geom")).alias("a")).orderBy("id").collect()
    assert [(r.id, r.name, r.a) for r in got] == [(i, f"n{i}", 2.0) for i in range(1000)]
    os.remove(glob.glob(f"{tmp_path}/layer/*.shx")[0])  # without an index one task walks through it
    assert source(path, records=64).rdd.getNumPartitions() == 1 and source(path).count() == 1000


def test_boxes_are_pushed_to_the_records(spark, source, tmp_path):
    path = str(tmp_path / "layer")
    squares(spark, 300).write.format("shapefile").mode("overwrite").save(path)
    near = source(path, boxes=True).where("xmax >= 100 and xmin < 110 and name <> 'n105'")
    assert sorted(r.id for r in near.collect()) == [*range(99, 105), *range(106, 110)]
    assert source(path, boxes=True).where("ymin <= 3").count() == 4
    reader = shapefile._BoxReader(shapefile.ShapefileSource({"path": path, "boxes": "true"}).schema(), {"path": path, "boxes": "true"})
    filters = [shapefile.GreaterThan(("xmin",), 290), shapefile.LessThanOrEqual(("id",), 3)]
    assert list(reader.pushFilters(filters)) == filters[1:]
    assert sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == list(range(291, 300))


def test_a_failed_job_leaves_the_old_layer(spark, source, tmp_path):
    path = str(tmp_path / "layer")
    squares(spark, 50).write.format("shapefile").mode("overwrite").save(path)
    bad = squares(spark, 40).withColumn("name", F.when(F.col("id") == 33, F.raise_error(F.lit("no"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("shapefile").mode("overwrite").save(path)
    assert source(path).count() == 50 and not glob.glob(f"{path}/_staging*")
    squares(spark, 7).write.format("shapefile").mode("append").save(path)
    assert source(path).count() == 57
    squares(spark, 9).write.format("shapefile").mode("overwrite").save(path)
    assert source(path).count() == 9
    squares(spark, 9).where("id < 0").write.format("shapefile").mode("overwrite").save(path)
    assert source(path).count() == 0 and source(path).columns == ["id", "name", "geom"]


def test_tasks_write_bundles_of_bounded_size(spark, source, tmp_path):
    path = str(tmp_path / "layer")
    squares(spark, 500, 1).write.format("shapefile").option("bundleBytes", 20_000).mode("overwrite").save(path)
    assert len(glob.glob(f"{path}/*.shp")) > 3 and source(path).count() == 500
    assert files.try_read(spark, str(tmp_path / "none"))[1]


def test_names_and_texts_are_cut_between_characters(spark, source, tmp_path):
    path = str(tmp_path / "layer")
    df = squares(spark, 2).withColumns({"measured_value_a": F.lit(1), "measured_value_b": F.lit(2), "größenmaße": F.repeat(F.lit("é"), 200)})
    df.write.format("shapefile").mode("overwrite").save(path)
    back = source(path)
    assert back.columns == ["id", "name", "measured_v", "measured_1", "größenma", "geom"]
    r = back.first()
    text = r["größenma"]
    assert (r.measured_v, r.measured_1) == (1, 2)
    assert text == "é" * 127


def test_records_of_a_run_are_decoded_together(spark, source, tmp_path, monkeypatch):
    path, asked = str(tmp_path / "layer"), []
    squares(spark, 300, 1).write.format("shapefile").mode("overwrite").save(path)
    for kernel in ("ring_valid", "rings_valid"):
        monkeypatch.setattr(kernels, kernel, lambda x, f=getattr(kernels, kernel): asked.append(len(x)) or f(x))
    given = shapefile.ShapefileSource({"path": path})
    reader = given.reader(given.schema())
    (batch,) = [b for p in reader.partitions() for b in reader.read(p)]
    assert batch.num_rows == 300 and batch.schema.names == ["id", "name", "geom"] and asked == [300]


def test_blocks_of_rings_answer_as_single_ones():
    rng, seen = np.random.default_rng(5), set()
    for n, m, wide in rng.integers(3, 7, (60, 3)).tolist():
        a, b = rng.integers(0, wide, (30, n, 2)).astype(float), rng.integers(0, wide, (30, m, 2)) / 2
        valid, inside = kernels.rings_valid(a), kernels.rings_contain(a, b)
        assert inside.tolist() == [not (kernels.sides(y, x) == kernels.OUT).any() for x, y in zip(a, b)]
        # valid: no edges meet but neighbours in their common end, and neighbours are not folded
        for x, ok in zip(a, valid.tolist()):
            p, q = kernels.edges(x)
            apart = [(i, j) for i in range(n) for j in range(i + 2, n) if (i, j) != (0, n - 1)]
            met = any(kernels.closest_points_of_all(np.array([p[i], q[i]]), np.array([p[j], q[j]]))[0] < 1e-9 or _crossed(p[i], q[i], p[j], q[j]) for i, j in apart)
            folded = any(abs(kernels.cross2(q[i] - p[i], q[(i + 1) % n] - q[i])) < 1e-9 and (q[i] - p[i]) @ (q[(i + 1) % n] - q[i]) < 0 for i in range(n))
            assert ok == (not met and not folded and not (p == q).all(axis=1).any())
        seen |= set(valid.tolist()) | {(x,) for x in inside.tolist()}
    assert seen == {True, False, (True,), (False,)}


def _crossed(a, b, c, d):
    return kernels.cross2(b - a, c - a) * kernels.cross2(b - a, d - a) < 0 and kernels.cross2(d - c, a - c) * kernels.cross2(d - c, b - c) < 0


def test_holes_go_to_the_first_boundary_around_them(spark, source, tmp_path):
    ring = lambda *points: [(float(x), float(y)) for x, y in points]
    box = lambda x, y, s: ring((x, y + s), (x + s, y + s), (x + s, y), (x, y))
    rows = [
        (2**53 + 1, "two parts, three holes", [(box(0, 0, 9), [box(1, 1, 2)[::-1], box(5, 5, 2)[::-1]]), (box(20, 0, 5), [box(21, 1, 1)[::-1]])]),
        (2, "a hole outside", [(box(0, 0, 3), [box(7, 7, 1)[::-1]])]),
        (3, "a bad boundary and a good one", [(ring((0, 0), (2, 2), (2, 0), (0, 2.5)), []), (box(5, 5, 1), [])]),
        (4, "bad only", [(ring((0, 0), (2, 2), (2, 0), (0, 2.5)), [])]),
        (5, None, [(box(0, 0, 9), [ring((1, 1), (2, 2), (2, 1), (1, 2.5)), box(4, 4, 1)[::-1]])]),
    ]
    df = spark.createDataFrame(rows, "id long, name string, geom array<struct<boundary:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>>>")
    df.coalesce(1).write.format("shapefile").mode("overwrite").save(str(tmp_path / "layer"))
    multi = {r.id: (r.name, [(len(p.boundary), sorted(min(q.x for q in h) for h in p.holes)) for p in r.geom]) for r in source(str(tmp_path / "layer"), geometry="multi").collect()}
    assert multi == {
        2**53 + 1: ("two parts, three holes", [(4, [1, 5]), (4, [21])]), 2: ("a hole outside", [(4, [])]), 3: ("a bad boundary and a good one", [(4, [])]), 5: ("", [(4, [4])]),
    }
    assert sorted(r.id for r in source(str(tmp_path / "layer")).collect()) == [2, 3, 5]


def test_tasks_get_more_records_before_they_are_very_many(spark, source, tmp_path, monkeypatch):
    path = str(tmp_path / "layer")
    squares(spark, 500, 1).write.format("shapefile").mode("overwrite").save(path)
    given = shapefile.ShapefileSource({"path": path, "records": "2"})
    ranges = lambda: [(p.first, p.end) for p in given.reader(given.schema()).partitions()]
    assert ranges() == [(i, i + 2) for i in range(0, 500, 2)]
    monkeypatch.setattr(shapefile, "TASKS", 50)
    assert ranges() == [(i, i + 10) for i in range(0, 500, 10)]
    monkeypatch.setattr(shapefile, "RECORDS", 5)  # but never more than this, if not asked for
    assert ranges() == [(i, i + 5) for i in range(0, 500, 5)]


def test_what_is_written_does_not_depend_on_the_batches(spark, source, tmp_path):
    x = F.col("id").cast("double")
    ring, hole = A.box_ring(x, x, x + 4, x + 4), A.box_ring(x + 1, x + 1, x + 2, x + 2)
    df = spark.range(60).select(
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("é"), "id")).alias("name"),
        F.when(F.col("id") % 3 > 0, F.struct(F.when(F.col("id") % 2 > 0, F.reverse(ring)).otherwise(ring).alias("boundary"), F.array(hole).alias("holes"))).alias("geom"),
    ).coalesce(1)
    found = []
    for size in (3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        df.write.format("shapefile").mode("overwrite").save(str(tmp_path / f"by{size}"))
        found.append([open(glob.glob(f"{tmp_path}/by{size}/*{ext}")[0], "rb").read() for ext in (".shp", ".shx", ".dbf")])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1]
    got = {r.name: (r.id, len(r.geom.boundary), len(r.geom.holes), r.area) for r in source(str(tmp_path / "by3")).withColumn("area", A.polygon_area(F.col("geom"))).collect()}
    assert len(got) == 33 and got["é1"] == (1, 4, 1, 15.0) and got["é7"] == (0, 4, 1, 15.0) and got[""][1:] == (4, 1, 15.0)
    # records of the file: numbered from 1, boundaries clockwise, rings closed
    index = np.frombuffer(found[0][1][100:], ">i4").reshape(-1, 2) * 2
    for k, (at, size) in enumerate(index.tolist()):
        body = found[0][0][at + 8 : at + 8 + size]
        assert np.frombuffer(found[0][0][at : at + 4], ">i4")[0] == k + 1 and np.frombuffer(body[36:52], "<i4").tolist() == [2, 10, 0, 5]
        xy = np.frombuffer(body[52:], "<f8").reshape(-1, 2)
        assert (xy[[0, 5]] == xy[[4, 9]]).all() and shapefile.signed(xy[:4]) == -16 and shapefile.signed(xy[5:9]) == 1
        assert np.frombuffer(body[4:36], "<f8").tolist() == [*xy.min(axis=0), *xy.max(axis=0)]
