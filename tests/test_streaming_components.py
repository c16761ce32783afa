"""Components of a stream: as in a batch, late edges, restart."""

import datetime

import pytest
from pyspark.sql import functions as F

from geoweave.streaming.components import ClosingComponents, window_components

START = datetime.datetime(2024, 1, 1)
SCHEMA = "src long, dst long, ts timestamp"


def minutes(*rows):
    return [(s, d, START + datetime.timedelta(minutes=m)) for s, d, m in rows]


FILES = [
    minutes((1, 2, 0), (3, 4, 5), (2, 3, 50), (9, 9, 10)),
    minutes((5, 6, 65), (1, 7, 58), (8, 2, 70)),
    minutes((6, 8, 70), (1, 2, 115), (2, 5, 20), (1, 9, 135)),  # the third comes after its window was closed
    minutes((4, 4, 300)),
]


@pytest.fixture
def folder(spark, tmp_path):
    for k, rows in enumerate(FILES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/all/{k}")
    return tmp_path


def feed(spark, folder, upto):
    import glob
    import os
    import shutil

    os.makedirs(folder / "in", exist_ok=True)
    for k in range(upto):
        if not (folder / "in" / f"{k}.parquet").exists():
            shutil.copy(glob.glob(f"{folder}/all/{k}/part-*.parquet")[0], folder / "in" / f"{k}.parquet")
            os.utime(folder / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def rows(df):
    return sorted((r.end, r.component, r.nodes, r.edges) for r in df.collect())


def run(spark, folder, upto):
    stream = ClosingComponents(spark, f"file://{folder}/work")
    stream.start(feed(spark, folder, upto), availableNow=True).awaitTermination()
    return stream


def test_stream_and_batch_agree_and_late_edges_are_counted(spark, folder):
    stream = run(spark, folder, 4)
    on_time = [r for f in FILES for r in f if r != FILES[2][2]]
    batch = window_components(spark.createDataFrame(on_time, SCHEMA)).where(F.col("end") <= F.lit(START + datetime.timedelta(minutes=290)))
    assert rows(stream.closed()) == rows(batch) and stream.late() == 1
    first = [r for r in rows(stream.closed()) if r[0] == START + datetime.timedelta(hours=1)]
    assert [r[1:] for r in first] == [(1, 5, 4), (9, 1, 1)]


def test_a_restart_goes_on_from_the_checkpoint(spark, folder):
    first = run(spark, folder, 2)
    before = rows(first.closed())
    again = run(spark, folder, 4)  # a new query over the same folder
    assert set(before) <= set(rows(again.closed())) and again.late() == 1
    whole = ClosingComponents(spark, f"file://{folder}/other")
    whole.start(feed(spark, folder, 4), availableNow=True).awaitTermination()
    assert rows(whole.closed()) == rows(again.closed())
    # a batch that is run again, as after a crash, writes the same again
    again.batch(spark.createDataFrame(FILES[3], SCHEMA), 3)
    assert rows(whole.closed()) == rows(again.closed())
