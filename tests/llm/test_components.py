"""Components of edge tables: ties within tasks, and how many shuffles a small table costs."""

import random

import pytest
from pyspark.sql import functions as F

from geoweave.llm import components


def _expected(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(label[u], label[v])
            if label[u] != low or label[v] != low:
                label[u] = label[v] = low
                changed = True
    return {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("slice_edges", [1 << 20, 7])
def test_components_of_a_path_and_random_edges(spark, monkeypatch, slice_edges):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)] + [(-(2**63), 2**63 - 1), (70, 70)]
    monkeypatch.setattr(components, "SLICE_EDGES", slice_edges)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(slice_edges, 10000))
    got = components.star_components(spark.createDataFrame(edges, "u long, v long").repartition(5))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.node: r.component for r in got.collect()} == _expected(edges)


def test_a_small_table_needs_no_rounds(spark, monkeypatch):
    """Each shuffle holds a thread of the driver for a minute; rounds on small tables made it run out of memory."""
    written = []
    keep = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append(name) or keep(df, name))
    got = components.star_components(spark.range(1000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert got.agg(F.max("component"), F.count("*")).first() == (0, 1001)
    assert written == ["edges"]
