"""Pairs of copies are made of lists of ids, and what two kinds have in common is told once."""

import pytest

from geoweave.operators import spatial_join
from geoweave.plans import catalog, catalog_arrangements  # noqa: F401  registers the queries


@pytest.mark.parametrize("carried, waiting", [(2, 3), (32, 1024)])
def test_pairs_of_lists_are_all_pairs(spark, monkeypatch, carried, waiting):
    monkeypatch.setattr(spatial_join, "CARRIED", carried)
    monkeypatch.setattr(spatial_join, "WAITING", waiting)
    kinds = {1: [1, 4, 9, 12, 30, 31, 32, 33, 34], 2: [2, 3, 5], 6: [6], 7: list(range(100, 140))}
    pairs = [(1, 2, "p"), (1, 7, "q"), (2, 2, "r"), (6, 7, "s"), (7, 7, "t"), (6, 6, "u")]
    members = spark.createDataFrame([(k, i) for k, ids in kinds.items() for i in ids], "kind long, id long")
    got = spatial_join.expanded_kinds(spark.createDataFrame(pairs, "a long, b long, name string"), members).collect()
    want = [(min(i, j), max(i, j), n, i > j) for a, b, n in pairs for i in kinds[a] for j in kinds[b] if a != b or i < j]
    assert sorted((r.a, r.b, r.name, r.turned) for r in got) == sorted(want)
    empty = members.limit(0)
    assert spatial_join.expanded_kinds(spark.createDataFrame(pairs, "a long, b long, name string"), empty).count() == 0


def test_crossings_are_rounded_before_their_pairs_are_made(spark, tmp_path):
    spark.range(1, 31).selectExpr("(id - 1) % 10 + 1 + 1000 * ((id - 1) div 10) AS p_partkey", "cast(id AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.queries()["j1_segment_crossings"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "round(" not in plan and "Generate explode(b_ids" in plan
    made = df.collect()
    assert len(made) == len({(r.a, r.b) for r in made}) and all(r.a < r.b and r.x == round(r.x, 4) for r in made)
    # the diagonals of each of the 30 parcels meet
    assert {r.a for r in made if r.a > 0 and r.a % 2 == 0 and r.b == r.a + 1} == {2 * r.p_partkey for r in spark.read.parquet(f"{tmp_path}/part.parquet").collect()}
