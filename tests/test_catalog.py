"""A few registered queries against their SQL, and the driver's contract."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", ["k15_polygon_graph_degree", "v1_v8_vector_arithmetic", "j2_mutual_filter", "j11_j12_adjacent_tiles", "l1_l10_layer_edits", "r1_r16_graph_edits", "g1_g4_centralities"])
def test_query_equals_sql(spark, name):
    from geoweave.plans import catalog

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    rel = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(str, r)) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
