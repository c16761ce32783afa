"""Tables that the planner takes for small, but that are not, are not broadcast."""

import numpy as np
from pyspark.sql import functions as F

from geoweave.llm import components, simhash, suffix_dedup
from geoweave.llm.common import ROW_ID, with_row_id


def broadcast_parts(df) -> list[str]:
    """The plans below each broadcast of df."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


def test_exploded_keys_and_bands_are_not_broadcast(spark, tmp_path, monkeypatch):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    rng = np.random.default_rng(7)
    words = [f"w{x}" for x in rng.integers(0, 900, 6000)]
    texts = [" ".join(words[k * 60 : k * 60 + 60]) for k in range(100)]
    texts += [t + " more" for t in texts[:20]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    seen = []

    def kept(real):
        return lambda df, name: (seen.append(df), real(df, name))[1]

    monkeypatch.setattr(simhash, "materialize", kept(simhash.materialize))
    monkeypatch.setattr(components, "materialize", kept(components.materialize))
    got = simhash.keep_one_similar(spark.read.parquet(f"{tmp_path}/docs"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(100))
    parts = [x for df in seen for x in broadcast_parts(df)]
    assert seen and not [x for x in parts if "Generate" in x or "text" in x]


def test_texts_are_not_broadcast_to_their_places(spark, tmp_path):
    spark.createDataFrame([(k, "abcdefgh " * 40 + str(k)) for k in range(8)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    texts = with_row_id(spark.read.parquet(f"{tmp_path}/docs")).select(ROW_ID, F.col("text"))
    spans = suffix_dedup.repeated_spans(texts, window=240, gram=60)
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert f"SortMergeJoin [{ROW_ID}" in plan and f"BroadcastHashJoin [{ROW_ID}" not in plan
    assert spans.count() == 8
