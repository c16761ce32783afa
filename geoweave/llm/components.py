"""Connected components over an edge table, without ever gathering it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import materialize, release
from geoweave.operators.ties import tie_slices

#: Edges that a task ties together at once.
SLICE_EDGES = 1 << 20


def star_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """Alternate large-star and small-star rounds until every edge points at its smallest node.

    edges: two long columns. Returns (node, component): each node that has an edge to another
    node, with the smallest node of its component; nodes without edges are left out. Minima are
    map-side combined, so a hub costs one row per task; the joins are plain sort-merge joins,
    whose skewed partitions adaptive execution splits. Self loops and nulls are ignored. Each round is cut with a
    table in the shared folder. Empty edges give an empty result.

    Before the first round each task ties the edges that it has; if one slice had them all, as a small table's are, no round
    is needed. The driver keeps a thread for each shuffle of the last minute, so rounds cost it memory.
    """
    pairs = edges.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).where("u <> v").distinct()
    tied = materialize(pairs.mapInArrow(tie_slices(SLICE_EDGES), "u long, v long, slice long"), "edges")
    seen = tied.agg(F.min("slice").alias("first"), F.max("slice").alias("last")).first()
    cur, whole = tied.select("u", "v"), seen.first == seen.last
    cur._gw_path = tied._gw_path
    state = None if whole else _state(cur)
    for _ in range(max_rounds):
        if whole or state[0] == 0:
            break
        nxt = materialize(_small_star(_large_star(cur)), "edges")
        new = _state(nxt)
        release(cur)
        cur, done, state = nxt, new == state, new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple[int, int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return (r[0], int(r[1] or 0), int(r[2] or 0))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("o")))
    low = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.where("o > n").join(low, "n").select(F.col("o").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
