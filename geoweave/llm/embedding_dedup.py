"""Near-duplicate embeddings with a pivot-permutation index.

A vector is described by its nearest pivots, in order of nearness, and filed in the inverted list of
some of them: of two vectors that share SHARED of their NEAREST pivots, the smallest shared pivot is among the
first NEAREST - SHARED + 1 of each in the order of pivots, so only these lists are kept. Two vectors of a list are
candidates if they share enough pivots; a pair is looked at only in the list of the smallest pivot that both have,
so it counts once. Candidates
are verified by their cosine in double precision. Long lists are dealt out as pairs of parts; pairs
never leave a task, only counts of links and one edge per linked vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import ROW_ID, any_names, materialize, whole_groups, with_row_id
from geoweave.llm.components import star_components
from geoweave.llm.simhash import spread

COSINE = 0.98
#: Pivots are taken from a sample of at most SAMPLE vectors; their number follows the root of the rows.
SAMPLE, LEAST_PIVOTS, MOST_PIVOTS, NEAREST, SHARED = 4096, 64, 1024, 8, 3
PART = 1024


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of a list column (all of one length) as unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vec: str, label: str) -> F.Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(label).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)


def choose_pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """Pivots from a bounded sample: each next one is the sampled vector farthest from those taken."""
    most = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(2 * np.sqrt(n))))
    rows = vectors.select("vec").sample(min(1.0, 1.5 * SAMPLE / max(n, 1)), seed=17).limit(SAMPLE).toArrow()["vec"]
    if not len(rows):
        return np.zeros((0, 1))
    x = unit_rows(rows)
    taken = [0]
    near = x @ x[0]
    for _ in range(min(most, len(x)) - 1):
        k = int(np.argmin(near))
        if near[k] > 1 - 1e-12:
            break
        taken.append(k)
        near = np.maximum(near, x @ x[k])
    return x[taken]


def _describe(pivots: np.ndarray, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = unit_rows(b["vec"]) @ pivots.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :nearest].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(order))], names=[*b.schema.names, "pivots"])

    return run


def _verify(cosine: float, shared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            yield verify(t.combine_chunks())

    def verify(t: pa.Table) -> pa.RecordBatch:
        key, side = t["key"].to_numpy(), t["side"].to_numpy()
        t = t.take(pa.array(np.lexsort((side, key))))
        key, side, pivot, rep, mult = (t[c].to_numpy() for c in ("key", "side", "pivot", "rep", "mult"))
        x, near = unit_rows(t["vec"]), np.stack(t["pivots"].combine_chunks().flatten().to_numpy().reshape(len(key), -1))
        links, label = np.zeros(len(key), np.int64), np.arange(len(key))
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        width = int(near.max()) + 1
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            two = mid < hi and mid > lo
            if mid == lo or (not two and hi - lo < 2):
                continue
            has = np.zeros((hi - lo, width), np.float32)
            np.put_along_axis(has, near[lo:hi], 1, axis=1)
            earlier = has[:, : int(pivot[lo])]
            b0, b1 = (mid, hi) if two else (lo, hi)
            for a0 in range(lo, mid, PART):
                a1 = min(mid, a0 + PART)
                for c0 in range(b0, b1, PART):
                    c1 = min(b1, c0 + PART)
                    if not two and c1 <= a0:
                        continue
                    ok = has[a0 - lo : a1 - lo] @ has[c0 - lo : c1 - lo].T >= shared
                    ok &= earlier[a0 - lo : a1 - lo] @ earlier[c0 - lo : c1 - lo].T == 0
                    if not ok.any():
                        continue
                    ok &= x[a0:a1] @ x[c0:c1].T >= cosine
                    i, j = np.nonzero(ok)
                    i, j = i + a0, j + c0
                    if not two:
                        i, j = i[i < j], j[i < j]
                    if len(i):
                        links += np.bincount(i, weights=mult[j], minlength=len(key)).astype(np.int64)
                        links += np.bincount(j, weights=mult[i], minlength=len(key)).astype(np.int64)
                        spread(label, i, j)
        got = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(rep[got]), pa.array(rep[label[got]]), pa.array(links[got])], names=["rep", "to", "links"])

    return run


@any_names(("n_links", "component_id", "kept"), "vec", "label", "id_col")
def near_duplicates(
    rows: DataFrame, vec: str = "embedding", label: str = "label", id_col: str = "vec_id",
    cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED, part: int = 2048,
) -> DataFrame:
    """Every row of rows with n_links, component_id and kept.

    Only vectors with equal labels are compared. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without a label, link with nothing: n_links 0, component_id their own
    id. Vectors of unlike lengths are never linked. Equally near pivots go by their number. Equal vectors (repeated rows too) are linked to each other
    without search. Null ids never name a component unless it has no other. An empty table gives an
    empty result; columns of rows with the names of result columns are replaced.
    """
    base = with_row_id(rows)
    good = base.where(usable(vec, label)).select(ROW_ID, F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    groups = materialize(
        good.groupBy("label", "vec").agg(F.min(ROW_ID).alias("rep"), F.count("*").alias("mult"), F.min("id").alias("low")), "vectors"
    )
    found, edges, exact = None, None, rows.schema[vec].dataType.simpleString() == "array<float>"
    for size, n in [(r.size, r.n) for r in groups.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")).collect()]:
        got = _search(groups.where(F.size("vec") == size), n, cosine, nearest, shared, part, exact)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = base.sparkSession.createDataFrame([], "rep long, to long, links long")
    found = materialize(found, "links")
    edges = star_components(found, "rep", "to")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = groups.select("label", "vec", "rep", "mult", "low").join(edges.select(F.col("node").alias("rep"), "component"), "rep", "left").join(counts, "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_vector = named.join(lows, "component").select("label", "vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    placed = good.join(by_vector, ["label", "vec"]).select(ROW_ID, "component_id", "n_links")
    out = base.join(placed, ROW_ID, "left").withColumns(
        {"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.coalesce("component_id", id_col)}
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))).drop(ROW_ID)


def _search(groups: DataFrame, n: int, cosine: float, nearest: int, shared: int, part: int, exact_in_floats: bool) -> DataFrame:
    pivots = groups.sparkSession.sparkContext.broadcast(choose_pivots(groups, n)).value
    nearest = min(nearest, max(len(pivots), 1))
    shared = min(shared, nearest)
    kind = groups.schema["label"].dataType.simpleString()
    slim = groups.withColumn("vec", F.col("vec").cast("array<float>")) if exact_in_floats else groups
    described = materialize(
        slim.select("label", "rep", "mult", "vec").mapInArrow(_describe(pivots, nearest), f"label {kind}, rep long, mult long, vec {slim.schema['vec'].dataType.simpleString()}, pivots array<int>"), "described"
    )
    # lists are dealt out by their lengths without the vectors, which are fetched once for each part they are in
    filed = described.select("label", "rep", F.explode(F.slice(F.array_sort("pivots"), 1, nearest - shared + 1)).alias("pivot"))
    sizes = filed.groupBy("label", "pivot").agg(F.count("*").alias("n")).where("n > 1").withColumn("g", F.ceil(F.col("n") / part).cast("int"))
    dealt = (
        filed.join(sizes, ["label", "pivot"])
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select(
            F.xxhash64("label", "pivot", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"),
            (F.col("mine") > F.col("other")).cast("int").alias("side"), "pivot", "rep",
        )
    )
    sent = dealt.join(described.drop("label"), "rep").repartition("key").sortWithinPartitions("key")
    return sent.mapInArrow(_verify(cosine, shared), "rep long, to long, links long")
