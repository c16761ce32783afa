"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are linked when they differ in at most `budget` bits. The 64 bits are cut into
`budget + k` blocks; two fingerprints within the budget agree on at least k whole blocks, so a
fingerprint is filed once for each choice of k blocks, under their bits; k grows with the number of fingerprints, so
that buckets do not. Each bucket is a subtrie: node pairs are walked together from its root, differing bits are added up, and a pair
is dropped as soon as it exceeds the budget. A bucket never emits its pairs: what leaves a task is
one edge per fingerprint to the smallest one that it reaches inside the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from geoweave.llm.common import ROW_ID, SLICE_BYTES, any_names, chunks_of, materialize, mix64, text_bytes, whole_groups, with_row_id
from geoweave.llm.components import star_components

BITS, BUDGET, SHINGLE, SEED = 64, 4, 4, 42
#: Shingles whose bits are expanded at once; node pairs that are walked at once.
SLICE, WALK = 1 << 15, 1 << 18
#: A bucket above this many fingerprints is dealt out as pairs of its parts.
PART = 4096
#: Bits by which fingerprints of shingle sets may differ and still propose a pair, and bytes of their buckets that are walked at once.
PROPOSED, PROPOSED_BYTES = 6, 1 << 19
#: Bands of min-hashes that propose the pairs beyond these bits (of similarity 0.8, all but 6 in 100,000); a group of more sets is
#: dealt out as pairs of its parts.
BANDS, ROWS, PART_SETS = 32, 6, 1024


def digests(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle as rows of 8 bytes, in slices; a shorter text is one shingle, nothing without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= 1:
        yield np.frombuffer(digest(joined, SEED), np.uint8).reshape(1, 8)
        return
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    for k in range(0, n, SLICE):
        m = min(n, k + SLICE)
        got = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts[k:m], ends[k + shingle - 1 : m + shingle - 1])])
        yield np.frombuffer(got, np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 of each word shingle; 0 without words."""
    n, counts = 0, np.zeros(BITS, np.int64)
    for d in digests(text, shingle):
        n += len(d)
        counts += np.unpackbits(d, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big") if n else 0


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of the word shingles, in order."""
    got = [d.reshape(-1).view(np.uint64) for d in digests(text, shingle)]
    return np.unique(np.concatenate(got)) if got else np.zeros(0, np.uint64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """Majority of the bits of the hashes of a shingle set, as a signed integer."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), SLICE):
        counts += np.unpackbits(hashes[k : k + SLICE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def blocks(count: int) -> list[tuple[int, int]]:
    """(shift, width) of count blocks that make up the 64 bits."""
    edges = [round(i * BITS / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def blocks_per_key(n: int, budget: int, part: int) -> int:
    """The least number of blocks in a key under which n evenly spread fingerprints make buckets of at most `part`."""
    k = 2
    while k < 5 and n > part << (k * (BITS // (budget + k))):
        k += 1
    return k


def bucket_keys(fp: str, budget: int, k: int = 2) -> F.Column:
    """The keys of all choices of k blocks, as an array column; which choice it is makes them distinct."""
    cut = blocks(budget + k)

    def key(number: int, chosen: tuple[int, ...]) -> F.Column:
        out = F.lit(0).cast("long")
        for c in chosen:
            shift, width = cut[c]
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)))
        return out.bitwiseOR(F.shiftleft(F.lit(number).cast("long"), 48))

    return F.array(*[key(i, chosen) for i, chosen in enumerate(combinations(range(len(cut)), k))])


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def join_tries(fps: np.ndarray, groups: list[tuple[np.ndarray, ...]], budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk pairs of subtries over fps; yields positions of fingerprints within the budget.

    groups: arrays (a_low, a_high, b_low, b_high) of ranges of fps, each range sorted; a range is a
    subtrie, and the pair of a range with itself yields each unordered pair once.
    """
    a0, a1, b0, b1 = groups
    todo = [(0, a0, a1, b0, b1, np.zeros(len(a0), np.int8))]
    zeros = {}
    while todo:
        bit, a0, a1, b0, b1, err = todo.pop()
        if len(a0) > WALK:
            h = len(a0) // 2
            todo += [(bit, a0[h:], a1[h:], b0[h:], b1[h:], err[h:]), (bit, a0[:h], a1[:h], b0[:h], b1[:h], err[:h])]
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = (popcount(fps[i] ^ fps[j]) <= budget) & (i != j)
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, err = (x[~leaf] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        if bit == BITS:  # equal fingerprints within a node: link them in a chain and across
            i, j = _cross(a0, a1, b0, b1)
            yield i, j
            continue
        if bit not in zeros:
            zeros[bit] = np.concatenate(([0], np.cumsum((fps >> np.uint64(BITS - 1 - bit)) & np.uint64(1) == 0)))
        z = zeros[bit]
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        same = (a0 == b0) & (a1 == b1)
        nxt = [
            np.concatenate(x)
            for x in ((a0, am, a0, am[~same]), (am, a1, am, a1[~same]), (b0, bm, bm, b0[~same]), (bm, b1, b1, bm[~same]), (err, err, err + 1, err[~same] + 1))
        ]
        keep = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget)
        keep &= ~((nxt[0] == nxt[2]) & (nxt[1] == nxt[3]) & (nxt[1] - nxt[0] == 1))
        todo.append((bit + 1, *(x[keep] for x in nxt)))


def _cross(a0, a1, b0, b1):
    i = [np.arange(p, q - 1) for p, q in zip(a0, a1)] + [np.arange(p, q) for p, q in zip(b0, b1)]
    j = [np.arange(p + 1, q) for p, q in zip(a0, a1)] + [np.full(q - p, r) for p, q, r in zip(b0, b1, a0)]
    return np.concatenate(i), np.concatenate(j)


def spread(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of positions i and j; label holds a position of the class, smallest wins."""
    while True:
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _link_buckets(budget: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key", most):
            yield link(t["key"].to_numpy(), t["fp"].to_numpy().view(np.uint64), t["side"].to_numpy())

    def link(key: np.ndarray, fp: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fp, side, key))
        key, fp, side = key[order], fp[order], side[order]
        cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (side[1:] != side[:-1]))))
        lo, hi = cut, np.concatenate((cut[1:], [len(key)]))
        second = (side[lo] == 1).nonzero()[0]  # parts of a large bucket: first side against second
        whole = np.ones(len(lo), bool)
        whole[second] = False
        paired = second[(second > 0)]
        paired = paired[key[lo[paired]] == key[lo[paired - 1]]]
        whole[paired - 1] = False
        alone = whole & (hi - lo > 1)
        ranges = (
            np.concatenate((lo[alone], lo[paired - 1])), np.concatenate((hi[alone], hi[paired - 1])),
            np.concatenate((lo[alone], lo[paired])), np.concatenate((hi[alone], hi[paired])),
        )
        label = np.arange(len(fp))
        for i, j in join_tries(fp, ranges, budget):
            spread(label, i, j)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        signed = fp.view(np.int64)
        pairs = np.unique(np.stack((signed[linked], signed[label[linked]]), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return run


def link_fingerprints(fps: DataFrame, budget: int = BUDGET, part: int = PART, most: int = SLICE_BYTES) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect all within the budget.

    A bucket of more than `part` fingerprints is split into parts, and each pair of parts is walked
    by itself, so no bucket has to fit one task.
    """
    k = blocks_per_key(fps.count(), budget, part)
    keyed = fps.select("fp", F.explode(bucket_keys("fp", budget, k)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    n_parts = F.ceil(F.col("n") / part).cast("int")
    dealt = (
        keyed.join(sizes.hint("merge"), "key")  # keyed is sized as fps is, without the keys that each row becomes, and must not be broadcast
        .withColumn("g", n_parts)
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select(
            F.when(F.col("g") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).alias("key"),
            (F.col("mine") > F.col("other")).cast("int").alias("side"),
            "fp",
        )
    )
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_link_buckets(budget, most), "u long, v long")


@any_names(("fingerprint", "component_id", "n_in_component"), "text", "id_col")
def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", budget: int = BUDGET) -> DataFrame:
    """Every row of docs with fingerprint (16 hex digits), component_id and n_in_component.

    Null and empty texts and texts without words get fingerprint zero and are linked like any
    other; shorter texts than a shingle count as one shingle; texts of any length are hashed whole. component_id is the smallest id
    reachable through links, the row's own included (null ids are never the smallest; a component
    with null ids only gets null). Repeated rows are all returned. Columns of docs that bear the
    names of result columns are replaced. An empty table gives an empty result.
    """
    marked = docs.select("*", fingerprint_udf(F.col(text)).alias("__gw_fp"))
    return attach_components(marked, id_col, budget)


def attach_components(marked: DataFrame, id_col: str, budget: int) -> DataFrame:
    fps = materialize(
        marked.groupBy(F.col("__gw_fp").alias("fp")).agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "fps"
    )
    parts = star_components(link_fingerprints(fps.select("fp"), budget))
    named = fps.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    totals = named.groupBy("component").agg(F.min("low").alias("component_id"), F.sum("n").alias("n_in_component"))
    of_fp = named.select("fp", "component").join(totals, "component").select(F.col("fp").alias("__gw_fp"), "component_id", "n_in_component")
    return (
        marked.join(of_fp, "__gw_fp")
        .withColumn("fingerprint", F.lpad(F.lower(F.hex("__gw_fp")), 16, "0"))
        .drop("__gw_fp")
    )


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", budget: int = BUDGET) -> DataFrame:
    """docs without all but one row of each near-duplicate component: the row with the smallest id.

    Of rows that repeat that smallest id one stays; rows with null ids stay only if their
    component has no other, and then one of them does.
    """
    columns = docs.columns
    numbered = with_row_id(docs)
    marked = numbered.withColumn("__gw_fp", fingerprint_udf(F.col(text)))
    rows = marked.select("__gw_fp", F.struct(F.col(id_col).isNull().alias("low_null"), F.col(id_col).alias("low_id"), F.col(ROW_ID).alias("low_row")).alias("me"))
    fps = materialize(rows.groupBy(F.col("__gw_fp").alias("fp")).agg(F.min("me").alias("me")), "fps")
    parts = star_components(link_fingerprints(fps.select("fp"), budget))
    named = fps.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left")
    winners = named.groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("me").alias("me")).select(F.col("me.low_row").alias(ROW_ID))
    return numbered.join(winners, ROW_ID, "left_semi").select(*columns)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of its ROWS min-hashes; two sets share it with probability similarity ** ROWS."""
    draw = np.random.default_rng(SEED)
    by, plus = (draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 512):
        low = np.minimum(low, (hashes[k : k + 512, None] * by + plus).min(axis=0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for x in low.reshape(BANDS, ROWS).T:
        out = mix64(out * np.uint64(0x5851F42D4C957F2D) + x)
    return out.view(np.int64)


def _sketch(shingle: int):
    @F.pandas_udf("same binary, fp long, bands array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        same, fps, bands = [], [], []
        for t in texts:  # one set at a time
            x = shingle_set(t, shingle)
            same.append(xxhash.xxh3_128_digest(x.tobytes()))
            fps.append(set_fingerprint(x) if len(x) else None)
            bands.append(band_keys(x) if len(x) else np.zeros(0, np.int64))
        return pd.DataFrame({"same": same, "fp": pd.array(fps, "Int64"), "bands": bands})

    return run


def _hash_sets(shingle: int):
    """Rows of (node, keys, hashes), hashes the shingle set of the text, in batches of about SLICE_BYTES of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, starts, ends = text_bytes(b["text"])
            for i, j in chunks_of(starts, ends, SLICE_BYTES):
                x = b.slice(i, j - i)
                hashes = pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in x["text"]], pa.binary())
                yield pa.RecordBatch.from_arrays([x["node"], x["keys"], hashes], names=["node", "keys", "hashes"])

    return run


def similar_classes(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Position of the first set that each set is connected to by pairs of Jaccard similarity >= similarity.

    Every set that is reached is compared with all that are not reached yet, so no pair is left out.
    """
    sizes = np.array([len(x) for x in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    label, left, mark = np.arange(len(sets)), np.arange(len(sets)), np.zeros(len(names), bool)
    words = flat  # of the sets that are left
    while len(left) > 1:
        root, todo = left[0], [left[0]]
        left, words = left[1:], words[sizes[left[0]] :]
        while todo and len(left):
            x = todo.pop()
            mine = flat[first[x] : first[x] + sizes[x]]
            mark[mine] = True
            n = sizes[left]
            shared = np.add.reduceat(mark[words].astype(np.int64), np.cumsum(n) - n)
            mark[mine] = False
            near = shared * (1 + similarity) >= similarity * (n + sizes[x]) - 1e-9
            if near.any():
                label[left[near]] = root
                todo += left[near].tolist()
                words, left = words[np.repeat(~near, n)], left[~near]
    return label


def _link_sets(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            yield from link(t["key"].to_numpy(), t["node"].to_numpy(), t["hashes"].to_pylist())

    def link(key: np.ndarray, node: np.ndarray, sets: list[bytes]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((node, key))
        cut = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True])))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if hi - lo > 1:
                at = order[lo:hi]
                label = similar_classes([np.frombuffer(sets[i], np.uint64) for i in at.tolist()], similarity)
                linked = label != np.arange(len(label))
                yield pa.RecordBatch.from_arrays([pa.array(node[at[linked]]), pa.array(node[at[label[linked]]])], names=["u", "v"])

    return run


def fingerprint_links(fps: DataFrame, budget: int) -> DataFrame:
    """(u, v): each node of fps (node, fp) whose fingerprint others are within the budget of, to the least node reached by such links."""
    parts = star_components(link_fingerprints(fps.select("fp").distinct(), budget, most=PROPOSED_BYTES))
    named = fps.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").select("node", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "fingerprints")
    low = named.groupBy("component").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").select("component", "low")
    return named.join(low, "component").where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v"))


def link_sets(texts: DataFrame, fps: DataFrame, bands: DataFrame, shingle: int, similarity: float, part: int = PART_SETS) -> DataFrame:
    """Edges (u, v) that connect the nodes whose shingle sets have at least the given Jaccard similarity.

    texts: (node, text); fps: (node, fp), the fingerprints; bands: (node, key), a row per band. Nodes whose fingerprints are linked, and
    those that share a key, are connected to the least of them, and all pairs inside what that connects count. First each node is checked
    against the least that its fingerprint reaches, or, if it reaches none, the least that it shares a key with: that ties near copies
    into clusters and sends each set once, however large the group. Where clusters that links or keys connect are
    left, their pairs are checked on whole sets in parts: what is outside the largest cluster with itself and with the largest.

    Joins with texts and with exploded bands are merged, as the planner takes these tables for much smaller than they are and would broadcast them.
    """
    low = bands.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").select("key", "low")
    beyond = bands.join(low.hint("merge"), "key").where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct()
    meets = fingerprint_links(fps, PROPOSED).withColumn("band", F.lit(0)).unionByName(beyond.withColumn("band", F.lit(1)))
    meets = materialize(meets, "meets")

    def linked(dealt: DataFrame) -> DataFrame:
        held = texts.hint("merge").join(materialize(dealt, "dealt"), "node")
        sets = held.select("node", "keys", "text").mapInArrow(_hash_sets(shingle), "node long, keys array<long>, hashes binary")
        keyed = sets.select(F.explode("keys").alias("key"), "node", "hashes")
        return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link_sets(shingle, similarity), "u long, v long")

    each = lambda n: F.sequence(F.lit(0), n - 1)
    homes = meets.groupBy(F.col("u").alias("node")).agg(F.min(F.struct("band", "v")).alias("first")).select("node", F.col("first.v").alias("hub"))
    hubs = homes.groupBy("hub").agg(F.ceil(F.count("*") / part).cast("int").alias("g"))
    members = homes.join(hubs, "hub").select("node", F.array(F.xxhash64("hub", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))).alias("keys"))
    heads = hubs.select(F.col("hub").alias("node"), F.transform(each(F.col("g")), lambda k: F.xxhash64("hub", k)).alias("keys"))
    clusters = star_components(linked(members.unionByName(heads)))

    named = meets.select(F.col("u").alias("node")).unionByName(meets.select(F.col("v").alias("node"))).distinct().join(clusters, "node", "left")
    named = materialize(named.select("node", F.coalesce("component", "node").alias("cluster")), "clusters")
    of = lambda end: named.select(F.col("node").alias(end), F.col("cluster").alias(f"{end}_cluster"))
    apart = meets.join(of("u"), "u").join(of("v"), "v").where("u_cluster <> v_cluster").select(F.col("u_cluster").alias("u"), F.col("v_cluster").alias("v"))
    near = named.join(star_components(apart).select(F.col("node").alias("cluster"), "component"), "cluster")
    sizes = near.groupBy("component", "cluster").agg(F.count("*").alias("n"))
    split = sizes.groupBy("component").agg(F.max(F.struct("n", "cluster")).alias("top"), F.sum("n").alias("all"))
    split = split.select(
        "component", F.col("top.cluster").alias("main"), (F.col("all") <= part).alias("small"),
        F.ceil(F.col("top.n") / part).cast("int").alias("g"), F.ceil((F.col("all") - F.col("top.n")) / part).cast("int").alias("h"),
    )
    name = lambda kind, i, j: F.xxhash64("component", F.lit(kind), i, j)
    mine, other = F.col("mine"), F.col("other")
    pairs = F.transform(F.filter(each(F.col("h")), lambda k: (k != mine) | (F.col("h") == 1)), lambda k: name("stray", F.least(k, mine), F.greatest(k, mine)))
    keys = (
        F.when(F.col("small"), F.array(F.xxhash64("component")))
        .when(F.col("cluster") == F.col("main"), F.transform(each(F.col("h")), lambda k: name("main", k, other)))
        .otherwise(F.concat(pairs, F.transform(each(F.col("g")), lambda k: name("main", mine, k))))
    )
    dealt = near.join(split, "component").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("h")).cast("int"))
    dealt = dealt.withColumn("other", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    return clusters.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(linked(dealt.select("node", keys.alias("keys"))))


@any_names((), "text", "id_col")
def keep_one_similar(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8, part: int = PART_SETS) -> DataFrame:
    """docs without all but one row of each component of pairs with Jaccard similarity >= similarity.

    Similarity is that of the sets of word shingles (a shorter text is one shingle; texts without words are
    alike). Pairs are proposed by the trie join of the sets' SimHash fingerprints, those beyond its bits by bands of min-hashes as
    well, and checked on their whole sets. The row that stays is chosen as in keep_one.
    """
    rows = with_row_id(docs)
    me = F.struct(F.col(id_col).isNull().alias("low_null"), F.col(id_col).alias("low_id"), F.col(ROW_ID).alias("low_row"))
    marked = rows.select(_sketch(shingle)(F.col(text)).alias("s"), me.alias("me"))
    sets = materialize(marked.groupBy("s.same").agg(F.min("me").alias("me"), F.first("s.fp").alias("fp"), F.first("s.bands").alias("bands")), "sets")
    bands = sets.select(F.col("me.low_row").alias("node"), F.explode("bands").alias("key"))
    fps = sets.where("fp is not null").select(F.col("me.low_row").alias("node"), "fp")
    edges = link_sets(rows.select(F.col(ROW_ID).alias("node"), F.col(text).alias("text")), fps, bands, shingle, similarity, part)
    named = sets.select("me", F.col("me.low_row").alias("node")).join(star_components(edges), "node", "left")
    winners = named.groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("me").alias("me")).select(F.col("me.low_row").alias(ROW_ID))
    return rows.join(winners, ROW_ID, "left_semi").select(*docs.columns)
