"""Importance resampling of documents towards a target distribution, from hashed word runs.

1. Every document's features (runs of 1 to `grams` words) become bucket numbers, written down once as arrays beside the document's row number.
   Bucket counts are added up as arrays in each task and by bucket after that; a table of `buckets` gains is all that is ever in one place.
2. Weights are sums of gains, looked up in that array for a whole batch at once. Each document gets a Gumbel score of its own.
3. Runs: every partition sorts its eligible documents by score and cuts them at range splitters (from a bounded sample) into blocks
   of records. Ranges that lie wholly beyond the exact draw count are left alone.
4. Merge: a range's blocks arrive in the order of their first records. A tournament tree holds the blocks that are open, one a run, and gives out
   records below the next block's first one, so a task holds a block a run at most, and it stops at the draw count. A record's rank
   is its place in the range and the size of all ranges before.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import ROW_ID, column, kept_columns, materialize, release, shuffle_partitions, with_row_id
from geoweave.llm.words import ALNUM, Words, joined, quantity, read_words

GRAMS, BUCKETS, MIN_WORDS, DRAW_PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of text that are hashed at once, records in a block of a run, and documents in a range.
BYTES, BLOCK, RANGE = 1 << 20, 1024, 1 << 18
#: Sampled records for each range, from which the splitters are taken.
SAMPLED = 32
#: Words longer than this are hashed one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def crc32s(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of data: byte k of all of them that have one at once, the longest first."""
    size = end - first
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= LONG]
    at, left = first[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))  # those longer than k
        crc[:n] = CRC[(crc[:n] ^ data[at[:n] + k]) & 255] ^ (crc[:n] >> 8)
    out = np.zeros(len(first), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(data[first[i] : end[i]].tobytes())
    return out


def features(w: Words, grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to `grams` words, by row of w, and how many each row has."""
    data, begin = joined(w)
    stop = begin + w.end - w.first
    size = w.high - w.low
    parts, rows = [], []
    for k in range(1, grams + 1):
        count = np.maximum(size - k + 1, 0)
        row = np.repeat(np.arange(len(size)), count)
        p = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + w.low[row]
        parts.append(crc32s(data, begin[p], stop[p + k - 1]) % np.uint32(buckets))
        rows.append(row)
    if grams == 1:
        return parts[0], size
    row = np.concatenate(rows)
    return np.concatenate(parts)[np.argsort(row, kind="stable")], np.bincount(row, minlength=len(size))


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


FEATURES = f"{ROW_ID} long, id long, own long, n_words long, n_features long, buckets binary"


def _features(grams: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in read_words(b["text"], ALNUM, BYTES):
                found, count = features(w, grams, buckets)
                raw, at = found.astype(_kind(buckets)).tobytes(), np.concatenate(([0], np.cumsum(count))) * np.dtype(_kind(buckets)).itemsize
                held = [raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                passed = [b[c].slice(w.start, w.stop - w.start) for c in (ROW_ID, "id", "own")]
                yield pa.RecordBatch.from_arrays([*passed, pa.array(w.high - w.low), pa.array(count), pa.array(held, pa.binary())], names=[x.split()[0] for x in FEATURES.split(", ")])

    return run


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b["buckets"].to_pylist()), _kind(buckets)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows are in each bucket: one row a bucket comes to the driver."""
    got = found.select("buckets").mapInArrow(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed share of a bucket in the target over that in the source, floors."""
    buckets = len(source)
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigh(gains: np.ndarray):
    kind = _kind(len(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b["n_features"].to_numpy()
            sums = np.concatenate(([0], np.cumsum(gains[np.frombuffer(b"".join(b["buckets"].to_pylist()), kind)])))
            ends = np.cumsum(size)
            names = [ROW_ID, "id", "own", "n_words", "n_features"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(sums[ends] - sums[ends - size])], names=[*names, "weight"])

    return run


def gumbel(seed: int, key: str):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of a SHA-256 of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


#: Records in the order of the draw: highest score first (its negative), then least id (null last), then row.
ORDER = ["minus", "unnamed", "id", ROW_ID]
RECORD = np.dtype([(c, "<i8") for c in ORDER])
BLOCKS = ", ".join(["part long", "size long", *(f"{c} long" for c in ORDER), "records binary"])


def _blocks(splitters: np.ndarray, block: int):
    """Blocks of records of one run (a sorted partition), cut at splitters; part is the number of splitters not above a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            held = _records(b)
            part = np.searchsorted(splitters, held, "right")
            new = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            starts = np.concatenate([np.arange(i, j, block) for i, j in zip(new, [*new[1:], len(part)])])
            stops = np.concatenate((starts[1:], [len(part)]))
            columns = [pa.array(part[starts]), pa.array(stops - starts), *(pa.array(np.ascontiguousarray(held[c][starts])) for c in ORDER)]
            columns.append(pa.array([held[i:j].tobytes() for i, j in zip(starts.tolist(), stops.tolist())], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCKS.split(", ")])

    return run


def _records(b) -> np.ndarray:
    held = np.empty(b.num_rows, RECORD)
    for c in ORDER:
        held[c] = b[c].to_numpy()
    return held


class Tournament:
    """A tree over the open blocks of sorted runs: each node names the leaf whose next record is least of those below it.

    A leaf that changes plays the matches on its way up anew, one for each doubling of the open blocks.
    """

    def __init__(self):
        self.queues: list[list[tuple]] = []
        self.free: list[int] = []
        self.winners: list[int] = []

    def _play(self, node: int) -> None:
        while node:
            a, b = self.winners[2 * node], self.winners[2 * node + 1]
            x, y = self.queues[a], self.queues[b]
            self.winners[node] = b if not x or (y and y[-1] < x[-1]) else a
            node //= 2

    def _grow(self) -> None:
        have, width = len(self.queues), max(2, 2 * len(self.queues))
        self.queues += [[] for _ in range(width - have)]
        self.free += range(have, width)
        self.winners = [0] * width + list(range(width))
        for node in range(width // 2, width):
            self._play(node)

    def open(self, records: list[tuple]) -> None:
        """Add a sorted block."""
        if not self.free:
            self._grow()
        leaf = self.free.pop()
        self.queues[leaf] = records[::-1]
        self._play((leaf + len(self.queues)) // 2)

    def pop(self, below: tuple | None = None) -> tuple | None:
        """The least record of all blocks, if there is one and it is before `below`."""
        if not self.queues:
            return None
        leaf = self.winners[1]
        queue = self.queues[leaf]
        if not queue or (below is not None and queue[-1] >= below):
            return None
        out = queue.pop()
        if not queue:
            self.free.append(leaf)
        self._play((leaf + len(self.queues)) // 2)
        return out


def merge(blocks: Iterator[tuple[tuple, list[tuple]]], most: int) -> Iterator[tuple]:
    """The first `most` records of sorted blocks, which come as (first record, records) in the order of their first records."""
    tree, given = Tournament(), 0
    for first, records in blocks:
        while given < most and (record := tree.pop(first)) is not None:
            given += 1
            yield record
        if given == most:
            return
        tree.open(records)
    while given < most and (record := tree.pop()) is not None:
        given += 1
        yield record


def _merge_ranges(offsets: dict[int, tuple[int, int]]):
    """(row, rank) of the records to draw; offsets: by range, the records before it and how many of it are drawn."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            firsts = _records(b).tolist() if b.num_rows else []
            yield from zip(b["part"].to_pylist(), firsts, b["records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in itertools.groupby(each(batches), key=lambda x: x[0]):
            before, most = offsets[part]
            opened = ((first, np.frombuffer(held.as_py(), RECORD).tolist()) for _, first, held in group)
            drawn = merge(opened, most)
            while rows := [r[-1] for r in itertools.islice(drawn, BYTES // 16)]:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.arange(before + 1, before + 1 + len(rows)))], names=[ROW_ID, "rank"])
                before += len(rows)

    return run


def draw(scored: DataFrame, count: int, partitions: int, of: int, block: int = BLOCK) -> DataFrame:
    """(row, rank) of the `count` first of `of` records (columns as ORDER), rank 1 first."""
    ranges = max(partitions, -(-of // RANGE))
    sample = scored.select(*ORDER).sample(min(1.0, SAMPLED * ranges / max(of, 1)), seed=5).toArrow()
    sample = np.sort(_records(sample))
    splitters = np.unique(sample[np.linspace(0, len(sample), ranges + 1).astype(int)[1:-1]]) if len(sample) else sample
    runs = scored.select(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_blocks(splitters, block), BLOCKS)
    runs = materialize(runs, "runs")
    sizes = {r.part: r.n for r in runs.groupBy("part").agg(F.sum("size").alias("n")).collect()}  # one row a range
    offsets, before = {}, 0
    for part in sorted(sizes):
        if before < count:
            offsets[part] = (before, min(sizes[part], count - before))
        before += sizes[part]
    wanted = runs.where(F.col("part") <= max(offsets, default=-1))
    tasks = max(1, min(partitions, len(offsets)))
    dealt = wanted.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part", *ORDER)
    return dealt.mapInArrow(_merge_ranges(offsets), f"{ROW_ID} long, rank long")


NEW = ["n_features", "weight", "score", "rank"]


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", doc: str = "doc_id", target_text: str = "text", grams: int = GRAMS, buckets: int = BUCKETS,
    min_words: int = MIN_WORDS, percent: int = DRAW_PERCENT, seed: int = SEED, block: int = BLOCK,
) -> DataFrame:
    """docs plus n_features, weight, score and rank: the place in a draw of `percent` of the documents with at least min_words words, else null.

    A weight is the sum of gains of all features of the whole text; the score adds a Gumbel number of the document's own, so the highest
    scores are a draw without replacement in proportion to exp(weight / 1000). Ties go to the lesser id (a long; null is last), then to
    the earlier row. Null and empty texts have no features and weight 0; repeated documents have the same score and places next to each
    other; texts of any length are read whole; an empty table gives an empty result; an empty target weighs all buckets by the documents alone; columns of
    docs with the names of result columns are replaced.
    """
    quantity("grams", grams, 1), quantity("buckets", buckets, 1), quantity("block", block, 1)
    keep = kept_columns(docs, NEW)
    rows = with_row_id(docs.select(*[column(c) for c in keep]))
    texts = rows.select(ROW_ID, column(doc).cast("long").alias("id"), gumbel(seed, doc).alias("own"), column(text).alias("text"))
    found = materialize(texts.mapInArrow(_features(grams, buckets), FEATURES), "features")
    none = F.lit(0).cast("long")
    wanted = target.select(none.alias(ROW_ID), none.alias("id"), none.alias("own"), column(target_text).alias("text")).mapInArrow(_features(grams, buckets), FEATURES)
    gains = bucket_gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    weighed = found.mapInArrow(_weigh(gains), f"{ROW_ID} long, id long, own long, n_words long, n_features long, weight long")
    score = F.col("weight") + F.col("own")
    scored = weighed.select(
        ROW_ID, "n_words", "n_features", "weight", score.alias("score"), (-score).alias("minus"), F.col("id").isNull().cast("long").alias("unnamed"), F.coalesce("id", none).alias("id")
    )
    scored = materialize(scored, "scored")
    release(found)
    eligible = scored.where(F.col("n_words") >= min_words)
    n = eligible.count()
    ranks = draw(eligible, percent * n // 100, shuffle_partitions(docs), n, block)
    placed = scored.select(ROW_ID, "n_features", "weight", "score").join(ranks, ROW_ID, "left")
    return rows.join(placed, ROW_ID).select(*[column(c) for c in keep], *NEW)
