"""Exact substring deduplication with a distributed, sparse suffix array.

1. Suffixes: those that start at an anchor (see anchors.py). A row stands for a suffix: its leading
   tokens (8-byte words), the hash of its first GRAM bytes, a 128-bit hash of the stretch of text whose
   windows have that anchor, and where it is. Suffixes that are alike in one batch are put together.
2. Range partition: splitters come from a bounded sample of suffixes. Stretches that the sample holds twice are
   known to repeat: all of them are settled where they are read, and one a batch goes on to its bucket.
3. Each bucket is sorted by multikey quicksort, and neighbours are compared: equal stretches repeat and are settled,
   unlike ones with equal leading parts are candidates. A leading part that ends one bucket and starts
   another is found by comparing the buckets' ends; its stretches are candidates of each other too.
4. One of each class of equal candidates goes with its bytes to the others that have its anchor. There the suffixes on
   the right of the anchor and the reversed prefixes on its left are sorted by multikey quicksort, the bytes that
   neighbours share are counted, and the windows that two of them share are read off these counts.
5. An anchor with very many unlike stretches has its windows counted one by one by a 128-bit hash instead, combined
   before the shuffle, so no group has to fit a task.

Nothing is dropped or sampled except for the splitters, which only balance the work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.anchors import BYTE_CODES, Rolling, find_anchors, merge_spans, multikey_quicksort, runs, segments
from geoweave.llm.common import ROW_ID, any_names, chunks_of, materialize, mix64, output_schema, shuffle_partitions, text_bytes, whole_groups, with_row_id

WINDOW, GRAM, TOKENS = 400, 64, 3
#: An anchor with this many unlike stretches is not gathered.
MANY = 1 << 14
#: At most so many sampled suffixes per bucket decide the splitters; a sampling task gives so many.
SAMPLED_PER_BUCKET, SAMPLED_PER_TASK, SAMPLE_SHARE = 64, 512, 0.02
KEYS = [f"t{i}" for i in range(TOKENS)] + ["gram", "high", "low"]
CLASS = KEYS[-2:]
PLACE = np.dtype([("row", "<i8"), ("a", "<i4"), ("s", "<i4"), ("e", "<i4")])


def _tokens(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Leading 8-byte words as integers whose signed order is the byte order."""
    around = at[:, None] + np.arange(8 * TOKENS)
    words = np.ascontiguousarray(data[around]).view(">u8").astype(np.uint64)
    return [(words[:, i] ^ np.uint64(1 << 63)).view(np.int64) for i in range(TOKENS)]


def content_keys(pieces: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of byte strings as two columns of integers."""
    got = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in pieces]), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(got[:, 0]), np.ascontiguousarray(got[:, 1])


def suffixes(row_ids: np.ndarray, texts, window: int = WINDOW, gram: int = GRAM) -> tuple[list[np.ndarray], np.ndarray]:
    """Sort keys and places of all anchored suffixes of a batch of texts."""
    data, starts, ends = text_bytes(texts)
    keys, places = [[] for _ in KEYS], []
    for lo, hi, rows, s, e in segments(starts, ends, window):
        part = data[lo:hi]
        roll = Rolling(BYTE_CODES[part])
        row, a, first, last, g = find_anchors(roll, s, e, window, gram)
        if not len(a):
            continue
        raw = memoryview(part.tobytes())
        high, low = content_keys(raw[i:j] for i, j in zip(first.tolist(), (last + window).tolist()))
        low = low ^ mix64((a - first).astype(np.uint64) + np.uint64(1)).view(np.int64)  # and where the anchor is
        for k, v in zip(keys, (*_tokens(part, a), mix64(g).view(np.int64), high, low)):
            k.append(v)
        at = np.zeros(len(a), PLACE)
        base = lo - starts[rows[row]]
        at["row"], at["a"], at["s"], at["e"] = row_ids[rows[row]], a + base, first + base, last + base
        places.append(at)
    if not places:
        return [np.zeros(0, np.int64) for _ in KEYS], np.zeros(0, PLACE)
    return [np.concatenate(k) for k in keys], np.concatenate(places)


def locate(splitters: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Bucket of each suffix: the number of splitters that are not above it."""
    low, high = np.searchsorted(splitters[:, 0], keys[0], "left"), np.searchsorted(splitters[:, 0], keys[0], "right")
    out = high.astype(np.int32)
    for i in np.flatnonzero(low < high):  # ties in the first token only
        me = tuple(int(k[i]) for k in keys)
        out[i] = low[i] + sum(tuple(x) <= me for x in splitters[low[i] : high[i]].tolist())
    return out


def alike(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal rows of keys together, and where each group of them starts."""
    order = np.lexsort(keys[::-1])
    new = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0) if len(order) > 1 else np.zeros(0, bool)
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), new)))


def place_batches(find, names: list[str], place, known: set[tuple[int, int]] | None):
    """Rows of (bucket, known, keys, places) from find(row_ids, texts), alike ones of a batch in one row.

    Of classes that are known to repeat, all places are in rows marked so, which may go anywhere, and one place is
    in a row like the others. place(keys) gives buckets. If known is None, a sample of the keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = 0
        for b in batches:
            if known is None and given >= SAMPLED_PER_TASK:
                continue
            keys, places = find(b[ROW_ID].to_numpy(), b["text"])
            if not len(places):
                continue
            if known is None:
                order = np.random.default_rng(7).permutation(len(places))[: SAMPLED_PER_TASK - given]
                given += len(order)
                first, ends, who = np.arange(len(order)), np.arange(1, len(order) + 1), [b""] * len(order)
                keys, bucket, sure = [k[order] for k in keys], np.zeros(len(order), np.int32), np.zeros(len(order), bool)
            else:
                order, first = alike(keys)
                keys, places = [k[order] for k in keys], places[order]
                raw, size, ends = places.tobytes(), PLACE.itemsize, np.concatenate((first[1:], [len(places)]))
                who = [raw[i * size : j * size] for i, j in zip(first.tolist(), ends.tolist())]
                bucket, sure = place([k[first] for k in keys]), np.zeros(len(first), bool)
                if known:
                    pairs = zip(keys[-2][first].tolist(), keys[-1][first].tolist())
                    hot = np.flatnonzero(np.fromiter((x in known for x in pairs), bool, len(first)))
                    spread = (mix64(places["row"][first[hot]].astype(np.uint64)) >> np.uint64(34)).astype(np.int32)
                    who += [who[i] for i in hot.tolist()]
                    for i in hot.tolist():
                        who[i] = who[i][:size]
                    first, bucket, sure = np.concatenate((first, first[hot])), np.concatenate((bucket, spread)), np.concatenate((sure, np.ones(len(hot), bool)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(sure), *(pa.array(k[first]) for k in keys), pa.array(who, pa.binary())], names=["bucket", "known", *names, "who"]
            )

    return run


def place_schema(names: list[str]) -> str:
    return "bucket int, known boolean, " + ", ".join(f"{k} long" for k in names) + ", who binary"


def sample_keys(texts: DataFrame, buckets: int, find, names: list[str]) -> np.ndarray:
    """Keys of at most SAMPLED_PER_BUCKET suffixes for each bucket, sorted; each is of another place."""
    sample = texts.sample(SAMPLE_SHARE, seed=11).mapInArrow(place_batches(find, names, None, None), place_schema(names)).select(*names)
    got = sample.orderBy(F.xxhash64(F.rand(5))).limit(SAMPLED_PER_BUCKET * buckets).toPandas().to_numpy(dtype=np.int64).reshape(-1, len(names))
    return got[np.lexsort(got.T[::-1])]


def repeated_classes(sample: np.ndarray) -> set[tuple[int, int]]:
    """Class keys that a sorted sample holds at least twice."""
    twice = (sample[1:, -2:] == sample[:-1, -2:]).all(axis=1)
    return set(map(tuple, sample[1:, -2:][twice].tolist()))


def _unpack(who: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(who), PLACE)


FOUND_NAMES = [ROW_ID, "a", "s", "e", "anchor", "settled", "open", "one", "many", "edge"]
FOUND = f"{ROW_ID} long, a int, s int, e int, anchor long, settled boolean, open boolean, one boolean, many boolean, edge int"


def _found(places: np.ndarray, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*(np.ascontiguousarray(places[c]) for c in PLACE.names), *columns)], names=FOUND_NAMES)


def sort_bucket(names: list[str], many: int = MANY):
    """Sort a bucket, and tell repeats from the rest.

    settled: the stretch repeats as a whole; open: other stretches have its anchor; one: the first of its class; many: too
    many classes have the anchor; edge: the bucket, if the anchor is the first or last in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            sure = b["known"].to_numpy(zero_copy_only=False)
            if sure.any():
                at = _unpack(b["who"].filter(pa.array(sure)).to_pylist())
                no, zero = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
                yield _found(at, (zero, ~no, no, no, no, np.full(len(at), -1, np.int32)))
            if not sure.all():
                parts.append(b.filter(pa.array(~sure)))
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        stack = np.stack([t[k].to_numpy() for k in names])
        unsigned = stack.view(np.uint64) ^ np.uint64(1 << 63)
        n, depth = stack.shape[1], len(names)
        order, shared = multikey_quicksort(lambda i, level: unsigned[level, i], np.array([0]), np.array([n]), depth)
        new_anchor, new = shared < depth - 2, shared < depth
        who = t["who"].combine_chunks().take(pa.array(order)).to_pylist()
        members = np.array([len(x) // PLACE.itemsize for x in who])
        of_class, of_anchor = np.cumsum(new) - 1, np.cumsum(new_anchor) - 1
        in_class = np.bincount(of_class, weights=members)
        classes = np.bincount(of_anchor[new])
        edge = np.full(n, -1, np.int32)
        edge[(of_anchor == 0) | (of_anchor == of_anchor[-1])] = t["bucket"][0].as_py()
        named = mix64(sum(k.view(np.uint64)[order] * np.uint64(2 * i + 0x5851F42D4C957F2D) for i, k in enumerate(stack[:-2])))
        settled, open_ = in_class[of_class] > 1, classes[of_anchor] > 1
        wanted = np.flatnonzero(settled | open_ | (edge >= 0))
        of = np.repeat(wanted, members[wanted])
        one = np.concatenate(([True], of_class[of][1:] != of_class[of][:-1])) if len(of) else np.zeros(0, bool)
        yield _found(_unpack([who[i] for i in wanted.tolist()]), (named[of].view(np.int64), settled[of], open_[of], one, classes[of_anchor[of]] >= many, edge[of]))

    return run


def find_repeats(texts: DataFrame, window: int, gram: int, many: int = MANY) -> DataFrame:
    """(row, a, s, e, anchor, settled, compare, many) of all stretches whose leading part occurs elsewhere."""
    buckets = shuffle_partitions(texts)
    find = lambda ids, col: suffixes(ids, col, window, gram)
    sample = sample_keys(texts, buckets, find, KEYS)
    splitters = np.unique(sample[np.linspace(0, len(sample), buckets + 1).astype(int)[1:-1]], axis=0) if len(sample) > 1 else sample[:0]
    placed = texts.mapInArrow(place_batches(find, KEYS, lambda keys: locate(splitters, keys), repeated_classes(sample)), place_schema(KEYS))
    found = materialize(placed.repartitionById(buckets, F.pmod("bucket", F.lit(buckets))).mapInArrow(sort_bucket(KEYS, many), FOUND), "repeats")
    # anchors at the ends of two buckets or more, with their classes in all of these (a class is in one bucket); two rows a bucket at
    # most, so their number is bounded by the buckets
    ends = found.where("edge >= 0").groupBy("anchor").agg(F.min("edge").alias("first_bucket"), F.max("edge").alias("last_bucket"), F.sum(F.col("one").cast("int")).alias("classes"))
    across = ends.where("first_bucket < last_bucket").select("anchor", (F.col("classes") >= many).alias("across"))
    both = found.join(F.broadcast(across), "anchor", "left")
    compare, lots = F.col("one") & (F.col("open") | F.col("across").isNotNull()), F.col("many") | F.coalesce("across", F.lit(False))
    return both.select(ROW_ID, "a", "s", "e", "anchor", "settled", compare.alias("compare"), lots.alias("many"))


def places_of_rows(found: DataFrame) -> DataFrame:
    return found.groupBy(ROW_ID).agg(F.collect_list(F.struct("a", "s", "e", "anchor")).alias("todo"))


def each_place(b: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row in the batch, row id, a, s, e, anchor) of the places that the rows of a batch list."""
    todo, ids = b["todo"], b[ROW_ID].to_pylist()
    flat, offs = todo.flatten(), todo.offsets.to_numpy() - todo.offsets[0].as_py()
    row = np.repeat(np.arange(b.num_rows), np.diff(offs)).tolist()
    for r, *x in zip(row, *(flat.field(c).to_pylist() for c in ("a", "s", "e", "anchor"))):
        yield r, ids[r], *x


#: Bytes that a task gathers before it hands them on.
FLUSH = 1 << 22


def packed(rows: Iterator[tuple], pack) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose last field, of bytes, adds up to about FLUSH."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[-1]) + 64
        if size >= FLUSH:
            yield pack(*zip(*out))
            out, size = [], 0
    if out:
        yield pack(*zip(*out))


STRETCH = f"anchor long, {ROW_ID} long, a int, s int, e int, bytes binary"


def _send_stretches(window: int):
    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        data, starts, _ = text_bytes(b["text"])
        raw = memoryview(data)
        for r, row, a, s, e, anchor in each_place(b):
            yield anchor, row, a, s, e, bytes(raw[int(starts[r]) + s : int(starts[r]) + e + window])

    def pack(anchor, row, a, s, e, held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor, pa.int64()), pa.array(row, pa.int64()), *(pa.array(x, pa.int32()) for x in (a, s, e)), pa.array(held, pa.binary())],
            names=["anchor", ROW_ID, "a", "s", "e", "bytes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed((row for b in batches if b.num_rows for row in rows(b)), pack)

    return run


def shared_bytes(data: np.ndarray, at: np.ndarray, size: np.ndarray, step: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the strings of each segment and count the leading bytes that neighbours share.

    A string has `size` bytes of data, from `at` on upwards (step 1) or downwards (step -1), then zeros. Returns the place of each string in
    the order, and by place the bytes shared with the place before (-1 at a segment's start).
    """
    around = np.arange(8) * step
    last = len(data) - 1

    def word(i: np.ndarray, level: np.ndarray) -> np.ndarray:
        where = (at[i] + 8 * step * level)[:, None] + around
        got = data[np.clip(where, 0, last)]
        got[np.arange(8) >= (size[i] - 8 * level)[:, None]] = 0
        return got.view(">u8").reshape(-1).astype(np.uint64)

    depth = -(-int(size.max()) // 8)
    order, shared = multikey_quicksort(word, lo, hi, depth)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lcp = shared.astype(np.int64) * 8
    part = np.flatnonzero((shared >= 0) & (shared < depth))
    if len(part):
        level = shared[part].astype(np.int64)
        differ = word(order[part], level) ^ word(order[part - 1], level)
        lcp[part] += _equal_bytes(differ)
    lcp[shared < 0] = -1
    return place, lcp


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """Leading zero bytes of words that are not zero."""
    out = np.zeros(len(differ), np.int64)
    for k in range(1, 8):
        out += differ < np.uint64(1 << (64 - 8 * k))
    return out


def shared_windows(data: np.ndarray, first: np.ndarray, a: np.ndarray, s: np.ndarray, e: np.ndarray, group: np.ndarray, window: int, gram: int):
    """(row, first, last) runs of window starts whose windows are in two stretches of a group.

    Stretch i holds bytes s to e + window of its text, from data[first[i]] on, and has its anchor at a; group is sorted. A window that
    starts d bytes before the anchor is shared if two stretches share d bytes to the left of it and window - d from it on.
    """
    n = len(group)
    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    lo, hi = cut[:-1], cut[1:]
    left, right = (a - s).astype(np.int64), (e + window - a).astype(np.int64)
    at = first + left
    r_place, r_lcp = shared_bytes(data, at, right, 1, lo, hi)
    if left.max() > 0:
        l_place, l_lcp = shared_bytes(data, at - 1, left, -1, lo, hi)
    else:
        l_place, l_lcp = np.arange(n), np.where(np.isin(np.arange(n), lo), -1, 0)
    least = (a - e).astype(np.int64)
    most = window - gram
    flags = np.zeros((n, most + 2), bool)
    for d in range(int(least.min()), int(left.max()) + 1):
        live = np.flatnonzero((least <= d) & (d <= left))
        if len(live) < 2:
            continue
        key = np.cumsum(r_lcp < window - d)[r_place[live]] * (n + 1) + np.cumsum(l_lcp < d)[l_place[live]]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        flags[live[order[1:][same]], most - d] = True
        flags[live[order[:-1][same]], most - d] = True
    i, j = runs(flags.reshape(-1))
    row = i // (most + 2)
    base = a[row].astype(np.int64) - most - row * (most + 2)
    return row, i + base, j - 1 + base


def _match_stretches(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "anchor"):
            anchor, ids, a, s, e = (t[c].to_numpy() for c in ("anchor", ROW_ID, "a", "s", "e"))
            held = t["bytes"].to_pylist()
            size = np.array([len(x) for x in held])
            row, p, q = shared_windows(np.frombuffer(b"".join(held), np.uint8), np.cumsum(size) - size, a, s, e, anchor, window, gram)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(p), pa.array(q + window)], names=[ROW_ID, "first", "end"])

    return run


WINDOWS = f"high long, low long, {ROW_ID} long, p long"


def _count_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, starts, _ = text_bytes(b["text"])
            raw = memoryview(data)
            for r, row, _, s, e, _ in each_place(b):
                at = int(starts[r])
                high, low = content_keys(raw[at + p : at + p + window] for p in range(s, e + 1))
                p = np.arange(s, e + 1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(np.full(len(p), row, np.int64)), pa.array(p)], names=["high", "low", ROW_ID, "p"])

    return run


def repeated_windows(windows: DataFrame, window: int) -> DataFrame:
    """(row, first, end) of windows (columns high, low, row, p) whose content occurs at least twice. Counts are
    combined before the shuffle, and a join whose one side is a row a window can be split where a window is frequent."""
    twice = windows.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").select("high", "low")
    return windows.join(twice, ["high", "low"]).select(ROW_ID, F.col("p").alias("first"), (F.col("p") + window).alias("end"))


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """(row, spans): per row of texts (columns ROW_ID, text) with repeats, the spans of bytes to remove, unmerged. Texts are
    merged and not broadcast: the planner takes a string for 20 bytes."""
    found = find_repeats(texts, window, gram, many)
    spans = found.where("settled").select(ROW_ID, F.col("s").cast("long").alias("first"), (F.col("e") + window).cast("long").alias("end"))
    few = texts.hint("merge").join(places_of_rows(found.where("compare and not many")), ROW_ID).mapInArrow(_send_stretches(window), STRETCH)
    few = few.repartition(shuffle_partitions(texts), "anchor").sortWithinPartitions("anchor").mapInArrow(_match_stretches(window, gram), f"{ROW_ID} long, first long, end long")
    spans = spans.unionByName(few)
    if not found.where("compare and many").isEmpty():
        windows = texts.hint("merge").join(places_of_rows(found.where("compare and many")), ROW_ID).mapInArrow(_count_windows(window), WINDOWS)
        spans = spans.unionByName(repeated_windows(windows, window))
    return spans.groupBy(ROW_ID).agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def slices(b: pa.RecordBatch, text: str, limit: int = FLUSH) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `limit` bytes of text, so that what is made of them leaves in small batches."""
    _, starts, ends = text_bytes(b[text])
    for i, j in chunks_of(starts, ends, limit):
        yield b.slice(i, j - i)


def spans_of(b: pa.RecordBatch, name: str = "__gw_spans") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end of the spans of all rows of a batch, and where each row's begin (null is none)."""
    spans = b[name]
    flat = spans.flatten()
    return flat.field("first").to_numpy(), flat.field("end").to_numpy(), np.concatenate(([0], np.cumsum(np.array(spans.value_lengths().fill_null(0)))))


def _cut_spans(text: str, keep: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches if whole.num_rows for x in slices(whole, text)):
            data, starts, ends = text_bytes(b[text])
            first, end, offs = spans_of(b)
            out = [[] for _ in range(6)]
            for r in range(b.num_rows):
                part = data[starts[r] : ends[r]]
                if offs[r] == offs[r + 1]:
                    got = (len(part), 0, 0, hashlib.sha256(part).hexdigest(), [], b[text][r].as_py() if with_text else None)
                else:
                    f, e = merge_spans(first[offs[r] : offs[r + 1]], end[offs[r] : offs[r + 1]])
                    cuts = np.stack((f, e), axis=1).reshape(-1)
                    left = [part[i:j].tobytes() for i, j in np.concatenate(([0], cuts, [len(part)])).reshape(-1, 2).tolist()]
                    got = (len(part), int((e - f).sum()), len(f), hashlib.sha256(b"".join(left)).hexdigest(), cuts, "".join([x.decode("utf-8", "ignore") for x in left]) if with_text else None)
                for o, v in zip(out, got):
                    o.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string())
            names = NEW[: 5 + with_text]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(pa.array(o, t) for o, t, _ in zip(out, types, names))], names=[*keep, *names])

    return run


NEW = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"]
NEW_TYPES = ["long", "long", "long", "string", "array<long>", "string"]


@any_names(tuple(NEW), "text")
def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int | None = None, texts_out: bool = False, many: int = MANY) -> DataFrame:
    """docs plus n_bytes, n_removed, n_spans, kept_sha256 and spans; with texts_out, kept_text too.

    Every byte covered by a string of `window` bytes that also starts anywhere else in the column
    is removed; strings are judged on the input. spans lists first and end byte of each removed run, flat.
    Null texts count as empty, texts shorter than the window lose nothing, texts of any length are read whole, repeated rows are
    repeats of each other, an empty table gives an empty result, and columns of docs with the names of result
    columns are replaced. kept_text is the rest decoded as UTF-8, null for null: characters that are cut in two are
    left out (kept_sha256 is over all remaining bytes).
    """
    gram = gram or max(2, min(GRAM, window // 4))
    if gram < 8 * TOKENS:
        raise ValueError("the window is too short for the leading tokens")
    rows = with_row_id(docs)
    texts = rows.where(F.octet_length(text) >= window).select(ROW_ID, F.col(text).alias("text"))
    keep = docs.columns
    joined = rows.join(repeated_spans(texts, window, gram, many), ROW_ID, "left")
    given = joined.select(*keep, F.col("spans").alias("__gw_spans"))
    schema = output_schema(docs, keep, ", ".join(f"{c} {t}" for c, t in zip(NEW[: 5 + texts_out], NEW_TYPES)))
    return given.mapInArrow(_cut_spans(text, keep, texts_out), schema)
