"""Removal of repeated passages of words with sharded Aho-Corasick automata.

1. Each document's words are hashed; each window of `window` words is filed under its anchor phrase
   (see anchors.py). The stretch of windows of one anchor is a passage. Places of phrases that recur are written down
   with the class of their passage (equal passages are one class); this is only a filter by hash.
2. One passage of each class is read from its document and goes to the shard of its phrase. A shard confirms phrases:
   those whose own words are there at least twice. It compiles an automaton over the confirmed phrases, streams its passages
   through it, and locates every occurrence. Only windows that hold an occurrence are compared; those
   that are in two passages, or in one that has copies, recur. Without automata nothing would be removed.
3. What recurs in a passage recurs in all documents that have a passage of its class.

A shard streams groups of phrases sorted by key, and compiles one automaton for each slice of them, so its memory
follows the slice, not the corpus. Classes that the sample of step 1 holds twice send one place of each batch to their shard.
A phrase with very many unlike passages has its windows counted one by one, combined before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.anchors import Rolling, find_anchors, merge_spans, runs, segments, word_codes, word_spans
from geoweave.llm.common import ROW_ID, any_names, chunks_of, materialize, mix64, output_schema, shuffle_partitions, text_bytes, whole_groups, with_row_id
from geoweave.llm.suffix_dedup import CLASS, MANY, PLACE, alike, content_keys, packed, place_batches, place_schema, repeated_classes, sample_keys, slices, spans_of

WINDOW, PHRASE = 35, 6
KEYS = ["gram", *CLASS]
#: Bytes that are split into words at once.
BYTES = 1 << 20


def phrases(row_ids: np.ndarray, texts, window: int = WINDOW, gram: int = PHRASE) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys and places (in words) of all anchor phrases of a batch of texts."""
    data, starts, ends = text_bytes(texts)
    keys, places = [[] for _ in KEYS], []
    for i, j in chunks_of(starts, ends, BYTES):
        at = int(starts[i])
        part = data[at : int(ends[j - 1])]
        first, end, low, high = word_spans(part, starts[i:j] - at, ends[i:j] - at)
        codes = word_codes(part, first, end)
        for lo, hi, rows, s, e in segments(low, high, window):
            roll = Rolling(codes[lo:hi])
            row, a, p, q, g = find_anchors(roll, s, e, window, gram)
            if not len(a):
                continue
            raw = memoryview(codes[lo:hi].tobytes())
            top, bottom = content_keys(raw[8 * x : 8 * y] for x, y in zip(p.tolist(), (q + window).tolist()))
            bottom = bottom ^ mix64((a - p).astype(np.uint64) + np.uint64(1)).view(np.int64)  # and where the phrase is
            for k, v in zip(keys, (mix64(g).view(np.int64), top, bottom)):
                k.append(v)
            found = np.zeros(len(a), PLACE)
            base = lo - low[rows[row]]
            found["row"], found["a"], found["s"], found["e"] = row_ids[i + rows[row]], a + base, p + base, q + base
            places.append(found)
    if not places:
        return [np.zeros(0, np.int64) for _ in KEYS], np.zeros(0, PLACE)
    return [np.concatenate(k) for k in keys], np.concatenate(places)


FOUND = f"{ROW_ID} long, a int, s int, e int, high long, low long, gram long, twice boolean, many boolean"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _recurring(known: set[tuple[int, int]], many: int):
    """Places of phrases that are in a bucket at least twice; gram is null but for one place of each class.

    twice: the class has copies; many: too many classes have the phrase.
    """

    def rows(who: list[bytes], keys: list[np.ndarray], gram, twice, lots) -> pa.RecordBatch:
        places = np.frombuffer(b"".join(who), PLACE)
        of = np.repeat(np.arange(len(who)), [len(x) // PLACE.itemsize for x in who])
        columns = [pa.array(np.ascontiguousarray(places[c])) for c in PLACE.names] + [pa.array(k[of]) for k in keys[1:]]
        one = np.concatenate(([True], of[1:] != of[:-1])) & gram[of]
        columns.append(pa.array(keys[0][of], mask=~one))
        return pa.RecordBatch.from_arrays([*columns, pa.array(twice[of]), pa.array(lots[of])], names=FOUND_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            sure = b["known"].to_numpy(zero_copy_only=False)
            if sure.any():
                t = b.filter(pa.array(sure))
                no = np.zeros(t.num_rows, bool)
                yield rows(t["who"].to_pylist(), [t[k].to_numpy() for k in KEYS], no, ~no, no)
            if not sure.all():
                parts.append(b.filter(pa.array(~sure)))
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        keys = [t[k].to_numpy() for k in KEYS]
        order, first = alike(keys)
        keys = [k[order] for k in keys]
        who = t["who"].combine_chunks().take(pa.array(order)).to_pylist()
        members = np.array([len(x) // PLACE.itemsize for x in who])
        new = np.zeros(len(who), bool)
        new[first] = True
        new_gram = np.concatenate(([True], keys[0][1:] != keys[0][:-1]))
        of_class, of_gram = np.cumsum(new) - 1, np.cumsum(new_gram) - 1
        copies = np.bincount(of_class, weights=members)[of_class] > 1
        if known:
            copies |= np.fromiter((x in known for x in zip(keys[1].tolist(), keys[2].tolist())), bool, len(who))
        classes = np.bincount(of_gram[first])[of_gram]
        wanted = np.flatnonzero(copies | (classes > 1))
        if len(wanted):
            yield rows([who[i] for i in wanted.tolist()], [k[wanted] for k in keys], new[wanted], copies[wanted], classes[wanted] >= many)

    return run


def find_passages(texts: DataFrame, window: int, gram: int, many: int = MANY) -> DataFrame:
    """Places of all passages whose phrase's hash occurs elsewhere, as FOUND."""
    buckets = shuffle_partitions(texts)
    find = lambda ids, col: phrases(ids, col, window, gram)
    known = repeated_classes(sample_keys(texts, buckets, find, KEYS))
    place = lambda keys: (keys[0].view(np.uint64) >> np.uint64(34)).astype(np.int32)
    placed = texts.mapInArrow(place_batches(find, KEYS, place, known), place_schema(KEYS))
    return materialize(placed.repartitionById(buckets, F.pmod("bucket", F.lit(buckets))).mapInArrow(_recurring(known, many), FOUND), "recurring")


def _words(b: pa.RecordBatch) -> Iterator[tuple]:
    """(words, row's todo as lists) of each row of a batch."""
    for text, todo in zip(b["text"], b["todo"]):
        yield text.as_py().encode("utf-8").split(), todo.as_py()


PASSAGE = "gram long, high long, low long, at int, twice boolean, passage binary"


def _send_passages(window: int):
    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for words, todo in _words(b):
            for x in todo:
                yield x["gram"], x["high"], x["low"], x["a"] - x["s"], x["twice"], b" ".join(words[x["s"] : x["e"] + window])

    def pack(*columns) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in PASSAGE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed((row for b in batches if b.num_rows for row in rows(b)), pack)

    return run


def confirm(phrases: list[bytes], weights: list[int]) -> set[bytes]:
    """The phrases that are there at least twice, word by word."""
    seen: dict[bytes, int] = {}
    for x, n in zip(phrases, weights):
        seen[x] = seen.get(x, 0) + n
    return {x for x, n in seen.items() if n > 1}


def compile_automaton(found: set[bytes]) -> ahocorasick.Automaton:
    """An automaton over phrases, each with a space before and after it; values are their lengths with these.

    Bytes stand for themselves as letters, so places in a text are places in its UTF-8.
    """
    out = ahocorasick.Automaton()
    for x in found:
        out.add_word(f" {x.decode('latin-1')} ", len(x) + 2)
    if found:
        out.make_automaton()
    return out


def occurrences(automaton: ahocorasick.Automaton, text: bytes) -> np.ndarray:
    """Place of the first byte of every occurrence of a phrase in texts of words joined by one space, a space on either side."""
    if not len(automaton):
        return np.zeros(0, np.int64)
    return np.array([end - n + 2 for end, n in automaton.iter(text.decode("latin-1"))], np.int64)


def _match_passages(window: int, gram: int):
    """Spans of words (of a passage of each class) that recur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "gram"):
            passages, twice, at = t["passage"].to_pylist(), t["twice"].to_numpy(), t["at"].to_numpy()
            sizes = np.array([len(x) for x in passages])
            joined = b"\n".join([b" %b " % x for x in passages])
            starts = np.cumsum(sizes + 3) - sizes - 2
            data = np.frombuffer(joined, np.uint8)
            first, end, low, high = word_spans(data, starts, starts + sizes)
            heads, tails = first[low + at].tolist(), end[low + at + gram - 1].tolist()
            automaton = compile_automaton(confirm([joined[i:j] for i, j in zip(heads, tails)], (1 + twice).tolist()))
            hit = np.searchsorted(first, occurrences(automaton, joined))
            lens = high - low - window + 1
            of = np.searchsorted(low, hit, "right") - 1
            a, z = np.maximum(low[of], hit + gram - window), np.minimum(low[of] + lens[of], hit + 1)
            holds = np.zeros(len(first) + 1, np.int64)  # windows that hold an occurrence
            some = a < z
            np.add.at(holds, a[some], 1)
            np.add.at(holds, z[some], -1)
            row = np.repeat(np.arange(len(passages)), lens)
            index = np.arange(len(row)) + (low - np.cumsum(lens) + lens)[row]
            looked = np.cumsum(holds)[index] > 0
            row, index = row[looked], index[looked]
            flags = np.zeros(len(first) + len(low) + 1, bool)
            again = recurs(data, first, end, index, window, twice[row])
            flags[(index + row)[again]] = True  # a gap after each passage keeps runs within passages
            i, j = runs(flags)
            r = np.searchsorted(low + np.arange(len(low)), i, "right") - 1
            base = low[r] + r
            yield pa.RecordBatch.from_arrays([pa.array(t["high"].to_numpy()[r]), pa.array(t["low"].to_numpy()[r]), pa.array(i - base), pa.array(j - base - 1 + window)], names=["high", "low", "first", "end"])

    return run


def recurs(data: np.ndarray, first: np.ndarray, end: np.ndarray, index: np.ndarray, window: int, twice: np.ndarray) -> np.ndarray:
    """Whether each window (from word index on) is there twice, or in a passage with copies; by two hashes of its words."""
    if not len(index):
        return np.zeros(0, bool)
    codes = word_codes(data, first, end)
    one, two = Rolling(codes).at(index, window), Rolling(mix64(codes + np.uint64(1))).at(index, window)
    order = np.lexsort((two, one))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    out = twice.copy()
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


WINDOWS = "h1 long, h2 long, high long, low long, p int, weight int"


def _count_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, todo in _words(b):
                for x in todo:
                    n = x["e"] - x["s"] + 1
                    h1, h2 = content_keys(b" ".join(words[p : p + window]) for p in range(x["s"], x["e"] + 1))
                    fill = lambda v, t: pa.array(np.full(n, v, t))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), fill(x["high"], np.int64), fill(x["low"], np.int64), pa.array(np.arange(n, dtype=np.int32)), fill(1 + x["twice"], np.int32)], names=[x.split()[0] for x in WINDOWS.split(", ")])

    return run


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = PHRASE, many: int = MANY) -> DataFrame:
    """(row, spans): per row of texts (columns ROW_ID, text) with repeats, the spans of words to remove, unmerged."""
    found = find_passages(texts, window, gram, many)
    todo = lambda rows: rows.groupBy(ROW_ID).agg(F.collect_list(F.struct("a", "s", "e", "gram", "high", "low", "twice")).alias("todo"))
    one = found.where("gram is not null")
    sent = texts.join(todo(one.where("not many")), ROW_ID).mapInArrow(_send_passages(window), PASSAGE)
    sent = sent.repartition(shuffle_partitions(texts), "gram").sortWithinPartitions("gram")
    of_class = sent.mapInArrow(_match_passages(window, gram), "high long, low long, first long, end long")
    if not one.where("many").isEmpty():
        # in one query with what is sent, so that the texts are shuffled once for both
        windows = texts.join(todo(one.where("many")), ROW_ID).mapInArrow(_count_windows(window), WINDOWS)
        again = windows.groupBy("h1", "h2").agg(F.sum("weight").alias("n")).where("n > 1").select("h1", "h2")
        of_class = of_class.unionByName(windows.join(again, ["h1", "h2"]).select("high", "low", F.col("p").cast("long").alias("first"), (F.col("p") + window).cast("long").alias("end")))
    spans = found.select(ROW_ID, "s", "high", "low").join(of_class, ["high", "low"])
    return spans.groupBy(ROW_ID).agg(F.collect_list(F.struct((F.col("s") + F.col("first")).alias("first"), (F.col("s") + F.col("end")).alias("end"))).alias("spans"))


NEW = ["n_words", "n_removed", "kept_sha256", "spans", "kept_text"]
NEW_TYPES = ["long", "long", "string", "array<long>", "string"]


def _cut_words(text: str, keep: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches if whole.num_rows for x in slices(whole, text)):
            (first, end, offs), out = spans_of(b), [[] for _ in range(5)]
            for r, said in enumerate(b[text]):
                words = (said.as_py() or "").encode("utf-8").split()
                n, gone, cuts = len(words), 0, []
                if offs[r] < offs[r + 1]:
                    f, e = merge_spans(first[offs[r] : offs[r + 1]], end[offs[r] : offs[r + 1]])
                    gone, cuts = int((e - f).sum()), np.stack((f, e), axis=1).reshape(-1).tolist()
                    words = [w for i, j in zip([0, *cuts[1::2]], [*cuts[::2], n]) for w in words[i:j]]
                kept = b" ".join(words)
                for o, v in zip(out, (n, gone, hashlib.sha256(kept).hexdigest(), cuts, kept.decode("utf-8") if with_text else None)):
                    o.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string())
            names = NEW[: 4 + with_text]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(pa.array(o, t) for o, t, _ in zip(out, types, names))], names=[*keep, *names])

    return run


@any_names(tuple(NEW), "text")
def remove_passages(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int | None = None, texts_out: bool = False, many: int = MANY) -> DataFrame:
    """docs plus n_words, n_removed, kept_sha256 and spans; with texts_out, kept_text too.

    Every word covered by a run of `window` words that also starts anywhere else in the column is
    removed; runs are judged on the input. spans lists first and end word of each removed run, flat; kept_text
    joins the kept words by one space. Null texts have no words, shorter texts lose nothing, texts of any length are read whole,
    repeated rows are repeats of each other, an empty table gives an empty result, and columns of docs with the
    names of result columns are replaced.
    """
    gram = gram or max(1, min(PHRASE, window // 3))
    keep = docs.columns
    rows = with_row_id(docs)
    texts = rows.where(F.octet_length(text) >= 2 * window - 1).select(ROW_ID, F.col(text).alias("text"))
    joined = rows.join(repeated_spans(texts, window, gram, many), ROW_ID, "left")
    given = joined.select(*keep, F.col("spans").alias("__gw_spans"))
    schema = output_schema(docs, keep, ", ".join(f"{c} {t}" for c, t in zip(NEW[: 4 + texts_out], NEW_TYPES)))
    return given.mapInArrow(_cut_words(text, keep, texts_out), schema)
