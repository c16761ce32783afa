"""Mining of phrase collocations, level by level.

Level 1 counts the words of each language. Level k counts runs of k words whose first and last k - 1 words are both frequent: hashes of the
frequent runs of level k - 1 are broadcast, as a sorted list up to LISTED of them and beyond that as a table of BITS bits, so what is broadcast
has a bound whatever the corpus holds. Either only spares rows: a run that passes by an equal hash is counted like any other, and what is frequent
is decided by the counts, which go by the words themselves. Runs are counted in each batch and in each task before the shuffle.

Cuts are scored by joining the levels with themselves, in exact decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.llm.anchors import Rolling, word_codes, word_spans
from geoweave.llm.common import chunks_of, column, materialize, mix64, release, text_bytes
from geoweave.llm.words import SPACE, fold_table, quantity

LEAST, LONGEST, INSIDE_PERCENT, TOP = 100, 5, 100, 2000
#: Bytes that end a piece of text, and those that separate words in it. (Fixed values.)
ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of text that are counted at once.
BYTES = 2 << 20
#: So many hashes are broadcast as a list (of 8 bytes each); more of them share a table of so many bits.
LISTED, BITS = 1 << 21, 1 << 27

FOLD = fold_table(lambda b: b in ENDS or b in SPACES)
IS_END = np.isin(np.arange(256), np.frombuffer(ENDS, np.uint8))


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Folded bytes, first and end byte of each word, and the row and the piece of each word; the rows are ascending stretches of data."""
    at = int(starts[0])
    part = data[at : max(at, int(ends[-1]))]
    starts, ends = starts - at, ends - at
    folded = FOLD[part]
    first, end, low, high = word_spans(folded, starts, ends)
    row = np.repeat(np.arange(len(starts)), high - low)
    broken = np.zeros(len(part) + 1, np.int64)
    broken[1:] = np.cumsum(IS_END[part])
    return folded, first, end, row, broken[first] + row


def _hashes(roll: Rolling, p: np.ndarray, k: int, salt: np.ndarray) -> np.ndarray:
    """Hashes of the runs of k words from p on, in a language."""
    return mix64(roll.at(p, k) ^ salt)


def _salts(langs: list[str]) -> np.ndarray:
    raw = [x.encode("utf-8") for x in langs]
    size = np.array([len(x) for x in raw])
    ends = np.cumsum(size)
    return mix64(word_codes(np.frombuffer(b"".join(raw), np.uint8), ends - size, ends) + np.uint64(1)) if len(raw) else np.zeros(0, np.uint64)


class Frequent:
    """The hashes of frequent runs: a sorted list, or bits at the hashes' lowest digits."""

    def __init__(self, listed: np.ndarray | None, bits: np.ndarray | None):
        self.listed, self.bits = listed, bits

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.listed is not None:
            if not len(self.listed):
                return np.zeros(len(h), bool)
            return self.listed[np.minimum(np.searchsorted(self.listed, h), len(self.listed) - 1)] == h
        slot = h & np.uint64(64 * len(self.bits) - 1)
        return (self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _phrase_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of frequent phrases, as the pass over the texts makes them."""
    for b in batches:
        data, starts, ends = text_bytes(b["phrase"])
        for i, j in chunks_of(starts, ends, BYTES):
            folded, first, end, row, _ = _pieces(data, starts[i:j], ends[i:j])
            roll = Rolling(word_codes(folded, first, end))
            size = np.bincount(row, minlength=j - i)
            salts = _salts(b["lang"].slice(i, j - i).to_pylist())
            out = np.zeros(j - i, np.uint64)
            for k in np.unique(size).tolist():
                some = np.flatnonzero(size == k)
                out[some] = _hashes(roll, (np.cumsum(size) - size)[some], k, salts[some])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["h"])


def frequent_runs(level: DataFrame, listed: int = LISTED, bits: int = BITS) -> Frequent:
    """The hashes of a level's phrases; at most `listed` numbers or `bits` bits come to the driver."""
    hashes = level.mapInArrow(_phrase_hashes, "h long")
    if level.count() <= listed:
        return Frequent(np.sort(hashes.toArrow()["h"].to_numpy().view(np.uint64)), None)
    slot = F.col("h").bitwiseAND(bits - 1)
    words = hashes.select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words["at"].to_numpy()] = words["word"].to_numpy().view(np.uint64)
    return Frequent(None, table)


def _count(k: int, frequent: Broadcast | None):
    """(lang, phrase, n) of the runs of k words of each chunk of texts whose two runs of k - 1 words are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, starts, ends = text_bytes(b["text"])
            for i, j in chunks_of(starts, ends, BYTES):
                yield from count_runs(data, starts[i:j], ends[i:j], b["lang"].slice(i, j - i), k, frequent.value if frequent else None)

    return run


def count_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: pa.Array, k: int, frequent: Frequent | None) -> Iterator[pa.RecordBatch]:
    folded, first, end, row, piece = _pieces(data, starts, ends)
    if len(first) < k:
        return
    codes = word_codes(folded, first, end)
    roll = Rolling(codes)
    named = langs.dictionary_encode()
    salt = _salts(named.dictionary.to_pylist())[named.indices.to_numpy()][row]
    p = np.flatnonzero(piece[k - 1 :] == piece[: len(piece) - k + 1])
    if k > 1:
        ok = np.zeros(len(first), bool)
        q = np.flatnonzero(piece[k - 2 :] == piece[: len(piece) - k + 2])
        ok[q] = frequent.has(_hashes(roll, q, k - 1, salt[q]))
        p = p[ok[p] & ok[p + 1]]
    if not len(p):
        return
    one, two = _hashes(roll, p, k, salt[p]), _hashes(Rolling(mix64(codes + np.uint64(1))), p, k, salt[p])
    order = np.argsort(one)
    new = np.flatnonzero(np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))))
    times, p = np.diff(np.append(new, len(p))), p[order[new]]
    yield pa.RecordBatch.from_arrays([langs.take(pa.array(row[p])), _phrases(folded, first, end, p, k), pa.array(times)], names=["lang", "phrase", "n"])


def _phrases(folded: np.ndarray, first: np.ndarray, end: np.ndarray, p: np.ndarray, k: int) -> pa.Array:
    """The runs of k words from p on, joined by one space."""
    words = (p[:, None] + np.arange(k)).reshape(-1)
    size = end[words] - first[words]
    width = size + 1  # a space after each word
    at = np.cumsum(width) - width
    total = int(width.sum())
    source = np.arange(total) + np.repeat(first[words] - at, width)
    out = folded[np.minimum(source, len(folded) - 1)]
    out[at + size] = SPACE
    offsets = np.append(at[::k], total)
    keep = np.ones(total, bool)
    keep[offsets[1:] - 1] = False  # but after the last of a run
    return pa.StringArray.from_buffers(len(p), pa.py_buffer((offsets - np.arange(len(offsets))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out[keep])))


def level_tables(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, listed: int = LISTED, bits: int = BITS) -> tuple[list[DataFrame], DataFrame]:
    """Per level, the table (lang, phrase, f) of the runs of words that texts (columns lang, text) hold `least` times or more, of single
    words all; and (lang, n) words of all."""
    counted = texts.mapInArrow(_count(1, None), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    words = materialize(counted, "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [words]
    for k in range(2, longest + 1):
        known = texts.sparkSession.sparkContext.broadcast(frequent_runs(levels[-1].where(F.col("f") >= least), listed, bits))
        runs = texts.mapInArrow(_count(k, known), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        levels.append(materialize(runs.where(F.col("f") >= least), f"level{k}"))
        known.destroy()
    return levels, totals


def _part(words: Column, start: int, size: int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def score_cuts(levels: list[DataFrame], totals: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score) of all phrases of two words or more, each by its lowest-scoring cut."""
    known = reduce(DataFrame.unionByName, levels).where(F.col("f") >= least)
    words = F.split("phrase", " ")
    cuts = [
        level.select("lang", "phrase", F.lit(k).alias("k"), F.col("f").alias("a"), F.lit(c).alias("cut"), _part(words, 1, c).alias("left"), _part(words, c + 1, k - c).alias("right"))
        for k, level in enumerate(levels, 1) for c in range(1, k)
    ]
    left, right = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    both = reduce(DataFrame.unionByName, cuts).join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(18,0)")
    over, under = F.lit(1000).cast("decimal(4,0)") * big("a") * F.col("n").cast("decimal(16,0)"), big("l") * big("r")
    both = both.withColumn("over", over).withColumn("under", under).withColumn("score", F.expr("over div under"))
    best = both.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "k", "a", "best.l", "best.r", "n", "best.score")


def drop_inner(scored: DataFrame, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """The phrases that lie in no longer one with inside_percent of their count. One word more is enough to look at: what lies
    in a longer one lies in a part of it with one word more, which occurs as often at least."""
    words = F.split("phrase", " ")
    longer = scored.where(F.col("k") > 2)
    inner = longer.select("lang", "a", F.explode(F.array(_part(words, 1, F.col("k") - 1), _part(words, 2, F.col("k") - 1))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    return scored.join(most, ["lang", "phrase"], "left").where("around is null or 100 * around < %d * a" % inside_percent).drop("around")


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, inside_percent: int = INSIDE_PERCENT, top: int = TOP,
    listed: int = LISTED, bits: int = BITS,
) -> DataFrame:
    """(lang, rank, phrase, k, a, l, r, n, score): the `top` best phrases of 2 to `longest` words of each language (null is `und`).

    Texts are lower-cased (A-Z) and split into pieces at ENDS and into words at SPACES; phrases stay within pieces. a, l and r count the
    phrase and the parts of its lowest-scoring cut (of ties the first), n all words; score is 1000 a n / (l r), rounded down, computed exactly.
    Ties in score go to the more frequent phrase, then to the first in the order of bytes. Null and empty texts hold nothing, texts
    of any length are read whole, repeated documents count each time, an empty table gives an empty result, other columns are not looked at.
    """
    quantity("least", least, 1), quantity("longest", longest, 2), quantity("bits", bits, 64)
    texts = docs.select(F.coalesce(column(lang).cast("string"), F.lit("und")).alias("lang"), column(text).alias("text"))
    levels, totals = level_tables(texts, least, longest, listed, bits)
    scored = materialize(score_cuts(levels, totals, least), "phrases")
    for level in levels:
        release(level)
    left = drop_inner(scored, inside_percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "k", "a", "l", "r", "n", "score")
