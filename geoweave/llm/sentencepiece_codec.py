"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

A text is cut into units that no piece crosses. The units that a worker has not met are sorted by
length, and units of equal length advance together: substring hashes of all of them probe the sorted hashes
of the pieces, and vectorised maxima keep the best score and its backpointer at each position.

The result is the segmentation of greatest total piece score, as the library finds it for unigram
models. A model of merge (BPE) type is used as a table of scored pieces in the same way: the ids may
then differ from those that merging yields, but they decode to the same text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from geoweave.llm.common import any_names

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the model format: piece types, the space mark, what an unknown letter costs below the least score.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE, UNKNOWN_PENALTY = "▁", 10.0
HASH = np.uint64(0x9E6C63D0876A9A47)
CELLS, CACHE = 1 << 16, 300_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        shift = out = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            n = varint() if n is None else n
            yield tag >> 3, data[i : i + n]
            i += n


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    add_prefix: bool = True
    keys: np.ndarray = field(init=False)  # sorted hashes of the pieces that a text can hold
    ids: np.ndarray = field(init=False)
    longest: int = field(init=False)
    unit: re.Pattern = field(init=False)

    def __post_init__(self):
        usable = [i for i, t in enumerate(self.types) if t in (NORMAL, USER_DEFINED) and self.pieces[i]]
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        hashes = np.array([hash_points(np.array([list(map(ord, self.pieces[i]))], np.uint32))[0, -1] for i in usable], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(usable, np.int32)[order]
        self.maybe = np.zeros(1 << 20, bool)  # a filter before the search: the keys' leading bits
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        least, most = (float(f(self.scores[[i for i in usable if self.types[i] == NORMAL]])) if any(self.types[i] == NORMAL for i in usable) else 0.0 for f in (np.min, np.max))
        value = self.scores.astype(np.float64).copy()
        for i in usable:
            if self.types[i] == USER_DEFINED:
                value[i] = len(self.pieces[i]) * most - 0.1
        self.value, self.unknown_value = value[self.ids], least - UNKNOWN_PENALTY
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, t in enumerate(self.types) if t == BYTE}
        crossing = any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable)
        lines = any("\n" in self.pieces[i] for i in usable)
        self.unit = re.compile(r"(?s).+" if crossing else f"[^{SPACE}]+|{SPACE}+[^{SPACE}]*" if lines else f"\n+|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        text = lambda i: self.pieces[i].replace(SPACE, " ").encode()
        self.spelled = [bytes([int(p[3:5], 16)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else b"" if t == CONTROL else text(i) for i, (p, t) in enumerate(zip(self.pieces, self.types))]


def load(path: str = MODEL_PATH) -> Vocabulary:
    """Read a model file: pieces, scores and types, and whether a space is put before texts."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, types, prefix, squeeze, charsmap = [], [], [], True, True, b""
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            pieces.append(got.get(1, b"").decode())
            scores.append(struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0])
            types.append(got.get(3, NORMAL))
        elif number == 3:
            got = dict(_fields(value))
            prefix, squeeze, charsmap = bool(got.get(3, 1)), bool(got.get(4, 1)), got.get(2, b"")
    if squeeze or charsmap:
        raise ValueError("models that normalise texts are not supported: their decoding is not exact")
    return Vocabulary(pieces, np.array(scores, np.float32), np.array(types), prefix)


def hash_points(points: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes of the rows of code points; column 0 is the empty prefix."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    for j in range(points.shape[1]):
        out[:, j + 1] = out[:, j] * HASH + (points[:, j].astype(np.uint64) + np.uint64(0x51ED)) * np.uint64(0xD1B54A32D192ED03)
    return out


def viterbi(vocab: Vocabulary, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of the rows of code points (all of one length), one after another, and their lengths.

    Unknown letters are -1 - code point.
    """
    m, n = points.shape
    width = vocab.longest
    prefix = hash_points(points)
    power = np.full(width + 1, HASH, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    best = np.full((m, n + 1), -np.inf)
    best[:, 0] = 0
    back, piece = np.zeros((m, n + 1), np.int32), np.zeros((m, n + 1), np.int32)
    rows = np.arange(m)
    for j in range(1, n + 1):
        i = np.arange(max(0, j - width), j)
        h = prefix[:, j, None] - prefix[:, i] * power[j - i]
        hit = vocab.maybe[(h >> np.uint64(44)).astype(np.int64)]
        probes = h[hit]
        found = np.searchsorted(vocab.keys, probes)
        found[found == len(vocab.keys)] = 0
        at = np.zeros(h.shape, np.int64)
        at[hit] = found
        hit[hit] = vocab.keys[found] == probes
        total = best[:, i] + np.where(hit, vocab.value[at], -np.inf)
        lone = ~hit[:, -1]
        total[lone, -1] = best[lone, j - 1] + vocab.unknown_value
        k = np.argmax(total, axis=1)  # the first of equals: the longest last piece
        best[:, j], back[:, j] = total[rows, k], i[k]
        piece[:, j] = np.where(hit[rows, k], vocab.ids[at[rows, k]], -1 - points[:, j - 1].astype(np.int64))
    out = np.zeros((m, n), np.int32)
    taken = np.zeros((m, n), bool)
    pos = np.full(m, n)
    live = rows
    while len(live):
        p = pos[live]
        q = back[live, p]
        out[live, q], taken[live, q] = piece[live, p], True
        pos[live] = q
        live = live[q > 0]
    return out[taken], taken.sum(axis=1)


class Encoder:
    """Encodes texts; keeps the ids of units that it has met, up to about CACHE of them."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # unit -> its place in first and size
        self.flat, self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _spell(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace unknown letters by byte pieces, or by the unknown piece."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, sizes
        whole = len(self.vocab.bytes) == 256
        spelled = [[self.vocab.bytes[b] for b in chr(-1 - x).encode("utf-8", "surrogatepass")] if whole else [self.vocab.unknown] for x in ids[odd].tolist()]
        more = np.zeros(len(ids), np.int64)
        more[odd] = [len(x) - 1 for x in spelled]
        out = np.repeat(ids, more + 1)
        at = odd + np.cumsum(more[odd]) - more[odd]
        for k, x in zip(at.tolist(), spelled):
            out[k : k + len(x)] = x
        row = np.repeat(np.arange(len(sizes)), sizes)
        return out, sizes + np.bincount(row, weights=more, minlength=len(sizes)).astype(np.int64)

    def _learn(self, units: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        flat, sizes = [self.flat], [self.size]
        for n, group in by_length.items():
            step = max(1, CELLS // n)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
                ids, size = self._spell(*viterbi(self.vocab, points))
                self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))
                flat.append(ids)
                sizes.append(size)
        self.flat, self.size = np.concatenate(flat), np.concatenate(sizes)
        self.first = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > CACHE:
            self._forget()
        mark = SPACE if self.vocab.add_prefix else ""
        split = [self.vocab.unit.findall(mark + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*split) - self.known.keys() if split else set()
        if new:
            self._learn(new)
        out = []
        for units in split:
            k = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
            size = self.size[k]
            before = np.cumsum(size) - size
            out.append(self.flat[np.repeat(self.first[k] - before, size) + np.arange(int(size.sum()))])
        return out

    def decode(self, ids: np.ndarray) -> str:
        spelled = self.vocab.spelled
        out = b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return out[1:] if self.vocab.add_prefix and out.startswith(" ") else out


def _slices(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < limit):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


@any_names(("n_tokens", "n_byte_pieces", "ids_sha256", "round_trip", "token_ids"), "text")
def encode(docs: DataFrame, vocab: Vocabulary, text: str = "text", with_ids: bool = True) -> DataFrame:
    """docs plus n_tokens, n_byte_pieces, ids_sha256 (of little-endian 32-bit ids), round_trip and, on demand, token_ids.

    round_trip says that decoding gave the text back. Null and empty texts have no tokens, and a null
    text's round_trip is true. Letters without a piece are spelled in byte pieces; without those the
    unknown piece is used and round_trip is false. Whole texts are encoded, however long; columns of docs
    with the names of result columns are replaced; of segmentations of equal score that with the longest last piece is taken;
    repeated rows give rows each; an empty table gives an empty result.
    """
    new = ["n_tokens", "n_byte_pieces", "ids_sha256", "round_trip", *["token_ids"] * with_ids]
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    kinds = [LongType(), LongType(), StringType(), BooleanType(), *[ArrayType(IntegerType())] * with_ids]
    schema = StructType([*docs.schema.fields, *(StructField(n, k) for n, k in zip(new, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        is_byte = shared.value.types == BYTE
        for b in batches:
            texts = b[text].to_pylist()
            for i, j in _slices(texts):  # results leave in small batches: ids take more room than their texts
                found = encoder.encode(texts[i:j])
                sizes = np.array([len(x) for x in found])
                digests = [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in found]
                same = [encoder.decode(x) == (t or "") for t, x in zip(texts[i:j], found)]
                cols = [pa.array(sizes, pa.int64()), pa.array([int(is_byte[x].sum()) for x in found], pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, *cols], names=[*b.schema.names, *new])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, vocab: Vocabulary, ids: str = "token_ids") -> DataFrame:
    """rows plus decoded_text; null and empty id lists decode to the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for b in batches:
            yield pd.Series([encoder.decode(np.asarray(x if x is not None else [], np.int64)) for x in b], dtype=object)

    return rows.withColumn("decoded_text", run(F.col(ids)))
