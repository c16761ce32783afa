"""Words of whole texts as arrays: bytes are folded by a table, and every word has its place and a 64-bit code."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from geoweave.llm.anchors import word_codes, word_spans
from geoweave.llm.common import chunks_of, text_bytes

SPACE = 32


def fold_table(separates) -> np.ndarray:
    """256 bytes: A-Z in lower case, bytes that separate words as spaces, others as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[np.array([separates(i) for i in range(256)])] = SPACE
    return table


#: Words are runs of a-z, 0-9 and all that is not ASCII.
ALNUM = fold_table(lambda b: b < 0x80 and not chr(b).isalnum())


@dataclass
class Words:
    """Words of the rows [start, stop) of a batch: their bytes are data[first:end], row start + i has the words low[i] to high[i]."""

    start: int
    stop: int
    data: np.ndarray
    first: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def codes(self) -> np.ndarray:
        return word_codes(self.data, self.first, self.end)


def read_words(col, table: np.ndarray, limit: int) -> Iterator[Words]:
    """The words of a column in chunks of about `limit` bytes of whole texts; null texts have none."""
    data, starts, ends = text_bytes(col)
    for i, j in chunks_of(starts, ends, limit):
        at = int(starts[i])
        part = table[data[at : max(at, int(ends[j - 1]))]]
        yield Words(i, j, part, *word_spans(part, starts[i:j] - at, ends[i:j] - at))


def joined(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words one after another with one space between them, and where each begins: a run of words is a stretch of these bytes."""
    size = words.end - words.first
    begin = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), SPACE, np.uint8)
    take = np.arange(int(size.sum()))
    skip = np.cumsum(size) - size
    out[take + np.repeat(begin - skip, size)] = words.data[take + np.repeat(words.first - skip, size)]
    return out, begin


def quantity(name: str, value: int, least: int) -> int:
    if value < least:
        raise ValueError(f"{name} must be at least {least}")
    return value
