"""Rolling hashes and content-chosen anchors over concatenated rows of units (bytes or words).

Every window of `window` units holds a `gram`-unit string of least hash, its anchor, and the choice
depends on the window's content alone. Two equal windows therefore have equal anchors at equal
offsets, and comparing the neighbourhoods of equal anchors finds every repeated window, though
only about one position in `window / 2` is an anchor.
"""

from __future__ import annotations

import numpy as np

from geoweave.llm.common import mix64

#: Fixed odd multiplier of the polynomial hash over 64-bit words, and its inverse.
BASE = 0x9B1A4F0C6D2E5873
INVERSE = pow(BASE, -1, 1 << 64)
#: Units that are handled at once; positions within them take POSITION bits.
CHUNK, POSITION = 1 << 18, 24
#: Bytes of words that are hashed at once.
PIECE = 1 << 18
_powers: dict[int, np.ndarray] = {}
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 4096)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


class Rolling:
    """Position-independent hashes of any stretch of an array of uint64 codes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def at(self, p: np.ndarray, length) -> np.ndarray:
        """Hashes of the stretches that start at positions p."""
        return (self.sums[p + length] - self.sums[p]) * self.back[p]

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.back[:n] if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by block-wise prefix and suffix minima."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def find_anchors(rolling: Rolling, starts: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Anchors of all windows of the rows [start, end) within one chunk.

    Returns row, anchor, first and last window start that has this anchor, and the anchor's hash.
    """
    empty = np.zeros(0, np.int64)
    long_ = np.flatnonzero(ends - starts >= window)
    grams = rolling.all(gram)
    if not len(long_) or len(grams) < window - gram + 1:
        return empty, empty, empty, empty, empty.astype(np.uint64)
    low = np.uint64((1 << POSITION) - 1)
    ranked = (mix64(grams) & ~low) | np.arange(len(grams), dtype=np.uint64)
    best = sliding_min(ranked, window - gram + 1)
    counts = ends[long_] - starts[long_] - window + 1
    row = np.repeat(long_, counts)
    first = np.cumsum(counts) - counts
    p = np.arange(len(row)) - np.repeat(first, counts) + np.repeat(starts[long_], counts)
    anchor = (best[p] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
    last = np.concatenate((new[1:], [len(row)])) - 1
    a = anchor[new]
    return row[new], a, p[new], p[last], grams[a]


def segments(starts: np.ndarray, ends: np.ndarray, window: int, limit: int = CHUNK):
    """Deal rows into chunks of at most about `limit` units.

    Yields (low, high, rows, starts, ends): the stretch of units, the row numbers, and the rows'
    bounds in the stretch. A row above the limit is cut into stretches that overlap by window - 1.
    """
    i, n = 0, len(starts)
    while i < n:
        if ends[i] - starts[i] > limit:
            for s in range(int(starts[i]), int(ends[i]) - window + 1, limit - window + 1):
                e = min(int(ends[i]), s + limit)
                yield s, e, np.array([i]), np.array([0]), np.array([e - s])
            i += 1
            continue
        j = i
        while j < n and ends[j] - starts[i] <= limit:
            j += 1
        lo = int(starts[i])
        yield lo, int(max(ends[i:j].max(), lo)), np.arange(i, j), starts[i:j] - lo, ends[i:j] - lo
        i = j


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """First and end byte of each word of the rows in data, and each row's first and end word.

    The rows must be ascending stretches of data; bytes between rows separate words.
    """
    ink = np.zeros(len(data) + 2, np.int8)
    ink[1:-1] = ~is_space(data)
    edge = np.diff(ink)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # words that run over the end of a row, where no byte separates rows
    cut = starts[(starts > 0) & (starts < len(data))]
    cut = np.unique(cut[(ink[cut] == 1) & (ink[cut + 1] == 1)])
    if len(cut):
        first, end = np.sort(np.concatenate((first, cut))), np.sort(np.concatenate((end, cut)))
    return first, end, np.searchsorted(first, starts), np.searchsorted(first, ends)


def word_codes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code for each word, from its bytes and its length. Hashed in pieces, as sums take 8 bytes and more for each byte."""
    out = np.empty(len(first), np.uint64)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(end, first[i] + PIECE, "right")))
        low, size = int(first[i]), end[i:j] - first[i:j]
        r = Rolling(BYTE_CODES[data[low : int(end[j - 1])]])
        out[i:j] = mix64(r.at(first[i:j] - low, size) + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        i = j
    return out


def multikey_quicksort(word, lo: np.ndarray, hi: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the strings of each segment [lo, hi) of 0 .. n-1; strings are of `depth` words, word(items, levels) gives them.

    Each segment is cut in three around the median of three of its words at its level: lesser and greater
    words go on at that level, equal ones at the next. All segments advance together. Returns the order and,
    for each place, how many leading words its string shares with that of the place before (-1 at a segment's start).
    """
    n = int(hi[-1]) if len(hi) else 0
    order, shared = np.arange(n), np.full(n, -1, np.int32)
    level = np.zeros(len(lo), np.int64)
    while True:
        live = hi - lo > 1
        lo, hi, level = lo[live], hi[live], level[live]
        same = level == depth  # wholly equal strings
        if same.any():
            size = hi[same] - lo[same]
            at = np.repeat(lo[same] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            keep = np.ones(len(at), bool)
            keep[np.cumsum(size) - size] = False
            shared[at[keep]] = depth
            lo, hi, level = lo[~same], hi[~same], level[~same]
        if not len(lo):
            return order, shared
        size = hi - lo
        first = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(lo)), size)
        pos = lo[seg] - first[seg] + np.arange(len(seg))
        items = order[pos]
        v = word(items, level[seg])
        pivot = _middle(v[first], v[first + size // 2], v[first + size - 1])
        kind = (v >= pivot[seg]).astype(np.int8) + (v > pivot[seg])
        counts = np.bincount(3 * seg + kind, minlength=3 * len(lo)).reshape(-1, 3)
        start = lo[:, None] + np.cumsum(counts, axis=1) - counts
        for k in range(3):
            mine = kind == k
            rank = np.cumsum(mine) - 1
            before = np.concatenate(([0], np.cumsum(mine)))[first]
            order[(start[seg, k] + rank - before[seg])[mine]] = items[mine]
        for k in (1, 2):  # neighbours on either side of a cut differ in the word at this level
            cut = (counts[:, k] > 0) & (start[:, k] > lo)
            shared[start[cut, k]] = level[cut]
        lo, hi = start.reshape(-1), (start + counts).reshape(-1)
        level = (level[:, None] + np.array([0, 1, 0])).reshape(-1)


def _middle(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def merge_spans(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal runs (touching spans merge)."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1])))
    return first[new], reach[np.concatenate((new[1:] - 1, [len(reach) - 1]))]
