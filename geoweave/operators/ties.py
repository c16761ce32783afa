"""Edges tied together within the tasks that have them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext


def tied(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that these edges connect to a lesser one, and the least that it reaches by them."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        a, b = label[i], label[j]
        low, new = np.minimum(a, b), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def tie_slices(most: int):
    """The edges of a task as stars, slice by slice; slice says which edges were seen together."""

    def out(held: list[pa.RecordBatch], name: int) -> pa.RecordBatch:
        u, v = tied(*(np.concatenate([b[c].to_numpy() for b in held]) for c in ("u", "v")))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), name))], names=["u", "v", "slice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= most:
                yield out(held, name)
                name, held, size = name + 1, [], 0
        if size:
            yield out(held, name)

    return run
